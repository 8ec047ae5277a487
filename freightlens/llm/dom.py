"""A lenient HTML tree and features of its elements."""

from __future__ import annotations

import functools
import html as entities
import math
import re
import zlib
from collections import Counter

import numpy as np

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSHOWN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none|display:none)""", re.I)
_UNQUOTED_SLASH = re.compile(r"""=\s*[^\s"'>]*/$""")
_MARK = re.compile(r'data-label="([01])"')
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_ENDS = re.compile(r"[.!?;:,。！？]")

# Fixed values of HTML: elements without content, with raw content, that end an open paragraph, that end
# an open element of their own kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title select object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - frozenset("br button label option td th tr tbody caption".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Groups of elements that features tell apart. Words in class, id and role are told apart by a hash.
TAGS = ("p", "h1 h2 h3 h4 h5 h6", "a", "ul ol menu dl", "li dt dd", "table tbody thead tr td th", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset button label input", "blockquote pre code figure figcaption", "body html", "b i em strong span u small sup sub", "#text")
TOKENS = 128
_TAG_GROUP = {t: i for i, g in enumerate(TAGS) for t in g.split()}
_KEPT_ABOVE = sum(1 << _TAG_GROUP[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "a", "blockquote"))
NUMBERS = 20
#: Bytes of the yes-or-no features of an element: its tag, those above, its words, those above.
FLAGS = (2 * len(TAGS) + 2 * TOKENS + 7) // 8
N_FEATURES = NUMBERS + 8 * FLAGS
#: Elements nest no deeper; one that would is put beside the last instead, as browsers do.
DEEPEST = 512
#: What text and inline elements straight below the root are gathered in.
BARE = "#text"


@functools.lru_cache(100_000)
def _token(word: str) -> int:
    return 1 << zlib.crc32(word.encode("utf-8", "surrogatepass")) % TOKENS


class Tree:
    """Elements in page order; element 0 is the root. texts: (element, text), block boundaries as (-1, blank).
    What is not shown (hidden elements, scripts, the head) has no text."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.words, self.label, self.shown = ["html"], [-1], [0], [None], [True]
        self.texts: list[tuple[int, str]] = []
        self._stack, self._open = [0], Counter()
        self._read(page)

    def _push(self, node: int) -> None:
        if len(self._stack) >= DEEPEST:
            self._cut(len(self._stack) - 1)
        self._stack.append(node)
        self._open[self.tag[node]] += 1

    def _cut(self, k: int) -> None:
        """Closes all elements from place k of the stack on."""
        for node in self._stack[k:]:
            self._open[self.tag[node]] -= 1
        del self._stack[k:]

    def _close_to(self, names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of `names`, unless one of `stop` is further in. Open elements are
        counted by name, so one that is not open costs nothing."""
        if any(self._open[x] for x in names):
            for k in range(len(self._stack) - 1, 0, -1):
                if (tag := self.tag[self._stack[k]]) in names:
                    self._cut(k)
                    return
                if tag in stop:
                    return

    def _read(self, page: str) -> None:
        stack, at, out, search, missing = self._stack, 0, self.texts, _TOKEN.search, set()

        def after(pattern: str) -> re.Match | None:
            """The next match from `at` on; a page that has no more of them is not searched again."""
            if pattern in missing:
                return None
            found = re.compile(pattern, re.I).search(page, at)
            if not found:
                missing.add(pattern)
            return found

        while True:
            m = search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                if len(stack) == 1 and not text.isspace():
                    self._push(self._add(BARE, 0, ""))
                if self.shown[stack[-1]]:
                    out.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not m:
                return
            at = m.end()
            end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                out.append((-1, " "))
                if name not in VOID and len(stack) > 1 and self.tag[stack[1]] == BARE:
                    self._cut(1)
            if end:
                if name not in ("html", "body"):
                    self._close_to((name,))
                continue
            if name in VOID:
                if name == "input":
                    self._add(name, stack[-1], rest)
                continue
            if name in ENDS_P:
                self._close_to(("p",), ("div", "td", "th", "li", "article", "section", "main", "aside", "blockquote", "body", "form", "button"))
            if name in SIBLING:
                self._close_to(SIBLING[name], HOLDS[name])
            if name in RAW:
                # A slash ends foreign elements only, unless it belongs to a value without quotes.
                if not (name in ("svg", "math") and rest.endswith("/") and not _UNQUOTED_SLASH.search(rest)):
                    close = after(rf"</{re.escape(name)}\s*>")
                    at = close.end() if close else len(page) if name in ("script", "style") else at
                continue
            if name in ("html", "body", "head"):
                if name == "head":  # nothing of it is shown
                    close = after(r"</head\s*>|<body\b")
                    if close:
                        at = close.end() if close[0][1] == "/" else close.start()
                elif marked := _MARK.search(rest):
                    self.label[0] = marked[1] == "1"
                continue
            if len(stack) == 1 and name not in BLOCK:
                self._push(self._add(BARE, 0, ""))
            self._push(self._add(name, stack[-1], rest))

    def _add(self, name: str, parent: int, rest: str) -> int:
        words, label, shown = 0, None, self.shown[parent]
        if rest:
            shown = shown and not (("hidden" in rest.lower() and _HIDDEN.search(_QUOTED.sub("x", rest))) or ("none" in rest.lower() and _UNSHOWN.search(rest)))
            if "=" in rest:
                for m in _ATTRIBUTE.finditer(rest):
                    value = m[2] or m[3] or m[4] or ""
                    if m[1].lower() == "data-label":
                        label = value == "1"
                        continue
                    for w in _SPLIT.split(value):
                        if w:
                            words |= _token(w.lower())
        self.tag.append(name)
        self.parent.append(parent)
        self.words.append(words)
        self.label.append(label)
        self.shown.append(shown)
        return len(self.tag) - 1

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """The NUMBERS of each element, and its flags in FLAGS bytes."""
        n, parent, tag = len(self.tag), self.parent, self.tag
        chars, linked, ends, first = [0] * n, [0] * n, [0] * n, [-1] * n
        total = 0
        for i, t in self.texts:
            if i >= 0:
                k = len(t.strip())
                if k:
                    chars[i] += k
                    ends[i] += len(_ENDS.findall(t))
                    if first[i] < 0:
                        first[i] = total
                    total += k
        own = chars[:]
        size, deep, kids = [1] * n, [0] * n, [[] for _ in range(n)]
        ps, lis, links, inputs = [0] * n, [0] * n, [0] * n, [0] * n
        above, words_above, depth = [0] * n, [0] * n, [0] * n
        group = [_TAG_GROUP.get(t, -1) for t in tag]
        for i in range(1, n):
            p = parent[i]
            kids[p].append(i)
            depth[i] = depth[p] + 1
            above[i] = above[p] | (1 << group[p] & _KEPT_ABOVE if group[p] >= 0 else 0)
            words_above[i] = words_above[p] | self.words[p]
        for i in range(n - 1, -1, -1):
            t = tag[i]
            if t == "a":
                linked[i] = chars[i]
                links[i] += 1
            elif t == "p":
                ps[i] += 1
            elif t == "li":
                lis[i] += 1
            elif t in ("input", "button", "label", "form"):
                inputs[i] += 1
            p = parent[i]
            if p >= 0:
                chars[p] += chars[i]
                linked[p] += linked[i]
                ends[p] += ends[i]
                size[p] += size[i]
                ps[p] += ps[i]
                lis[p] += lis[i]
                links[p] += links[i]
                inputs[p] += inputs[i]
                deep[p] = max(deep[p], deep[i] + 1)
                if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                    first[p] = first[i]
        place, same, left, right, beside = [0] * n, [1] * n, [0] * n, [0] * n, [1] * n
        for ks in kids:
            for k, i in enumerate(ks):
                place[i], beside[i] = k, len(ks)
                same[i] = sum(tag[j] == tag[i] for j in ks[max(0, k - 2) : k + 3])
                left[i], right[i] = chars[ks[k - 1]] if k else 0, chars[ks[k + 1]] if k + 1 < len(ks) else 0
        c, whole, over, logs = np.array(chars, float), max(1, total), np.maximum(1, chars), lambda x: np.log1p(np.array(x, float))
        start = np.array([x / whole if x >= 0 else 0.5 for x in first])
        of_parent = c / np.array([1.0, *over[parent[1:]]])
        of_parent[0] = 1.0
        numbers = [
            depth, np.log1p(c), np.array(linked) / over, np.log1p(c / np.array(size)), np.array(ends) / over, logs(own),
            logs(beside), np.array(place) / np.array(beside), of_parent, c / whole, np.array(same) / 5,
            logs(ps), logs(lis), logs(links), logs(inputs), start, start + c / whole, logs(left), logs(right), deep,
        ]
        flags = [(1 << g if g >= 0 else 0) | a << len(TAGS) | w << 2 * len(TAGS) | x << 2 * len(TAGS) + TOKENS for g, a, w, x in zip(group, above, self.words, words_above)]
        packed = np.frombuffer(b"".join([f.to_bytes(FLAGS, "little") for f in flags]), np.uint8).reshape(n, FLAGS)
        return np.stack([np.asarray(x, np.float32) for x in numbers], axis=1), packed

    def labels(self) -> list[int]:
        """1 for content and what holds content. Marked elements say so for themselves and, up to the next
        mark, for those below."""
        n = len(self.tag)
        down = [bool(self.label[0])] * n
        for i in range(1, n):
            down[i] = self.label[i] if self.label[i] is not None else down[self.parent[i]]
        up = down[:]
        for i in range(n - 1, 0, -1):
            up[self.parent[i]] |= up[i]
        return [int(x) for x in up]

    def decode(self, p: list[float], stay: float = 1.0) -> list[bool]:
        """The likeliest choice in which nothing is kept below what is dropped: an element's best is the
        greater of dropping all of it and of keeping it with the best of each child. The root is kept.
        stay: log odds in favour of a child that goes with its parent where both are kept."""
        n = len(self.tag)
        none, some = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            q = min(max(p[i], 1e-6), 1 - 1e-6)
            none[i] += math.log(1 - q)
            some[i] += math.log(q) + (stay if self.parent[i] > 0 else 0.0)
            if self.parent[i] >= 0:
                none[self.parent[i]] += none[i]
                some[self.parent[i]] += max(none[i], some[i])
        keep = [True] * n
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and some[i] >= none[i]
        return keep

    def text(self, keep: list[bool]) -> str:
        return " ".join("".join([t for i, t in self.texts if i < 0 or keep[i]]).split())


def unpacked(numbers: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """All N_FEATURES of some elements."""
    return np.hstack([numbers, np.unpackbits(packed, axis=1, bitorder="little").astype(np.float32)])
