"""Trees fitted once: generated layouts, whole pages of the tables, and odd markup."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from freightlens.llm import extraction
from freightlens.llm.dom import N_FEATURES, Tree, unpacked
from freightlens.llm.page_maker import Maker


@pytest.fixture(scope="module")
def trees(spark):
    return extraction.trees(spark)


def test_scores_equal_the_fitted_model(spark):
    from pyspark.ml.classification import GBTClassifier

    rows = extraction.training_rows(spark, 60).persist()
    model = GBTClassifier(maxIter=3, maxDepth=4, seed=1).fit(rows)
    trees = extraction.arrays(spark, model)
    out = model.transform(rows).select("features", "probability").limit(500).collect()
    got = extraction.scores(trees, np.array([r.features.toArray() for r in out]))
    assert np.allclose(got, [r.probability[1] for r in out])


def test_unseen_layouts(trees):
    held = [Tree(Maker(10**6 + i).page()) for i in range(150)]
    words = [0, 0, 0]
    for t in held:
        keep = t.decode(extraction.scores(trees, unpacked(*t.features())).tolist())
        got, want = t.text(keep).split(), t.text([bool(x) for x in t.labels()]).split()
        both = len(set(got) & set(want))
        words = [words[0] + both, words[1] + len(set(got)), words[2] + len(set(want))]
    assert words[0] / words[1] > 0.93 and words[0] / words[2] > 0.93


def test_pages_of_the_tables(spark, trees):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    import html
    import re

    right = 0
    for r, got in zip(rows, extraction.main_text([r.html for r in rows], trees)):
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"</?(?:h1|p|br|div)\b[^>]*>", " ", body)
        right += got == " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())
    assert right / len(rows) > 0.97


def test_choices_never_contradict(trees):
    for i in range(30):
        t = Tree(Maker(5000 + i).page())
        keep = t.decode(np.random.default_rng(i).random(len(t.tag)).tolist())
        assert all(keep[t.parent[k]] for k in range(1, len(keep)) if keep[k])


def test_odd_markup():
    for page in ("", "plain", "<", "<p", "<div><p>a<p>b</div>c", "</p></div>", "<!-- open", "<script>if (a < b) {</script>x", "<a href='>'>y</a>", '<p class="x>z', "<ul><li>1<li>2</ul>", "<b><i>m</b></i>", "<style>" * 5, "<table><tr><td>1<td>2<tr><td>3</table>", "&amp;&#233;&nbsp;&bogus;", "<div>" * 3000 + "deep"):
        t = Tree(page)
        f = unpacked(*t.features())
        assert f.shape == (len(t.tag), N_FEATURES) and np.isfinite(f).all()
        t.text(t.decode([0.9] * len(f)))
    keep = lambda s: (lambda t: t.text([True] * len(t.tag)))(Tree(s))
    assert keep("<p>a <b>b</b>c<br>d</p>e<script>f</script>&eacute;<p hidden>g <b>h</b></p>i") == "a bc d eé i"
    assert keep("a<div style='color:red; display : none'>b<p>c</p></div>d<p title='a hidden gem' class='x hidden y'>e</p><ul hidden=until-found><li>f</ul>") == "a d e"
    assert keep("<head><title>no</title></head><body>yes") == "yes"


def test_columns(spark, trees):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<article><h1>T</h1><p>" + "Long words here. " * 20_000 + "</p></article>", "t"), (3, "<nav><a href=x>m</a></nav>", "t")]
    out = extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string"), trees).collect()
    assert [r.text for r in out[:2]] == ["", ""] and len(out[2].text) > 300_000 and len(out) == 4
    assert extraction.extract(spark.createDataFrame([], "page_id long, html string"), trees).collect() == []


def best_choice(t, p, stay=1.0):
    """The likeliest choice, by trying all that keep nothing below what is dropped."""
    n, best = len(t.tag), (-math.inf, None)
    for bits in itertools.product((False, True), repeat=n - 1):
        keep = (True, *bits)
        if all(keep[t.parent[i]] for i in range(1, n) if keep[i]):
            score = sum(math.log(p[i] if keep[i] else 1 - p[i]) + (stay if keep[i] and t.parent[i] > 0 else 0.0) for i in range(n))
            best = max(best, (score, keep))
    return best


def test_decode_is_the_likeliest_choice():
    rng = random.Random(4)
    for _ in range(60):
        page, n = "", rng.randint(1, 11)
        for _ in range(n):
            page += "<div>" + "</div>" * rng.choice((0, 1, 1, 2))
        t = Tree(page)
        p = [rng.uniform(0.02, 0.98) for _ in t.tag]
        keep = t.decode(p)
        score, want = best_choice(t, p)
        got = sum(math.log(p[i] if k else 1 - p[i]) + (1.0 if k and t.parent[i] > 0 else 0.0) for i, k in enumerate(keep))
        assert abs(got - score) < 1e-9 and tuple(keep) == want


def test_text_straight_below_the_body_can_be_dropped():
    t = Tree("<body>notice <b>bold</b> more<br>line<article><p>text</p></article>&copy; someone</body>")
    assert [x for x in t.tag if x == "#text"] == ["#text"] * 2 and t.parent[t.tag.index("b")] == 1
    assert t.text([x != "#text" and (i == 0 or t.tag[t.parent[i]] != "#text") for i, x in enumerate(t.tag)]) == "text"


def test_bad_markup_takes_no_longer_than_good():
    for unit in ("<b>", "</i>", "<b></i>", "<svg>", "<h1>", "<p><div>", "<div><p><b><h1>", "<td>", "<!-", "<a '", "&amp", "<li><ul>"):
        page = "<b>" * 1000 + unit * (1_000_000 // len(unit)) + "end"
        begin = time.monotonic()
        t = Tree(page)
        assert time.monotonic() - begin < 6, unit
        assert "end" in t.text([True] * len(t.tag)) or unit in ("<a '", "<!-")


def test_trees_are_kept(spark, trees):
    begin = time.monotonic()
    again = extraction.trees(spark)
    assert time.monotonic() - begin < 5 and len(again) == len(trees)
    x = unpacked(*Tree(Maker(77).page()).features())
    assert (extraction.scores(again, x) == extraction.scores(trees, x)).all()


@pytest.mark.parametrize("page,want", [
    ("<script src=/js/>alert(1)</script><p>x", "x"), ("<script src='/js/'/>alert(1)</script><p>x", "x"),
    ("<style media=screen/>p { color: red }</style><p>x", "x"), ("<textarea name=a/>typed</textarea><p>x", "x"),
    ("<div hidden/>secret</div><p>x", "x"), ("<div style='display:none'/>secret</div><p>x", "x"),
    ("<p>a<svg viewBox='0 0 1 1'/>b</p>", "ab"), ("<p>a<svg class=i/><title>no</title></svg>b</p>", "ab"), ("<p>a<math/>b</p>", "ab"),
    ("<p>a<br/>b<hr/>c<img src=/x/>d<input value=/y/>e</p>", "a b cde"), ("<ul><li/>a<li/>b</ul>", "a b"),
])
def test_slashes_end_empty_elements_only(page, want):
    t = Tree(page)
    assert " ".join(t.text([True] * len(t.tag)).split()) == want


def test_links_with_slashes_stay_in_their_menu():
    t = Tree("<nav><ul><li><a href=/>Home</a><li><a href=/news/>News</a></ul></nav><article><p>Text</p></article>")
    for k, tag in enumerate(t.tag):
        if tag == "a":
            above, at = [], k
            while at > 0:
                at = t.parent[at]
                above.append(t.tag[at])
            assert above == ["li", "ul", "nav", "html"]
    assert t.text([tag not in ("nav", "ul", "li", "a") for tag in t.tag]) == "Text"
