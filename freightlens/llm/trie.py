"""Join of ordered token lists over a prefix tree, one partition at a time, with numpy.

All lists of a partition form one trie below their groups. A probe walks it level by level, so lists
that begin alike share the walk and its partial overlap. A subtree is left when

- its sizes cannot match the probe's,
- the tokens that one side has and the other lacks so far, at least, already exceed the most that the
  threshold allows for any set below (the bound on what the remaining tokens can still bring), or
- it holds only members of the probe's own component, or only members before the probe.
"""

from __future__ import annotations

import numpy as np


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the owner and position of each item of ranges [first, first + count)."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _over(f, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """f.reduce over each [lo, hi), none empty."""
    padded = np.append(values, values[:1])
    return f.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2]


def slack(total: np.ndarray, percent: int) -> np.ndarray:
    """Tokens in one set but not in both that two sets of `total` tokens together may have."""
    return total - 2 * -(-percent * total // (100 + percent))


def candidates(group: np.ndarray, size: np.ndarray, plen: np.ndarray, last: np.ndarray, comp: np.ndarray, lists: list[np.ndarray], places: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in the input) of one group and of different components that may reach `percent`
    Jaccard similarity. A member is a set of `size` tokens of which the `plen` least are known, up to
    token `last`; `lists` has those known tokens that occur elsewhere too and `places` their positions
    in the set. No pair that reaches the threshold and shares a known token is left out."""
    none = np.empty(0, np.int64)
    if len(group) < 2:
        return none, none
    keys = [int(g).to_bytes(8, "big", signed=True) + t.astype(">u8").tobytes() for g, t in zip(group, lists)]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    group, size, plen, last, comp = (x[order] for x in (group, size, plen, last, comp))
    lists, places = [lists[i] for i in order], [places[i] for i in order]
    m, length = len(order), np.array([len(t) for t in lists], np.int64)
    off = np.concatenate(([0], np.cumsum(length)))
    values, spots = np.concatenate(lists), np.concatenate(places)
    tokens, rank = np.unique(values, return_inverse=True)
    last_rank = np.searchsorted(tokens, last, "right")  # tokens of a lower rank are within what is known
    keyed = np.repeat(np.arange(m), length) << 32 | rank
    shared = np.full(m, -1, np.int64)  # tokens in which a member agrees with the one before it
    for i in np.flatnonzero(group[1:] == group[:-1]) + 1:
        k = min(length[i - 1], length[i])
        differ = np.flatnonzero(lists[i - 1][:k] != lists[i][:k])
        shared[i] = differ[0] if len(differ) else k
    out_i, out_j = [], []

    def emit(i: np.ndarray, j: np.ndarray, o: np.ndarray, miss_i: np.ndarray, miss_j: np.ndarray) -> None:
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = (j > i) & (comp[i] != comp[j]) & (100 * small >= percent * large) & (miss_i + miss_j <= slack(small + large, percent))
        out_i.append(i[keep])
        out_j.append(j[keep])

    def known_before(i: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where token rank r is or would be in i's list; tokens of i's set surely below it."""
        q = np.searchsorted(keyed, i << 32 | r)
        return q, np.where(q > off[i], spots[np.maximum(q - 1, 0)] + 1, 0)

    lo = np.flatnonzero(shared < 0)
    hi = np.append(lo[1:], m)
    probe, node = _spans(np.zeros(m, np.int64), np.ones(m, np.int64))[0], np.searchsorted(lo, np.arange(m), "right") - 1
    o, upto = np.zeros(m, np.int64), np.zeros(len(lo), np.int64)  # upto: tokens of each list below the node passed, at least
    depth = 0
    while len(probe):
        # Members whose lists end here.
        ended = _over(np.add, (length == depth).astype(np.int64), lo, hi)
        who, j = _spans(lo[node], ended[node])
        i, oo = probe[who], o[who]
        if len(i):
            # All that is known of j is also within what is known of i; equal ranks do not tell, since a last token need not be in any list.
            mine = last[j] <= last[i]
            _, below_i = known_before(i, last_rank[j])
            seen_j = np.where(length[j] > 0, spots[np.maximum(off[j + 1] - 1, 0)] + 1, 0)
            emit(i, j, oo, np.where(mine, below_i, plen[i]) - oo, np.where(mine, plen[j], seen_j) - oo)
        # Children.
        breaks = np.flatnonzero(shared <= depth)
        ends = np.append(breaks[1:], m)
        live = length[breaks] > depth
        clo, chi = breaks[live], ends[live]
        if not len(clo):
            break
        first = np.searchsorted(clo, lo)
        who, child = _spans(first[node], (np.searchsorted(clo, hi) - first)[node])
        i, oo = probe[who], o[who]
        below = np.zeros(m, np.int64)
        alive = length > depth
        below[alive] = spots[off[:-1][alive] + depth]
        token = np.zeros(m, np.int64)
        token[alive] = rank[off[:-1][alive] + depth]
        r, reach = token[clo], _over(np.minimum, below, clo, chi)
        nmin, nmax = _over(np.minimum, size, clo, chi), _over(np.maximum, size, clo, chi)
        cmin, cmax = _over(np.minimum, comp, clo, chi), _over(np.maximum, comp, clo, chi)
        keep = (chi[child] > i + 1) & (100 * nmax[child] >= percent * size[i]) & (percent * nmin[child] <= 100 * size[i])
        keep &= ~((cmin[child] == comp[i]) & (cmax[child] == comp[i]))
        i, oo, child, was = i[keep], oo[keep], child[keep], upto[node[who[keep]]]
        unknown = r[child] >= last_rank[i]  # the token is beyond what is known of the probe
        if unknown.any():
            k = np.flatnonzero(unknown)
            span, j = _spans(clo[child[k]], (chi - clo)[child[k]])
            k = k[span]
            emit(i[k], j, oo[k], plen[i[k]] - oo[k], was[k] - oo[k])
            i, oo, child = i[~unknown], oo[~unknown], child[~unknown]
        q, below_i = known_before(i, r[child])
        match = (q < off[i + 1]) & (keyed[np.minimum(q, len(keyed) - 1)] == (i << 32 | r[child]))
        lost = (below_i - oo) + (reach[child] - oo) + ~match
        most = np.minimum(nmax[child], 100 * size[i] // percent)
        # The slack is not monotone but never falls in steps of two, so these two totals hold the greatest.
        total = size[i] + most
        keep = lost <= np.maximum(slack(total, percent), slack(total - 1, percent))
        probe, o, node = i[keep], oo[keep] + match[keep], child[keep]
        lo, hi, upto, depth = clo, chi, reach + 1, depth + 1
    i, j = (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)
    return order[i], order[j]
