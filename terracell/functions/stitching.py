"""Rings from directed edges and the shells around holes, in whole arrays.

Edges have the inside on their left and meet at their ends only, as the border of a coverage does.  Where edges cross, rings and their areas stay
right, but the shell of a hole is found by a search over all shells.
"""

from __future__ import annotations

import numpy as np

#: Rings one after the other: the coordinates of their points, each ring closed, and where each begins, with the end of the last.
Rings = tuple[np.ndarray, np.ndarray]


def polygons(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> list[list[np.ndarray]]:
    """Shells, the smallest first, each with the holes of which it is the smallest shell around; rings without area go.

    Sorting and binary searches only: n log² n steps for n edges, whatever the number of rings.
    """
    points, starts = rings(ax, ay, bx, by)
    if len(starts) < 2:
        return []
    found = np.split(points, starts[1:-1], axis=1)
    size = _areas(points, starts)
    shells = np.flatnonzero(size > 0)
    shells = shells[np.argsort(size[shells], kind="stable")]
    out = {k: [found[k]] for k in shells.tolist()}
    for hole, shell in zip(*_homes(points, starts, size, shells)):
        out[shell].append(found[hole])
    return list(out.values())


def rings(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> Rings:
    """Closed rings of edges of which as many leave each point as reach it; a ring passes no point twice.

    Where several edges leave a point each goes on next to its inside, so parts that only touch become rings of their own.
    """
    if not all(np.isfinite(v).all() for v in (ax, ay, bx, by)):
        raise ValueError("a coordinate is no number")
    order = np.lexsort((by, bx, ay, ax))
    ax, ay, bx, by = (v[order] + 0.0 for v in (ax, ay, bx, by))
    n = len(ax)
    x, y, number = _numbered(np.concatenate([ax, bx]), np.concatenate([ay, by]))
    source, target = number[:n], number[n:]
    leaving = np.bincount(source, minlength=len(x))
    if (leaving != np.bincount(target, minlength=len(x))).any():
        raise ValueError("a ring is not closed")
    if not n:
        return np.zeros((2, 0)), np.zeros(1, np.int64)
    by_source = np.argsort(source, kind="stable")
    after = by_source[(np.cumsum(leaving) - leaving)[target]]
    _pair(after, source, target, leaving, x, y)

    # The smallest edge of each cycle, and the steps to it, by doubling.
    first, hop = np.arange(n), after
    for _ in range(n.bit_length()):
        first, hop = np.minimum(first, first[hop]), hop[hop]
    root = first == np.arange(n)
    steps, hop = np.where(root, 0, 1), np.where(root, np.arange(n), after)
    for _ in range(n.bit_length()):
        steps, hop = steps + steps[hop], hop[hop]
    order = np.lexsort((-np.where(root, n + 1, steps), first))
    cycle, at = np.cumsum(root[order]) - 1, source[order]

    # Cycles that pass a point more than once fall into rings.
    many = np.flatnonzero(leaving[at] > 1)
    key, times = np.unique(cycle[many] * len(x) + at[many], return_counts=True)
    knotted = np.zeros(cycle[-1] + 1, bool)
    knotted[key[times > 1] // len(x)] = True
    if knotted.any():
        begins = np.flatnonzero(root[order])
        pieces = []
        for c, run in zip(knotted.tolist(), np.split(at, begins[1:])):
            pieces += _untied(run) if c else [run]
        at = np.concatenate(pieces)
        sizes = np.array([len(p) for p in pieces])
    else:
        sizes = np.bincount(cycle)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    closed = np.insert(at, starts[1:], at[starts[:-1]])
    return np.stack([x[closed], y[closed]]), starts + np.arange(len(starts))


def _numbered(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct points and the number of each point among them; points are equal by their bits."""
    kx, ky = px.view(np.int64), py.view(np.int64)
    order = np.lexsort((ky, kx))
    new = np.ones(len(px), bool)
    new[1:] = (kx[order][1:] != kx[order][:-1]) | (ky[order][1:] != ky[order][:-1])
    number = np.empty(len(px), np.int64)
    number[order] = np.cumsum(new) - 1
    return px[order][new], py[order][new], number


def _pair(after: np.ndarray, source: np.ndarray, target: np.ndarray, leaving: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Sets the next edge of those that reach a point which several leave.

    Around the point, clockwise, an edge that arrives and the next one that leaves and is not taken belong together, like brackets.
    """
    come, go = np.flatnonzero(leaving[target] > 1), np.flatnonzero(leaving[source] > 1)
    if not len(come):
        return
    here, there = np.concatenate([source[go], target[come]]), np.concatenate([target[go], source[come]])
    turn = -np.arctan2(y[there] - y[here], x[there] - x[here])
    arrives = np.repeat([False, True], [len(go), len(come)])
    order = np.lexsort((arrives, turn, here))
    open_, early, last = [], [], -1
    for p, edge, comes in zip(here[order].tolist(), np.concatenate([go, come])[order].tolist(), arrives[order].tolist()):
        if p != last:
            for e in early:
                after[open_.pop()] = e
            open_, early, last = [], [], p
        if comes:
            open_.append(edge)
        elif open_:
            after[open_.pop()] = edge
        else:
            early.append(edge)
    for e in early:
        after[open_.pop()] = e


def _untied(run: np.ndarray) -> list[np.ndarray]:
    """The rings of a cycle of points that it passes more than once."""
    path, places, out = [], {}, []
    for p in run.tolist():
        if p in places:
            loop = path[places[p] :]
            out.append(np.array(loop))
            del path[places[p] :]
            for q in loop:
                del places[q]
        places[p] = len(path)
        path.append(p)
    return [*out, np.array(path)]


def _areas(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signed area of each ring."""
    x, y = points - np.repeat(points[:, starts[:-1]], np.diff(starts), axis=1)
    cross = np.zeros(len(x))
    cross[:-1] = x[:-1] * y[1:] - x[1:] * y[:-1]
    cross[starts[1:] - 1] = 0.0
    return np.add.reduceat(cross, starts[:-1]) / 2


def _homes(points: np.ndarray, starts: np.ndarray, size: np.ndarray, shells: np.ndarray) -> tuple[list[int], list[int]]:
    """(holes, their shells).

    Below the middle of a hole's lower edge is the inside, down to an edge of the shell or of another hole with the same shell: rings linked in this way belong
    together.
    """
    holes = np.flatnonzero(size < 0)
    if not len(holes) or not len(shells):
        return [], []
    x, y = points
    ring = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    real = np.ones(len(x), bool)
    real[starts[1:] - 1] = False
    e = np.flatnonzero(real)
    lower, upper = e[x[e + 1] > x[e]], e[(x[e + 1] < x[e]) & (size[ring[e]] < 0)]
    hit = _below((x[upper] + x[upper + 1]) / 2, (y[upper] + y[upper + 1]) / 2, x[lower], y[lower], x[lower + 1], y[lower + 1])
    a, b = ring[upper[hit >= 0]], ring[lower[hit[hit >= 0]]]
    group = _groups(len(size), a, b)
    count = np.bincount(group[shells], minlength=len(size))
    of_group = np.full(len(size), -1)
    of_group[group[shells]] = shells
    home = np.where(count[group[holes]] == 1, of_group[group[holes]], -1)

    low, high = np.minimum.reduceat(points, starts[:-1], axis=1), np.maximum.reduceat(points, starts[:-1], axis=1)
    fits = (size[home] > -size[holes]) & (low[:, home] <= low[:, holes]).all(axis=0) & (high[:, home] >= high[:, holes]).all(axis=0)
    for k in np.flatnonzero((home < 0) | ~fits).tolist():
        h = holes[k]
        near = shells[(size[shells] > -size[h]) & (low[:, shells] <= low[:, [h]]).all(axis=0) & (high[:, shells] >= high[:, [h]]).all(axis=0)]
        around = (s for s in near.tolist() if _around(points[:, starts[s] : starts[s + 1]], points[:, starts[h] : starts[h + 1]]))
        home[k] = next(around, shells[-1])
    return holes.tolist(), home.tolist()


def _around(shell: np.ndarray, hole: np.ndarray) -> bool:
    """Even-odd rule for a point of the hole that is no corner of the shell."""
    corners = set(zip(*shell.tolist()))
    px, py = next((p for p in zip(*hole.tolist()) if p not in corners), tuple(((hole[:, 0] + hole[:, 1]) / 2).tolist()))
    (x0, y0), (x1, y1) = shell[:, :-1], shell[:, 1:]
    k = np.flatnonzero((y0 > py) != (y1 > py))
    return bool(np.count_nonzero(px < x0[k] + (py - y0[k]) * (x1[k] - x0[k]) / (y1[k] - y0[k])) % 2)


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` is linked to, by the pairs ``a, b``."""
    label = np.arange(n)
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _below(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each point the edge next below it, or -1; edges run from ``ax`` up to ``bx`` and do not cross.

    A segment tree over x, one level after the other: an edge is in the few nodes that it spans exactly, where edges have one order of y.
    """
    best, height = np.full(len(px), -1), np.full(len(px), -np.inf)
    if not len(px) or not len(ax):
        return best
    xs = np.unique(np.concatenate([ax, bx]))
    width = 1 << len(xs).bit_length()
    lo, hi = np.searchsorted(xs, ax) + width, np.searchsorted(xs, bx) + width
    node = np.searchsorted(xs, px, "right") - 1 + width
    at = lambda e, x: ay[e] + (x - ax[e]) * ((by[e] - ay[e]) / (bx[e] - ax[e]))
    level, live = 0, np.arange(len(ax))
    while len(live):
        odd_lo, odd_hi = (lo[live] & 1) == 1, (hi[live] & 1) == 1
        edge = np.concatenate([live[odd_lo], live[odd_hi]])
        of = np.concatenate([lo[live[odd_lo]], hi[live[odd_hi]] - 1])
        middle = (xs[(of << level) - width] + xs[((of + 1) << level) - width]) / 2
        order = np.lexsort((at(edge, middle), of))
        edge, of = edge[order], of[order]
        first, last = np.searchsorted(of, node >> level, "left"), np.searchsorted(of, node >> level, "right")
        ask = np.flatnonzero(first < last)
        i, j = first[ask], last[ask]
        while (open_ := i < j).any():
            k = (i + j) // 2
            under = at(edge[np.minimum(k, len(edge) - 1)], px[ask]) < py[ask]
            i, j = np.where(open_ & under, k + 1, i), np.where(open_ & ~under, k, j)
        ask, i = ask[i > first[ask]], i[i > first[ask]] - 1
        y = at(edge[i], px[ask])
        higher = y > height[ask]
        best[ask[higher]], height[ask[higher]] = edge[i[higher]], y[higher]
        lo[live], hi[live] = (lo[live] + 1) >> 1, hi[live] >> 1
        live = live[lo[live] < hi[live]]
        level += 1
    return best
