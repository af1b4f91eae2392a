"""Arrangements of polygon edges on a whole-number grid: cutting edges where they meet, winding numbers, rings from edges.

Edges are four arrays of longs ``ax, ay, bx, by``.  Coordinates are not negative and stay below 2**30, so every sign of a cross product is exact.
Edges are cut at hot pixels, the grid points next to a vertex or crossing, which leaves edges that meet at their ends only.
These helpers work on the edges of one strip of rows; :mod:`terracell.operators.overlay` deals the strips to tasks.
"""

from __future__ import annotations

import math

import numpy as np

Edges = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

#: Grid units across the longer side of what is arranged.
SPAN = 1 << 29
#: Edges compared with all others of a strip at once.
BLOCK = 256


def unit(xmin: float, ymin: float, xmax: float, ymax: float) -> float:
    """Grid unit for these bounds: a power of two, so that numbers on a coarser binary grid stay what they are."""
    side = max(xmax - xmin, ymax - ymin, abs(xmin) * 2.0**-22, abs(xmax) * 2.0**-22, abs(ymin) * 2.0**-22, abs(ymax) * 2.0**-22, 1e-300)
    return 2.0 ** math.ceil(math.log2(side / SPAN))


def canonical(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, odd: bool) -> tuple[Edges, np.ndarray]:
    """Each edge once, from its smaller end, with its net direction (``odd``: 1 where it occurs an odd number of times); edges that cancel go."""
    swap = (ax > bx) | ((ax == bx) & (ay > by))
    e = np.stack([np.where(swap, bx, ax), np.where(swap, by, ay), np.where(swap, ax, bx), np.where(swap, ay, by)])
    real = (e[0] != e[2]) | (e[1] != e[3])
    e, way = e[:, real], np.where(swap[real], -1, 1)
    order = np.lexsort(e[::-1])
    e, way = e[:, order], way[order]
    if not e.shape[1]:
        return tuple(e), way
    first = np.flatnonzero(np.concatenate(([True], (e[:, 1:] != e[:, :-1]).any(axis=0))))
    net = np.add.reduceat(np.ones_like(way) if odd else way, first)
    if odd:
        net = net % 2
    return tuple(e[:, first][:, net != 0]), net[net != 0]


def cuts(edges: Edges, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y) of the hot pixels with ``low <= y < high`` that an edge passes; ``edges`` are all that come within a unit of these rows."""
    ax, ay, bx, by = edges
    n = len(ax)
    x0, x1, y0, y1 = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    crossed: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    level, upright = ay == by, ax == bx
    for s in range(0, n, BLOCK):
        e = slice(s, s + BLOCK)
        meet = (x0[e, None] <= x1) & (x0 <= x1[e, None]) & (y0[e, None] <= y1) & (y0 <= y1[e, None])
        # Level edges do not cross one another, nor do upright ones.
        meet &= ~(level[e, None] & level) & ~(upright[e, None] & upright) & (np.arange(n) > np.arange(s, min(n, s + BLOCK))[:, None])
        i, j = np.nonzero(meet)
        i += s
        side = lambda p, q, x, y: (bx[p] - ax[p]) * (y - ay[p]) - (by[p] - ay[p]) * (x - ax[p])
        c, d, f, g = side(i, j, ax[j], ay[j]), side(i, j, bx[j], by[j]), side(j, i, ax[i], ay[i]), side(j, i, bx[i], by[i])
        proper = (np.sign(c) * np.sign(d) < 0) & (np.sign(f) * np.sign(g) < 0)
        i, j, c, d = i[proper], j[proper], c[proper].astype(float), d[proper].astype(float)
        t = c / (c - d)
        x = np.rint(ax[j] + t * (bx[j] - ax[j])).astype(np.int64)
        y = np.rint(ay[j] + t * (by[j] - ay[j])).astype(np.int64)
        mine = (y >= low) & (y < high)
        crossed.append(np.stack([np.concatenate([i[mine], j[mine]]), np.tile(_packed(x[mine], y[mine]), 2)]))
    hit = np.concatenate(crossed, axis=1)
    ends = _packed(np.concatenate([ax, bx]), np.concatenate([ay, by]))
    hot = np.unique(np.concatenate([ends[((y := np.concatenate([ay, by])) >= low) & (y < high)], hit[1]]))
    hx, hy = hot >> 31, hot & ((1 << 31) - 1)
    reach = np.abs(bx - ax) + np.abs(by - ay)
    found = [hit[0] * len(hot) + np.searchsorted(hot, hit[1])]
    for s in range(0, len(hot), BLOCK):
        x, y = hx[s : s + BLOCK, None], hy[s : s + BLOCK, None]
        near = (x >= x0 - 1) & (x <= x1 + 1) & (y >= y0 - 1) & (y <= y1 + 1)
        p, i = np.nonzero(near)
        p += s
        off = (bx[i] - ax[i]) * (hy[p] - ay[i]) - (by[i] - ay[i]) * (hx[p] - ax[i])
        # The square of one unit around the point touches the edge: two of its corners are on different sides, and it is between the ends.
        dx, dy = bx[i] - ax[i], by[i] - ay[i]
        along = dx * (2 * hx[p] - ax[i] - bx[i]) + dy * (2 * hy[p] - ay[i] - by[i])
        end = ((hx[p] == ax[i]) & (hy[p] == ay[i])) | ((hx[p] == bx[i]) & (hy[p] == by[i]))
        on = end | ((2 * np.abs(off) <= reach[i]) & (np.abs(along) < dx * dx + dy * dy))
        found.append(i[on] * len(hot) + p[on])
    out = np.unique(np.concatenate(found))
    edge, at = np.divmod(out, max(1, len(hot)))
    return edge, hx[at], hy[at]


def _packed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both coordinates, which are not negative, as one number."""
    return x << 31 | y


def simple(ring: np.ndarray) -> int:
    """1 or -1, by the ring's turn, for a ring of up to ``BLOCK`` points that meets itself nowhere; 0 if it may do so, has no area or is longer."""
    x, y = ring
    keep = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    x, y = x[keep], y[keep]
    if x[0] == x[-1] and y[0] == y[-1]:
        x, y = x[:-1], y[:-1]
    n = len(x)
    if not 3 <= n <= BLOCK:
        return 0
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    dx, dy = nx - x, ny - y
    # On which side of each edge each point is; the next point along.
    side = np.sign(dx[:, None] * (y - y[:, None]) - dy[:, None] * (x - x[:, None]))
    apart = side * np.roll(side, -1, axis=1) > 0
    i = np.arange(n)
    gap = (i[None, :] - i[:, None]) % n
    far = (gap > 1) & (gap < n - 1)
    box = (np.minimum(x, nx)[:, None] > np.maximum(x, nx)) | (np.minimum(y, ny)[:, None] > np.maximum(y, ny))
    clear = apart | apart.T | box | box.T
    back = (side[i, (i + 2) % n] == 0) & (dx * np.roll(dx, -1) + dy * np.roll(dy, -1) < 0)
    if not clear[far].all() or back.any():
        return 0
    return int(np.sign(((x - x[0]) * (ny - y[0]) - (nx - x[0]) * (y - y[0])).astype(float).sum()))


def pieces(edges: Edges, edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Edges]:
    """(edge, its parts) between the hot pixels that :func:`cuts` found for it."""
    ax, ay, bx, by = edges
    at = (bx[edge] - ax[edge]) * (x - ax[edge]) + (by[edge] - ay[edge]) * (y - ay[edge])
    order = np.lexsort((y, x, at, edge))
    edge, x, y = edge[order], x[order], y[order]
    same = np.flatnonzero(edge[1:] == edge[:-1])
    return edge[same], (x[same], y[same], x[same + 1], y[same + 1])


def inside(edges: Edges, net: np.ndarray, own: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each edge of ``own``: is it inside to the left, and to the right.  ``edges`` meet at their ends only and are all that reach the rows of the middles of ``own``.

    A ray from the west to the middle of an edge adds up what it crosses; ``odd`` is the even-odd rule, otherwise a winding number above zero is inside.
    """
    ax, ay, bx, by = edges
    up = by > ay
    lx, ly, ux, uy = np.where(up, ax, bx), np.where(up, ay, by), np.where(up, bx, ax), np.where(up, by, ay)
    rise = np.where(up, net, -net)
    west = np.zeros(len(own), np.int64)
    for s in range(0, len(own), BLOCK):
        o = own[s : s + BLOCK]
        mx, my = (ax[o] + bx[o])[:, None], (ay[o] + by[o])[:, None]
        k, f = np.nonzero((2 * ly <= my) & (my < 2 * uy))
        east_of = (ux[f] - lx[f]) * (my[k, 0] - 2 * ly[f]) - (uy[f] - ly[f]) * (mx[k, 0] - 2 * lx[f]) < 0
        west[s : s + BLOCK] = np.bincount(k[east_of], weights=-rise[f[east_of]], minlength=len(o)).astype(np.int64)
    # West of an edge that goes up is its left; of a level edge the ray ends above it, and that is its left.
    left = np.where(up[own] | (ay[own] == by[own]), west, west + net[own])
    right = left - net[own]
    return ((left % 2 == 1), (right % 2 == 1)) if odd else ((left > 0), (right > 0))


def directed(edges: Edges, left: np.ndarray, right: np.ndarray) -> Edges:
    """The edges with the inside on one side only, turned so that it is the left."""
    keep = left != right
    ax, ay, bx, by = (v[keep] for v in edges)
    turn = right[keep]
    return np.where(turn, bx, ax), np.where(turn, by, ay), np.where(turn, ax, bx), np.where(turn, ay, by)


def boundary(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, odd: bool, strip_edges: int = 256) -> Edges:
    """Directed border of what the edges enclose, strip by strip in this process."""
    edges, net = canonical(ax, ay, bx, by, odd)
    if not len(net):
        return edges
    whole = [np.zeros(0, np.int64)] * 3
    for low, high, near in _strips(edges, strip_edges, 1):
        e, x, y = cuts(tuple(v[near] for v in edges), low, high)
        whole = [np.concatenate(p) for p in zip(whole, (near[e], x, y))]
    of, parts = pieces(edges, *whole)
    forward = np.repeat(np.abs(net[of]), 1)
    a, b, c, d = (np.repeat(v, forward) for v in parts)
    turn = np.repeat(net[of] < 0, forward)
    edges, net = canonical(np.where(turn, c, a), np.where(turn, d, b), np.where(turn, a, c), np.where(turn, b, d), odd)
    middle = edges[1] + edges[3]
    left, right = np.zeros(len(net), bool), np.zeros(len(net), bool)
    for low, high, near in _strips(edges, strip_edges, 0):
        own = np.flatnonzero((middle[near] >= 2 * low) & (middle[near] < 2 * high))
        left[near[own]], right[near[own]] = inside(tuple(v[near] for v in edges), net[near], own, odd)
    return directed(edges, left, right)


def _strips(edges: Edges, strip_edges: int, pad: int):
    """(first row, row after the last, edges that come within ``pad`` of them)."""
    low, high = np.minimum(edges[1], edges[3]), np.maximum(edges[1], edges[3])
    if not len(low):
        return
    first, last = int(low.min()), int(high.max())
    height = max(1, -(-(last - first + 1) // max(1, len(low) // strip_edges)))
    order = np.argsort(low, kind="stable")
    for s in range(first, last + 1, height):
        reach = order[: np.searchsorted(low[order], s + height + pad, "left")]
        yield s, s + height, reach[high[reach] >= s - pad]


def rings(edges: Edges) -> list[np.ndarray]:
    """Closed rings of directed edges, each passing no point twice: shells counterclockwise, holes clockwise.

    Where several edges leave a point the one next to the inside is taken, so that parts that only touch become shells of their own.
    """
    packed, number = np.unique(_packed(np.concatenate([edges[0], edges[2]]), np.concatenate([edges[1], edges[3]])), return_inverse=True)
    points = np.stack([packed >> 31, packed & ((1 << 31) - 1)])
    n = len(edges[0])
    source, target = number[:n].tolist(), number[n:].tolist()
    leaving: dict[int, list[int]] = {}
    for e in range(n):
        leaving.setdefault(source[e], []).append(e)
    px, py = points[0].tolist(), points[1].tolist()

    def turn(frm: int, at: int, e: int) -> float:
        """Clockwise angle from the way back to the edge."""
        back, out = math.atan2(py[frm] - py[at], px[frm] - px[at]), math.atan2(py[target[e]] - py[at], px[target[e]] - px[at])
        return (back - out) % (2 * math.pi) or 2 * math.pi

    used, found = [False] * n, []
    for e in range(n):
        path, places = [source[e]], {source[e]: 0}
        while not used[e]:
            used[e] = True
            p = target[e]
            if p in places:
                ring = path[places[p] :]
                if len(ring) > 2:
                    found.append(points[:, [*ring, p]])
                for q in ring[1:]:
                    del places[q]
                del path[places[p] + 1 :]
            else:
                places[p] = len(path)
                path.append(p)
            free = [k for k in leaving.get(p, ()) if not used[k]]
            if not free:
                break
            frm = source[e]
            e = free[0] if len(free) == 1 else min(free, key=lambda k: turn(frm, p, k))
    return found


def area2(ring: np.ndarray) -> int:
    """Twice the area of a closed ring, positive if it runs counterclockwise."""
    x, y = (v - v[0] for v in ring)
    return int((x[:-1] * y[1:] - x[1:] * y[:-1]).astype(object).sum()) if x.dtype == object else int(sum((x[:-1] * y[1:] - x[1:] * y[:-1]).tolist()))


def polygons(found: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells, each with the holes of which it is the smallest shell around; largest shells first."""
    sized = [(area2(r), r) for r in found]
    shells = sorted(((a, r) for a, r in sized if a > 0), key=lambda s: (s[0], s[1][:, 0].tolist()))
    out = [[r] for _, r in shells]
    boxes = np.array([[*r.min(axis=1), *r.max(axis=1)] for _, r in shells]).reshape(-1, 4)
    for a, hole in sized:
        if a >= 0:
            continue
        lo, hi = hole.min(axis=1), hole.max(axis=1)
        around = np.flatnonzero((boxes[:, 0] <= lo[0]) & (boxes[:, 1] <= lo[1]) & (boxes[:, 2] >= hi[0]) & (boxes[:, 3] >= hi[1]))
        # The middle of the hole's first edge is on no shell.
        mx, my = int(hole[0, 0] + hole[0, 1]), int(hole[1, 0] + hole[1, 1])
        home = next((k for k in around.tolist() if shells[k][0] > -a and _holds(shells[k][1], mx, my)), None)
        if home is not None:
            out[home].append(hole)
    return out[::-1]


def _holds(ring: np.ndarray, mx: int, my: int) -> bool:
    """Even-odd rule for a point in half units."""
    x, y = 2 * ring[0], 2 * ring[1]
    spans = (y[:-1] > my) != (y[1:] > my)
    k = np.flatnonzero(spans)
    up = y[k + 1] > y[k]
    # Halves keep the products within a long.
    side = (x[k + 1] - x[k]) // 2 * (my - y[k]) - (y[k + 1] - y[k]) // 2 * (mx - x[k])
    return bool(np.count_nonzero(np.where(up, side > 0, side < 0)) % 2)
