"""The boundary of a union of convex pieces, as buffers have: every edge against every piece's half-planes at once.

An edge is a border where no other piece holds it, and its own piece is on its left,
so nothing is cut and counted that lies inside. This is done in floats; where they
can't tell (ends that don't meet one to one), there is no answer and the caller takes
the exact arrangement.
"""

from __future__ import annotations

import numpy as np

#: Edges up to which all are compared with all, and edges of a piece up to which it isn't taken for round at first.
MOST, FEW = 1500, 8
#: In units of the coordinates, which are metres: on a line, too short for an edge, and the same place.
ON, SHORT, NEAR = 1e-6, 1e-5, 1e-3


def border(pieces: list[list]) -> list[list] | None:
    """Closed rings, the union on their left, of counter-clockwise convex closed rings; None where floats can't tell."""
    # A ring's first vertex is its last, so its piece comes twice.
    pieces = list({tuple(q): q for q in pieces}.values())
    sizes = np.array([len(q) - 1 for q in pieces])
    n = int(sizes.sum())
    if not n or n > MOST:
        return None
    base = np.array(pieces[0][0], float)
    at = np.array([p for q in pieces for p in q[:-1]], float) - base
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(1, n + 1)
    after[first + sizes - 1] = first
    d = at[after] - at
    size = np.hypot(d[:, 0], d[:, 1])
    if size.min() < NEAR:
        return None
    u = d / size[:, None]
    c = u[:, 0] * at[:, 1] - u[:, 1] * at[:, 0]

    def beside(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How far points are on the left of the lines of edges."""
        s = np.multiply.outer(p[:, 1], u[e, 0])
        s -= np.multiply.outer(p[:, 0], u[e, 1])
        s -= c[e]
        return s

    # First without the edges that one piece holds, a piece of many edges by the circle inside it.
    round_ = sizes > FEW
    held = []
    if round_.any():
        centre = np.add.reduceat(at, first)[round_] / sizes[round_, None]
        middle = np.zeros((len(sizes), 2))
        middle[round_] = centre
        radius = np.minimum.reduceat(u[:, 0] * middle[owner, 1] - u[:, 1] * middle[owner, 0] - c, first)[round_] - ON
        away = np.square(np.subtract.outer(at[:, 0], centre[:, 0])) + np.square(np.subtract.outer(at[:, 1], centre[:, 1]))
        held.append(away < np.square(np.maximum(radius, 0.0)))
    if not round_.all():
        few = sizes[~round_]
        held.append(np.minimum.reduceat(beside(at, np.nonzero(~round_[owner])[0]), np.cumsum(few) - few, axis=1) > ON)
    held = np.hstack(held)
    left = np.nonzero(~(held & held[after]).any(axis=1))[0]
    if not len(left):
        return None
    own = owner[left]
    a, b = at[left], at[after[left]]
    # The stretch of each edge that each piece near it holds. Of two edges on one line a piece that faces the other way holds the edge, of two that face alike the earlier one stays.
    least, most = np.minimum.reduceat(at, first) - ON, np.maximum.reduceat(at, first) + ON
    near, far = np.minimum(a, b), np.maximum(a, b)
    meet = near[:, :1] <= most[:, 0]
    meet &= near[:, 1:] <= most[:, 1]
    meet &= far[:, :1] >= least[:, 0]
    meet &= far[:, 1:] >= least[:, 1]
    meet[np.arange(len(left)), own] = False
    i, k = np.nonzero(meet)
    low, high = np.zeros(meet.shape), np.zeros(meet.shape)
    if len(i):
        of = sizes[k]
        start = np.cumsum(of) - of
        e, h = np.repeat(i, of), np.repeat(first[k] - start, of) + np.arange(of.sum())
        ux, uy, ch = u[h, 0], u[h, 1], c[h]
        s0, s1 = ux * a[e, 1] - uy * a[e, 0] - ch, ux * b[e, 1] - uy * b[e, 0] - ch
        rise = s1 - s0
        t = -s0 / np.where(rise == 0, 1.0, rise)
        enter = np.where(rise > 0, t, np.where((rise == 0) & (s0 <= 0), 2.0, 0.0))
        leave = np.where(rise < 0, t, 1.0)
        on = np.nonzero((np.abs(s0) < ON) & (np.abs(s1) < ON))[0]
        if len(on):
            alike = (u[left[e[on]]] * u[h[on]]).sum(axis=1) > 0
            enter[on], leave[on] = np.where(alike & (own[e[on]] < owner[h[on]]), 2.0, 0.0), 1.0
        enter = np.maximum(np.maximum.reduceat(enter, start), 0.0)
        leave = np.minimum(np.minimum.reduceat(leave, start), 1.0)
        some = enter < leave
        low[i[some], k[some]], high[i[some], k[some]] = enter[some], leave[some]
    order = np.argsort(low, axis=1)
    ends = np.zeros((len(left), 1))
    begin = np.hstack([ends, np.maximum.accumulate(np.take_along_axis(high, order, 1), axis=1)])
    end = np.hstack([np.take_along_axis(low, order, 1), ends + 1.0])
    i, j = np.nonzero((end - begin) * size[left][:, None] > SHORT)
    k = left[i]
    p, q = at[k] + begin[i, j][:, None] * d[k], at[k] + end[i, j][:, None] * d[k]
    if not len(p):
        return None
    same = np.abs(np.subtract.outer(q[:, 0], p[:, 0])) < NEAR
    same &= np.abs(np.subtract.outer(q[:, 1], p[:, 1])) < NEAR
    follows = same.argmax(axis=1)
    if (same.sum(axis=1) != 1).any() or (same.sum(axis=0) != 1).any():
        return None
    points, follows = list(map(tuple, (p + base).tolist())), follows.tolist()
    rings, left_over = [], [True] * len(points)
    for k in range(len(points)):
        ring = []
        while left_over[k]:
            left_over[k] = False
            ring.append(points[k])
            k = follows[k]
        if ring:
            if len(ring) < 3:
                return None
            rings.append([*ring, ring[0]])
    return rings
