"""NumPy kernels for what expressions can't hold: hulls, clipping, tracing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cross2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull vertices, counter-clockwise, without the closing point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and cross2(out[-1] - out[-2], p - out[-2]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def orientation(points: np.ndarray) -> float:
    """Angle in [0, pi/2) of the longer side of the smallest enclosing rectangle."""
    hull = convex_hull(points)
    if len(hull) < 3:
        d = hull[-1] - hull[0] if len(hull) == 2 else np.zeros(2)
        return float(abs(np.arctan2(d[1], d[0])) % (np.pi / 2))
    best = (np.inf, 0.0)
    for d in np.roll(hull, -1, axis=0) - hull:
        u = d / np.hypot(*d)
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        w, h = np.ptp(along), np.ptp(across)
        longer = u if w >= h else np.array([-u[1], u[0]])
        angle = float(abs(np.arctan2(longer[1], longer[0])) % (np.pi / 2))
        best = min(best, (round(w * h, 9), 0.0 if np.pi / 2 - angle < 1e-12 else angle))
    return best[1]


def segments_of(geometry) -> np.ndarray:
    """n x 2 x 2 segments of nested points."""
    out = [np.stack([r[:-1], r[1:]], 1) for part in geometry for ring in part if len(r := ring_array(ring)) > 1]
    return np.concatenate(out) if out else np.zeros((0, 2, 2))


def ring_array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _point_segment(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """All distances between points (n) and segments (m)."""
    a, d = s[None, :, 0], (s[:, 1] - s[:, 0])[None]
    t = np.clip(((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(2), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(p[:, None] - (a + t[..., None] * d), 2, 0))


def inside(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a polygon's segments."""
    (x1, y1), (x2, y2) = segments[:, 0].T, segments[:, 1].T
    px, py = points[:, 0, None], points[:, 1, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = ((y1 > py) != (y2 > py)) & (px < x1 + (x2 - x1) * (py - y1) / (y2 - y1))
    return hit.sum(1) % 2 == 1


#: Pairs of a box and a segment that are tested at once.
BOX_PAIRS = 1 << 20


def meet_open_boxes(segments: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """Whether the closed polygon of these segments and each open box of a row have a point in common."""
    segments = segments[(segments[:, :, 1].min(1) <= y1) & (segments[:, :, 1].max(1) >= y0)]
    if not len(segments):
        return np.zeros(len(x0), bool)
    some = max(1, BOX_PAIRS // len(segments))
    start, step = segments[:, 0], segments[:, 1] - segments[:, 0]

    def span(axis: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, d = start[:, axis], step[:, axis]
        still = np.where((p > lo) & (p < hi), np.inf, -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (lo - p) / d, (hi - p) / d
        return np.where(d == 0, -still, np.minimum(a, b)), np.where(d == 0, still, np.maximum(a, b))

    def met(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        (ax, bx), (ay, by) = span(0, x0[:, None], x1[:, None]), span(1, y0, y1)
        lo, hi = np.maximum(ax, ay), np.minimum(bx, by)
        crosses = (lo < hi) & (np.maximum(lo, 0) <= np.minimum(hi, 1)) & (lo < 1) & (hi > 0)
        return crosses.any(1) | inside(np.stack([(x0 + x1) / 2, np.full(len(x0), (y0 + y1) / 2)], 1), segments)

    return np.concatenate([met(x0[k : k + some], x1[k : k + some]) for k in range(0, len(x0), some)])


def polygon_distance(a, b) -> float:
    """Shortest distance of two geometries, 0 where they meet."""
    sa, sb = segments_of(a), segments_of(b)
    if not len(sa) or not len(sb):
        return float("nan")
    if inside(_first_points(a), sb).any() or inside(_first_points(b), sa).any() or _any_cross(sa, sb):
        return 0.0
    return float(min(_point_segment(sa[:, 0], sb).min(), _point_segment(sb[:, 0], sa).min()))


def _first_points(geometry) -> np.ndarray:
    """A point of each part: parts may lie apart."""
    return np.array([(part[0][0]["x"], part[0][0]["y"]) for part in geometry if len(part) and len(part[0])], float).reshape(-1, 2)


def _any_cross(sa: np.ndarray, sb: np.ndarray) -> bool:
    def side(p, q, r):
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    a0, a1, b0, b1 = sa[:, None, 0], sa[:, None, 1], sb[None, :, 0], sb[None, :, 1]
    return bool(((side(a0, a1, b0) * side(a0, a1, b1) < 0) & (side(b0, b1, a0) * side(b0, b1, a1) < 0)).any())


def upright_boxes(geometry: pa.ListArray) -> np.ndarray:
    """Bounds (x0, y0, x1, y1) of each geometry that is one upright rectangle, else NaN."""
    out = np.full((len(geometry), 4), np.nan)
    parts = geometry.flatten()
    rings = parts.flatten()
    points = rings.flatten()
    of_part, of_ring = (pc.list_parent_indices(v).to_numpy() for v in (geometry, parts))
    owner = of_part[of_ring]
    size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy()
    one = (np.bincount(of_part, minlength=len(out)) == 1)[owner] & (np.bincount(owner, minlength=len(out)) == 1)[owner] & (size == 5)
    at = (np.cumsum(size) - size)[one]
    if not len(at):
        return out
    x, y = (c.to_numpy(zero_copy_only=False).astype(float)[at[:, None] + np.arange(5)] for c in points.flatten())
    dx, dy = np.diff(x) != 0, np.diff(y) != 0
    # sides go along the axes in turn, and the fourth ends at the start
    turns = (dx != dy).all(1) & (dx[:, :1] != dx[:, 1:2])[:, 0] & (dx[:, 0] == dx[:, 2]) & (dx[:, 1] == dx[:, 3]) & (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4])
    turns &= np.isfinite(x).all(1) & np.isfinite(y).all(1)
    box = np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1)
    out[owner[one][turns]] = box[turns]
    return out


def distances(geometry: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``polygon_distance`` of pairs; that of upright rectangles is told from their bounds."""
    box = upright_boxes(geometry)
    a, b = box[i], box[j]
    gap = lambda k: np.maximum(0, np.maximum(a[:, k] - b[:, k + 2], b[:, k] - a[:, k + 2]))
    out = np.hypot(gap(0), gap(1))
    for k in np.flatnonzero(np.isnan(a[:, 0]) | np.isnan(b[:, 0])):
        out[k] = polygon_distance(geometry[int(i[k])].as_py() or [], geometry[int(j[k])].as_py() or [])
    return out


#: Decimals to which points of an overlay are brought, and how far beside an edge its sides are probed.
SNAP, BESIDE = 7, 1e-5


def split_segments(segments: np.ndarray) -> np.ndarray:
    """Distinct pieces (undirected) of segments, cut wherever they meet."""
    if not len(segments):
        return segments
    out = []
    lo, hi = segments.min(1) - BESIDE, segments.max(1) + BESIDE
    for s, a, b in zip(segments, lo, hi, strict=True):
        near = segments[((lo <= b) & (hi >= a)).all(1)]
        p, d = s[0], s[1] - s[0]
        size = float(d @ d)
        if size == 0:
            continue
        e = near[:, 1] - near[:, 0]
        turn = d[0] * e[:, 1] - d[1] * e[:, 0]
        apart = near[:, 0] - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross2(apart, e) / turn, cross2(apart, d) / turn
        slack = BESIDE / np.sqrt(size)
        meets = (np.abs(turn) > 1e-12 * size) & (t > -slack) & (t < 1 + slack) & (u >= -1e-9) & (u <= 1 + 1e-9)
        ends = near.reshape(-1, 2)
        along = (ends - p) @ d / size
        on = np.abs(cross2(d[None], ends - p)) <= 10.0**-SNAP * np.sqrt(size)
        at = np.unique(np.clip(np.concatenate([[0, 1], t[meets], along[on & (along > 0) & (along < 1)]]), 0, 1))
        points = np.round(p + at[:, None] * d, SNAP) + 0.0
        out.append(np.stack([points[:-1], points[1:]], 1))
    pieces = np.concatenate(out)
    pieces = pieces[(pieces[:, 0] != pieces[:, 1]).any(1)]
    swap = (pieces[:, 0, 0] > pieces[:, 1, 0]) | ((pieces[:, 0, 0] == pieces[:, 1, 0]) & (pieces[:, 0, 1] > pieces[:, 1, 1]))
    pieces[swap] = pieces[swap][:, ::-1]
    return np.unique(pieces.reshape(-1, 4), axis=0).reshape(-1, 2, 2)


def area_within(segments: np.ndarray, within):
    """The geometry of all points that ``within`` accepts, whose border runs along
    the segments; None if it has no area.  Each piece of a segment is kept where the
    points just beside it differ, directed with the area to its left, and pieces are
    chained to rings with the sharpest left turns."""
    pieces = split_segments(segments)
    if not len(pieces):
        return None
    d = pieces[:, 1] - pieces[:, 0]
    unit = d / np.hypot(*d.T)[:, None]
    left = np.stack([-unit[:, 1], unit[:, 0]], 1) * np.minimum(BESIDE, np.hypot(*d.T) / 4)[:, None]
    middle = pieces.mean(1)
    a, b = within(middle + left), within(middle - left)
    kept = np.concatenate([pieces[a & ~b], pieces[b & ~a][:, ::-1]])
    leaving: dict[tuple, list[tuple]] = {}
    for p, q in kept.tolist():
        leaving.setdefault(tuple(p), []).append(tuple(q))
    rings = []
    while leaving:
        start = at = min(leaving)
        ring, came = [start], None
        while True:
            choices = leaving[at]
            pick = choices[0] if came is None or len(choices) == 1 else max(choices, key=lambda q: _left_turn(came, at, q))
            choices.remove(pick)
            if not choices:
                del leaving[at]
            came, at = at, pick
            ring.append(at)
            if at == start or at not in leaving:
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(straightened(np.array(ring)))
    outer = [r for r in rings if signed_area(r) > 10.0**-SNAP]
    parts = [[r] for r in sorted(outer, key=signed_area)]
    for hole in (r for r in rings if signed_area(r) < -(10.0**-SNAP)):
        p = (hole[:1] + hole[1:2]) / 2
        owner = next((part for part in parts if inside(p, np.stack([part[0][:-1], part[0][1:]], 1))[0]), None)
        if owner is not None:
            owner.append(hole)
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts] or None


def _left_turn(came: tuple, at: tuple, to: tuple) -> float:
    a = np.arctan2(to[1] - at[1], to[0] - at[0]) - np.arctan2(at[1] - came[1], at[0] - came[0])
    turn = (a + np.pi) % (2 * np.pi) - np.pi
    return -np.pi if turn >= np.pi - 1e-12 else float(turn)


def signed_area(ring: np.ndarray) -> float:
    """Of a closed ring: positive if counter-clockwise."""
    return float(cross2(ring[:-1] - ring[0], ring[1:] - ring[0]).sum()) / 2


def straightened(ring: np.ndarray) -> np.ndarray:
    """A closed ring without the points where it goes straight on."""
    p = ring[:-1]
    d, e = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    bent = np.abs(cross2(d, e)) > 1e-9 * np.hypot(*d.T) * np.hypot(*e.T)
    p = p[bent] if bent.sum() > 2 else p
    return np.concatenate([p, p[:1]])


#: Rectangles overlap by an overlay where they share less than this in one direction.
SLIM = 1e-3


def box_of(geometry) -> tuple[float, float, float, float] | None:
    """Bounds of a geometry that is one upright rectangle, else None."""
    if len(geometry) != 1 or len(geometry[0]) != 1 or len(geometry[0][0]) != 5:
        return None
    ring = [(p["x"], p["y"]) for p in geometry[0][0]]
    xs, ys = {x for x, _ in ring}, {y for _, y in ring}
    if ring[0] != ring[4] or None in xs | ys or len(xs) != 2 or len(ys) != 2 or len(set(ring)) != 4:
        return None
    upright = all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:], strict=False))
    box = min(xs), min(ys), max(xs), max(ys)
    return box if upright and np.isfinite(box).all() else None


def clip_geometry(geometry, clip):
    """Intersection of any two polygon geometries, with their holes and parts; None without area.
    That of two upright rectangles is their common one, in the form that the overlay gives it."""
    if (p := box_of(geometry)) and (q := box_of(clip)):
        x0, y0, x1, y1 = max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])
        if x1 <= x0 or y1 <= y0:
            return None
        if min(x1 - x0, y1 - y0) >= SLIM:
            x0, y0, x1, y1 = (np.round((x0, y0, x1, y1), SNAP) + 0.0).tolist()
            return [[[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]]
    return overlaid(geometry, clip)


def overlaid(geometry, clip):
    """The intersection by an overlay."""
    a, b = segments_of(geometry), segments_of(clip)
    if not len(a) or not len(b):
        return None
    lo, hi = a.min((0, 1)) - 1, a.max((0, 1)) + 1
    near = b[((b.min(1) <= hi) & (b.max(1) >= lo)).all(1)]
    return area_within(np.concatenate([a, near]), lambda p: inside(p, a) & inside(p, b))


def dissolve(geometries: list):
    """Union of polygon geometries, taken two by two so that each overlay stays small; None without area."""
    todo = [g for g in geometries if g is not None and len(g)]
    while len(todo) > 1:
        pairs = [todo[i : i + 2] for i in range(0, len(todo), 2)]
        todo = [g for pair in pairs if (g := pair[0] if len(pair) == 1 else _union(*pair)) is not None]
    return todo[0] if todo else None


def _union(a, b):
    sa, sb = segments_of(a), segments_of(b)
    return area_within(np.concatenate([sa, sb]), lambda p: inside(p, sa) | inside(p, sb))


def repair_geometry(geometry):
    """A valid geometry of the area that the rings enclose by the even-odd rule: repeated
    points, spikes and crossings of a ring with itself go; None without area."""
    rings = [[repair_ring(ring_array(r)) for r in part if len(r)] for part in geometry]
    segments = [np.stack([r[:-1], r[1:]], 1) for part in rings for r in part if len(r) > 3]
    if not segments:
        return None
    own = np.concatenate(segments)
    return area_within(own, lambda p: inside(p, own)) if np.isfinite(own).all() else None


def repair_ring(ring: np.ndarray) -> np.ndarray:
    """Closed ring without repeated points or spikes; the simple case of repair."""
    keep = [ring[0]]
    for p in ring[1:]:
        if not np.array_equal(p, keep[-1]):
            keep.append(p)
    i = 1
    while i < len(keep) - 1 and len(keep) > 3:
        if np.array_equal(keep[i - 1], keep[i + 1]):
            del keep[i : i + 2]
            i = max(1, i - 1)
        else:
            i += 1
    if not np.array_equal(keep[0], keep[-1]):
        keep.append(keep[0])
    return np.array(keep)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker."""
    return simplify_all([points], tolerance)[0]


def simplify_all(lines: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """Douglas-Peucker of many lines, their parts of a level at once."""
    if not lines:
        return []
    size = np.array([len(x) for x in lines])
    points, last = np.concatenate(lines), np.cumsum(size) - 1
    a, b = last - size + 1, last
    keep = np.zeros(len(points), bool)
    keep[np.r_[a, b]] = True
    starts = a
    while True:
        open_ = b - a >= 2
        a, b = a[open_], b[open_]
        if not len(a):
            return [x[k] for x, k in zip(lines, np.split(keep, starts[1:]), strict=True)]
        n = b - a - 1
        at = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        i = np.arange(n.sum()) - at[of] + a[of] + 1
        start, d = points[a][of], (points[b] - points[a])[of]
        t = np.clip(((points[i] - start) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        far = np.hypot(*(points[i] - (start + t[:, None] * d)).T)
        top = np.maximum.reduceat(far, at)
        hit = np.flatnonzero(far == top[of])
        # the first of the farthest
        k = i[hit[np.unique(of[hit], return_index=True)[1]]]
        split = top > tolerance
        k, a, b = k[split], a[split], b[split]
        keep[k] = True
        a, b = np.r_[a, k], np.r_[k, b]


def grow(labels: np.ndarray, mask: np.ndarray, rounds: int) -> np.ndarray:
    """Labels after growth: each round a free cell takes the largest label among
    its eight neighbours as they were."""
    out = np.where(mask, labels, 0).astype(labels.dtype)
    for _ in range(rounds):
        # the largest of a row's three, then of three rows'
        wide = np.pad(out, 1)
        best = np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
        best = np.maximum(np.maximum(best[:-2], best[1:-1]), best[2:])
        new = (out == 0) & mask & (best > 0)
        if not new.any():
            break
        out = np.where(new, best, out)
    return out


def components4(labels: np.ndarray) -> np.ndarray:
    """Number (from 1) of the 4-connected component of equal positive labels, row by
    row: runs of a row are joined with those that they touch in the row above."""
    height, width = labels.shape
    out = np.zeros(labels.shape, np.int64)
    if not (labels > 0).any():
        return out
    flat = labels.ravel()
    column = np.arange(flat.size) % width
    new = np.ones(flat.size, bool)
    new[1:] = (flat[1:] != flat[:-1]) | (column[1:] == 0)
    run = np.cumsum(new) - 1
    root = np.arange(run[-1] + 1)
    above, below = run[: flat.size - width], run[width:]
    touch = (flat[width:] == flat[: flat.size - width]) & (flat[width:] > 0)
    touch[1:] &= (above[1:] != above[:-1]) | (below[1:] != below[:-1])
    a, b = above[touch], below[touch]
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = root[run]
    own[flat <= 0] = -1
    # numbered by first cell, which is the root's
    kept, number = np.unique(own, return_inverse=True)
    return (number + (kept[0] >= 0)).reshape(labels.shape)


def components_at(parts: np.ndarray) -> list[tuple[int, tuple[slice, slice]]]:
    """(number, place) of each component: the smallest window that holds it, all in one pass."""
    rows, cols = np.nonzero(parts)
    if not len(rows):
        return []
    number = parts[rows, cols]
    n = int(number.max()) + 1
    lo, hi = np.full((2, n), max(parts.shape)), np.full((2, n), -1)
    for k, place in enumerate((rows, cols)):
        np.minimum.at(lo[k], number, place)
        np.maximum.at(hi[k], number, place)
    return [(k, (slice(lo[0, k], hi[0, k] + 1), slice(lo[1, k], hi[1, k] + 1))) for k in range(1, n) if hi[0, k] >= 0]


def crop(shape: np.ndarray) -> tuple[slice, slice]:
    """The part of a mask that holds all its true cells."""
    rows, cols = np.flatnonzero(shape.any(1)), np.flatnonzero(shape.any(0))
    return slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)


def filled(shape: np.ndarray) -> np.ndarray:
    """A component with its holes: all that the border can't reach by 4-steps outside it."""
    outside = components4(np.pad(~shape, 1, constant_values=True).astype(np.int64))
    return outside[1:-1, 1:-1] != outside[0, 0]


def trace_exterior(cells: np.ndarray) -> list[tuple[int, int]]:
    """Exterior ring (col, row corners, closed) of one 4-connected component of cells."""
    part = crop(cells)
    up, left = part[0].start, part[1].start
    solid = np.pad(filled(cells[part]), 1)
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in zip(*np.nonzero(solid), strict=True):
        for hit, a, b in (
            (solid[r - 1, c], (c, r), (c + 1, r)),
            (solid[r, c + 1], (c + 1, r), (c + 1, r + 1)),
            (solid[r + 1, c], (c + 1, r + 1), (c, r + 1)),
            (solid[r, c - 1], (c, r + 1), (c, r)),
        ):
            if not hit:
                nxt.setdefault(a, []).append(b)
    start = min(nxt)
    ring, at, came = [start], start, None
    while True:
        choices = nxt[at]
        # where two corners touch, turn so that the ring stays one
        pick = choices[0] if len(choices) == 1 or came is None else max(choices, key=lambda b: _turn(came, at, b))
        choices.remove(pick)
        came, at = at, pick
        if len(ring) > 1 and _turn(ring[-2], ring[-1], at) == 0:
            ring[-1] = at
        else:
            ring.append(at)
        if at == start:
            break
    return [(a - 1 + left, b - 1 + up) for a, b in ring]


def _turn(a, b, c) -> int:
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def thin(mask: np.ndarray) -> np.ndarray:
    """One-cell-wide skeleton by two alternating peels (Zhang-Suen)."""
    m = np.pad(mask.astype(np.uint8), 1)
    flat, width = m.reshape(-1), m.shape[1]
    around = (-width, 1 - width, 1, width + 1, width, width - 1, -1, -width - 1)
    at = np.flatnonzero(flat)
    while True:
        changed = False
        for step in (0, 1):
            p = [flat[at + o] for o in around]
            n = sum(p)
            turns = sum((a < b).view(np.uint8) for a, b in zip(p, p[1:] + p[:1], strict=True))
            one = p[0] * p[2] * (p[4] if step == 0 else p[6])
            two = (p[2] if step == 0 else p[0]) * p[4] * p[6]
            drop = (n >= 2) & (n <= 6) & (turns == 1) & (one == 0) & (two == 0)
            if drop.any():
                flat[at[drop]] = 0
                at = at[~drop]
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def trace_lines(mask: np.ndarray) -> list[np.ndarray]:
    """Chains of cells (row, col) of a thin mask: starts row by row, each step to
    the first unvisited neighbour; single cells are dropped."""
    wide = np.pad(mask, 1)
    width, out = wide.shape[1], []
    free = bytearray(wide.astype(np.uint8).tobytes())
    steps = (-width - 1, -width, 1 - width, -1, 1, width - 1, width, width + 1)
    for start in np.flatnonzero(wide).tolist():
        if not free[start]:
            continue
        free[start] = 0
        chain, at = [start], start
        while True:
            for step in steps:
                if free[at + step]:
                    break
            else:
                break
            at += step
            free[at] = 0
            chain.append(at)
        if len(chain) > 1:
            out.append(np.stack(np.divmod(chain, width), 1) - 1)
    return out


def merge_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined at end points where exactly two of them meet, each end looked at once."""
    lines = [np.asarray(x) for x in lines]
    ends: dict[tuple, list[int]] = {}
    for i, x in enumerate(lines):
        for side in (0, -1):
            ends.setdefault(tuple(x[side]), []).append(i)
    left, out = dict(enumerate(lines)), []
    while left:
        i, line = next(iter(left.items()))
        del left[i]
        for side in (-1, 0):
            while len(at := ends[tuple(line[side])]) == 2 and (j := next((k for k in at if k in left), None)) is not None:
                other = left.pop(j)
                if side == -1:
                    line = np.concatenate([line, (other if tuple(other[0]) == tuple(line[-1]) else other[::-1])[1:]])
                else:
                    line = np.concatenate([(other if tuple(other[-1]) == tuple(line[0]) else other[::-1])[:-1], line])
        out.append(line)
    return out
