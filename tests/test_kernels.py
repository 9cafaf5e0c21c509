import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.functions import kernels as K

SQUARE = [[[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]]]


def moved(g, dx, dy):
    return [[[{"x": p["x"] + dx, "y": p["y"] + dy} for p in r] for r in part] for part in g]


@given(st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_growth_is_ascending_overwrite(seed):
    rng = np.random.default_rng(seed)
    labels, mask = np.where(rng.random((7, 9)) < 0.1, rng.integers(1, 6, (7, 9)), 0), rng.random((7, 9)) < 0.8
    labels = np.where(mask, labels, 0)
    want = labels.copy()
    for _ in range(5):
        free, new = (want == 0) & mask, want.copy()
        for label in np.unique(want[want > 0]):
            near = np.zeros_like(mask)
            for r, c in zip(*np.nonzero(want == label), strict=True):
                near[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2] = True
            new[near & free] = label
        want = new
    assert np.array_equal(K.grow(labels, mask, 5), want)


def test_distances():
    assert K.polygon_distance(SQUARE, moved(SQUARE, 7, 0)) == 3
    assert K.polygon_distance(SQUARE, moved(SQUARE, 7, 8)) == 5
    assert K.polygon_distance(SQUARE, moved(SQUARE, 4, 0)) == 0  # they touch
    assert K.polygon_distance(SQUARE, moved(SQUARE, 1, 1)) == 0
    inner = [[[{"x": p["x"] / 4 + 1, "y": p["y"] / 4 + 1} for p in SQUARE[0][0]]]]
    assert K.polygon_distance(SQUARE, inner) == 0


def test_clip_and_hull():
    got = K.clip_geometry(moved(SQUARE, 2, 2), SQUARE)
    assert K.polygon_area(K.ring_array(got[0][0])[:-1]) == 4
    assert K.clip_geometry(moved(SQUARE, 9, 9), SQUARE) is None
    star = np.array([(0, 0), (2, 1), (4, 0), (3, 2), (4, 4), (2, 3), (0, 4), (1, 2)], float)
    assert K.polygon_area(K.convex_hull(star)) == 16
    assert abs(K.orientation(np.array([(0, 0), (4, 4), (3, 5), (-1, 1)], float)) - np.pi / 4) < 1e-9


def test_rings_and_holes():
    cells = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert K.filled(cells).all()
    assert K.polygon_area(np.array(K.trace_exterior(cells), float)[:-1]) == 9
    assert K.components4(np.array([[1, 0, 1], [1, 2, 2]])).tolist() == [[1, 0, 2], [1, 3, 3]]


def test_lines():
    mask = np.zeros((5, 7), bool)
    mask[2, 1:6] = True
    (line,) = K.trace_lines(mask)
    assert K.simplify(line.astype(float), 0.1).tolist() == [[2, 1], [2, 5]]
    assert K.thin(np.ones((3, 9), bool)).sum() < 12
    merged = K.merge_lines([np.array([(0, 0), (0, 1)]), np.array([(0, 3), (0, 1)])])
    assert [x.tolist() for x in merged] == [[[0, 0], [0, 1], [0, 3]]] or [x[::-1].tolist() for x in merged] == [[[0, 0], [0, 1], [0, 3]]]


def shape(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] for r in rings]]


def area_of(geometry):
    return sum(abs(K.signed_area(K.ring_array(r))) * (1 if k == 0 else -1) for part in geometry or [] for k, r in enumerate(part))


def cells_in(geometry, n):
    centres = np.stack(np.meshgrid(np.arange(n) + 0.5, np.arange(n) + 0.5), -1).reshape(-1, 2)
    return K.inside(centres, K.segments_of(geometry))


U = shape([(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)])
RING = shape([(1, 1), (9, 1), (9, 9), (1, 9)], [(3, 3), (7, 3), (7, 7), (3, 7)])


def test_clip_of_rectangles_needs_no_overlay(monkeypatch):
    rng, overlay = np.random.default_rng(4), K.overlaid
    box = lambda a, b, c, d, k, way: shape(np.roll([(a, b), (c, b), (c, d), (a, d)], k, 0)[::way].tolist())
    for _ in range(200):
        p, q = (np.sort(rng.choice([rng.integers(-5, 6, 4), rng.uniform(-5, 5, 4)]).reshape(2, 2), 0) for _ in range(2))
        if (p[0] < p[1]).all() and (q[0] < q[1]).all():
            a, b = (box(*r[0], *r[1], int(rng.integers(0, 4)), int(rng.choice([1, -1]))) for r in (p, q))
            assert K.clip_geometry(a, b) == overlay(a, b)
    monkeypatch.setattr(K, "overlaid", None)
    assert area_of(K.clip_geometry(box(0, 0, 2, 2, 0, 1), box(1, 1, 9, 9, 2, -1))) == 1 and K.clip_geometry(box(0, 0, 2, 2, 0, 1), box(2, 0, 3, 3, 0, 1)) is None
    bow = shape([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert K.box_of(bow) is None and K.box_of(shape([(0, 0), (2, 0), (1, 2), (0, 2)])) is None


def test_clip_to_concave_holed_and_multi_part():
    box = shape([(0, 4), (10, 4), (10, 10), (0, 10)])
    got = K.clip_geometry(box, U)
    assert len(got) == 2 and area_of(got) == 36
    assert area_of(K.clip_geometry(box, RING)) == area_of(K.clip_geometry(RING, box)) == 40 - 12
    assert area_of(K.clip_geometry(RING, U)) == (cells_in(RING, 10) & cells_in(U, 10)).sum()
    two = shape([(0, 8), (2, 8), (2, 9), (0, 9)]) + shape([(20, 20), (21, 20), (21, 21), (20, 21)])
    assert area_of(K.clip_geometry(two, U)) == 2 and K.clip_geometry(two[1:], U) is None
    assert len(K.clip_geometry(RING, shape([(0, 0), (10, 0), (10, 10), (0, 10)]))[0]) == 2  # the hole stays


def test_distance_looks_at_every_part():
    far_then_inside = shape([(50, 50), (51, 50), (51, 51), (50, 51)]) + shape([(1, 1), (2, 1), (2, 2), (1, 2)])
    assert K.polygon_distance(far_then_inside, U) == 0 == K.polygon_distance(U, far_then_inside)
    assert K.polygon_distance(shape([(4, 5), (6, 5), (6, 6), (4, 6)]), U) == 1
    assert K.polygon_distance(shape([(4, 4), (6, 4), (6, 6), (4, 6)]), RING) == 1  # in its hole


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_overlays_like_cells(seed):
    rng = np.random.default_rng(seed)

    def stairs():
        # a region under random steps: concave, with many edges on common lines
        h = rng.integers(1, 9, 8)
        ring = [(0, 0), (8, 0)]
        for i in range(7, -1, -1):
            ring += [(i + 1, h[i]), (i, h[i])]
        return shape([p for k, p in enumerate(ring) if p != ring[k - 1]])

    a, b = moved(stairs(), 0, 0), moved(stairs(), int(rng.integers(0, 5)), int(rng.integers(0, 5)))
    x, y = cells_in(a, 14), cells_in(b, 14)
    assert abs(area_of(K.clip_geometry(a, b)) - (x & y).sum()) < 1e-6
    assert abs(area_of(K.dissolve([a, b])) - (x | y).sum()) < 1e-6


def test_repair_and_union():
    bow = shape([(0, 0), (4, 4), (4, 0), (0, 4)])
    fixed = K.repair_geometry(bow)
    assert len(fixed) == 2 and area_of(fixed) == 8
    spike = shape([(0, 0), (4, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)])
    assert area_of(K.repair_geometry(spike)) == 16 and K.repair_geometry(shape([(0, 0), (1, 1)])) is None
    four = [moved(SQUARE, 4 * i, 4 * j) for i in range(2) for j in range(2)]
    assert [len(r) for part in K.dissolve(four) for r in part] == [5] and area_of(K.dissolve(four)) == 64
