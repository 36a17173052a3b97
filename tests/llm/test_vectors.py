"""Whitening and hard negatives against plain numpy and row loops."""

import math

import numpy as np
import pytest

from tidemark.llm import hardneg, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, slab int"


def table(spark, rows):
    """Rows (vec_id, vector, label), with columns of clashing names."""
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def points(n, d, seed=0, classes=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(c)) for c in rng.standard_normal(d) * scale], int(rng.integers(classes))) for i in range(n)]


BROKEN = [(9001, None, 1), (9002, [1.0, None, 0.0], 1), (9003, [1.0, float("nan"), 0.0], 1), (9004, [1.0, float("inf"), 0.0], 0), (9005, [1.0], 1), (9006, [], 1)]


def whole(rows):
    """(vec_id, x, label) of the rows that take part in whitening."""
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v], k) for i, v, k in rows if v and len(v) > 1 and all(c is not None and math.isfinite(c) for c in v)]


def test_spectrum_equals_numpy():
    rng = np.random.default_rng(3)
    for a in (np.diag([3.0, 3.0, 1.0, 1.0, 0.0]), np.cov(rng.standard_normal((24, 200))), np.cov((rng.standard_normal((30, 4)) @ rng.standard_normal((4, 12))).T), np.zeros((3, 3)), np.diag(np.logspace(0, -9, 16))):
        w, z = whitening.spectrum(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.allclose(w, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size)
        assert np.linalg.norm(z.T @ z - np.eye(len(a))) < 1e-12
        assert np.linalg.norm(a @ z - z * w) < 1e-12 * size


def test_polar_factor_is_the_sign_of_the_matrix():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    a = (q * np.array([5, 1, 1e-6, 3e-9, 2, 1, -1, -1e-5, -4, -1e-8, -2, -3.0])) @ q.T
    u = whitening.polar(a)
    assert np.allclose(u, (q * np.array([1] * 6 + [-1] * 6)) @ q.T, atol=1e-6)
    assert np.linalg.norm(u @ u - np.eye(12)) < 1e-12


@pytest.mark.parametrize("extra", [[], BROKEN])
def test_whitening_equals_numpy(spark, extra):
    rows = [(i, v[:3], k) for i, v, k in points(300, 3, scale=0.4)] + extra
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # copies of one vector count once in the fit
    got = whitening.op11(table(spark, rows)).collect()
    x = {i: v for i, v, _ in whole(rows)}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    n, s = len(fit), fit.sum(axis=0)
    w, z = np.linalg.eigh(np.cov(fit.T, bias=True))
    w, z = w[::-1], z[:, ::-1]
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in x for c in (1, 2, 3)}
    sign = {}
    for r in got:
        v, c = x[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)) == int(r.deviation_digits)
        want = (np.array(v) - s / n) @ z[:, c] / np.sqrt(w[c])
        if abs(want) > 1e-6:
            assert sign.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 * max(1, abs(want))
        assert abs(r.explained - w[c] / w.sum()) < 1e-10 and r.identity_error < 1e-10


def test_whitening_of_few_and_of_huge_numbers(spark):
    assert whitening.op11(table(spark, points(5, 3)).limit(0)).count() == 0
    assert whitening.op11(table(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])).count() == 0
    got = whitening.op11(table(spark, [(1, [1e15, 0.0], 0), (2, [-1e15, 1.0], 0), (3, [2e15, 7.0], None), (None, [0.0, 0.0], 1)])).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, None} and all(r.deviation is None and int(r.deviation_digits) > 1 << 63 for r in got if r.vec_id == 3)


def test_moments_are_exact_beyond_a_double(spark):
    big = [(1, [1e12, 3.0]), (2, [-7e11, 5.0]), (3, [3e12, -1.0])]
    m = whitening.Moments.of(vectors.quantised(spark.createDataFrame(big, "vec_id long, embedding array<double>"), "embedding", "vec_id"))
    x = np.array([[math.floor(256 * c) for c in v] for _, v in big], object)
    assert m.n == 3 and list(m.sums) == list(x.sum(axis=0)) and (m.products == x.T @ x).all()


def brute(rows, every=100):
    one = {}
    for i, v, k in rows:
        if i is None or k is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        e = ((k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * float(np.float32(c))) for c in v])
        one[i] = min(one.get(i, e), e)
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for a, (label, x) in one.items():
        if a % every:
            continue
        scored = sorted((-dot(x, v), b, k) for b, (k, v) in one.items() if b != a)
        for s, b, _ in [t for t in scored if t[2] == label][: hardneg.PLACES]:
            fit = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][: hardneg.PLACES]
            out += [(a, b, r, c, -s, -t) for r, (t, c, _) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_tree_visits_few_leaves_and_finds_the_best():
    rng = np.random.default_rng(5)
    x, ids = np.rint(rng.standard_normal((4000, 3)) * 200), np.arange(4000)
    tree, seen = hardneg.Tree(ids, x, leaf=32, fanout=4), []
    assert sorted(int(i) for r, _ in tree.rows for i in r) == list(range(4000)) and max(len(r) for r, _ in tree.rows) <= 32
    tree.rows = type("Counted", (list,), {"__getitem__": lambda self, k: seen.append(k) or list.__getitem__(self, k)})(tree.rows)
    anchor = x[17]
    best = hardneg.Best()
    hardneg.search([(tree, *tree.intervals(anchor[None]))], 0, anchor, 17, [best])
    want = sorted((-int(s), int(i)) for i, s in zip(ids, x @ anchor, strict=True) if i != 17)[: hardneg.PLACES]
    assert best.found == want and len(seen) < len(tree.rows) / 4


def test_hard_negatives_equal_row_loop(spark):
    rows = [(i * 4, v, k) for i, v, k in points(700, 4, seed=6, scale=0.5)]
    rows += [(5001 + i, rows[25][1], k) for i in range(60) for k in (rows[25][2],)]  # a hot vector with an anchor among it
    rows += [(7001 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(40)] + [(7100, [0.5, 0.5, 0.5, 0.5], 0)]
    rows += [(8000, None, 1), (8100, [1.0, None, 0.0, 0.0], 1), (8200, [1.0, float("nan"), 0.0, 0.0], 1), (8300, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1), (400, rows[3][1], 2), (rows[5][0], rows[5][1], rows[5][2])]
    want = brute(rows)
    assert len(want) > 300
    assert found(hardneg.mine(table(spark, rows))) == want
    # many slabs and blocks
    assert found(hardneg.mine(table(spark, rows), per_slab=90, per_block=3)) == want


def test_hard_negatives_of_few_rows_and_huge_numbers(spark):
    assert hardneg.op13(table(spark, points(5, 3)).limit(0)).count() == 0
    assert hardneg.op13(table(spark, [(100, [1.0, 0.0], 1), (101, [1.0, 0.0], 1)])).count() == 0
    big = [(100, [1e6, 1.0], 1), (101, [9e5, 1.0], 1), (102, [8.9e5, 2.0], 2), (103, [-1e6, 0.0], 2), (200, [-1.0, 0.0], 3), (201, [1.0, 0.0], 3), (202, [0.0, 0.0], 4)]
    assert found(hardneg.op13(table(spark, big))) == brute(big)
