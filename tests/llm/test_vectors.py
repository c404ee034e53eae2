"""Vector near-duplicates and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from threatlake.llm import cosine, curves

SCHEMA = "vec_id bigint, embedding array<float>, label int, pos string, v int, code string"
BAD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [math.nan] * 8, 1), (904, [math.inf] + [1.0] * 7, 1),
       (905, [1.0] * 8, None), (906, [], 1), (907, [1.0, 2.0], 1)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "p", 0, "c") for i, v, l in rows], SCHEMA)


def make(seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8), i % 3) for i in range(200)]
    hot = rng.normal(size=8)
    rows += [(300 + i, hot + rng.normal(size=8) * 0.25, 1) for i in range(120)]
    rows += [(500 + i, rows[0][1] * (i + 1), 0) for i in range(5)] + [(600, rows[0][1], 0), (600, rows[0][1], 0)]
    return [(i, np.float32(v).tolist(), l) for i, v, l in rows]


@pytest.mark.parametrize(("block", "bits"), [(16, None), (2048, None), (2048, 13)])
def test_links_and_components(spark, block, bits):
    rows = make() + BAD
    got = cosine.similar_vectors(table(spark, rows), block=block, bits=bits).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), l) for i, v, l in rows if i < 900]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([l for _, _, l in good])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    up = list(range(len(good)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(close)):
        up[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted((good[i][0], int(close[i].sum()), min(good[j][0] for j in range(len(good)) if root(j) == root(i))) for i in range(len(good)))
    want = sorted(want + [(i, 0, i) for i, _, _ in BAD])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert cosine.similar_vectors(table(spark, [])).count() == 0


def test_tables_reach_the_wanted_recall():
    same = 1 - math.acos(0.93) / math.pi
    n = cosine.tables_needed(0.93, 10, 1e-4)
    assert (1 - same**10) ** n <= 1e-4 < (1 - same**10) ** (n - 1)


def test_codes_grow_with_the_rows():
    bits = [cosine.bits_needed(n) for n in (0, 1, 50_000, 10**6, 10**9, 10**12)]
    assert bits == [10, 10, 10, 14, 24, 30]
    for n in (10**6, 10**8, 10**10):  # vectors met in all tables: at most the square root of the rows times a constant
        b = cosine.bits_needed(n)
        assert n / 2**b <= cosine.CROWD and cosine.tables_needed(0.93, b) * n / 2**b < 64 * n**0.5


def test_hilbert_keys_are_a_walk_over_all_cells():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = curves.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("chunk", [8, 32_768])
def test_nearest(spark, chunk):
    rows = make(6) + BAD
    rows += [(1000 + i, rows[40][1], 0) for i in range(30)]  # ties
    got = curves.nearest(table(spark, rows), k=20, chunk=chunk).collect()
    good = {i: np.array(v, float) for i, v, _ in rows if i not in {b[0] for b in BAD if b[0] != 905}}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert all(abs(r.score - float(good[r.vec_id] @ good[q])) < 1e-9 for r in mine)
        assert [(r.vec_id) for r in mine] == [r.vec_id for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))]
        best = sorted((i for i in good if i != q), key=lambda i: (-round(float(good[i] @ good[q]), 9), i))[:20]
        hits += len(set(best) & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.9
    assert curves.nearest(table(spark, [])).count() == 0
    assert {r.vec_id for r in curves.nearest(table(spark, rows[:3] + [(20, rows[5][1], 1)])).collect()} <= {0, 1, 2, 20}


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("chunk", [8, 32_768])
def test_repeated_ids_take_one_place(spark, chunk):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8), 0) for i in range(60)]
    want = by_query(curves.nearest(table(spark, rows), chunk=chunk).collect())
    near = rows[next(i for i in want[0] if i % 20)]  # its last row is the nearest
    repeated = rows * 3 + [(near[0], near[1] * (1 - 0.001 * j), 0) for j in range(30)]
    assert by_query(curves.nearest(table(spark, repeated), chunk=chunk, curves=4, segments=1).collect()) == by_query(
        curves.nearest(table(spark, rows), chunk=chunk, curves=4, segments=1).collect())
    assert all(len(v) == len(set(v)) == 20 for v in want.values())


@pytest.mark.parametrize("n", [2, 5, 16, 17, 20, 21, 32, 45])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    got = by_query(curves.nearest(table(spark, [(i, rng.normal(size=8), 0) for i in range(n)])).collect())
    assert {q: len(v) for q, v in got.items()} == {q: min(20, n - 1) for q in range(0, n, 20)}
    if n <= 21:
        assert all(set(v) == set(range(n)) - {q} for q, v in got.items())


def test_equal_vectors_fill_no_segment_alone(spark):
    rng = np.random.default_rng(9)
    hot = rng.normal(size=8)
    rows = [(i, hot if i % 3 == 1 else rng.normal(size=8), 0) for i in range(900)]
    orderings = curves.Orderings(np.array([v for _, v, _ in rows]))
    taken = orderings.segments(np.array([v for _, v, _ in rows]))
    assert all(set(taken[:, c]) == set(range(len(orderings.bounds[c]) + 1)) for c in range(curves.CURVES))
    assert curves.windows({0: 3, 1: 2, 4: 100, 7: 1}, 21) == {0: (0, 4), 1: (0, 4), 4: (1, 7), 7: (4, 7)}
    assert curves.windows({0: 3, 1: 2, 2: 1}, 21) == {0: (0, 2), 1: (0, 2), 2: (0, 2)}
