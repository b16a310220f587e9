"""Hard negatives against a plain computation over all pairs."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows):
    """All pairs, with Python's whole numbers; rows are (vec_id, label, embedding) and told apart by their place."""
    rows = [(i, lab, [math.floor(256 * x) for x in e]) for i, lab, e in rows if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (aid, alab, a) in enumerate(rows):
        if aid is None or aid % 100:
            continue
        score = [sum(x * y for x, y in zip(a, q)) for _, _, q in rows]
        order = sorted((m for m in range(len(rows)) if m != n), key=lambda m: (-score[m], last(rows[m][0])))
        for p in [m for m in order if rows[m][1] == alab][:5]:
            hits = [m for m in order if rows[m][1] != alab and 30 * score[p] <= 100 * score[m] <= 90 * score[p]][:10]
            out += [(aid, rows[p][0], k, rows[m][0], score[p], score[m]) for k, m in enumerate(hits, 1)]
    return sorted(out, key=str)


def mined(frame):
    return sorted(map(tuple, hn.mine(frame, F.col("vec_id") % 100 == 0).collect()), key=str)


def some(seed, n, dim, scale=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(4)]
    rows = [(k * 10, rng.randrange(4), None) for k in range(n)]
    return [(i, lab, [float(x + rng.gauss(0, scale / 2)) for x in centres[(lab + (rng.random() < 0.3)) % 4]]) for i, lab, _ in rows]


def as_float32(rows):
    import numpy as np

    return [(i, lab, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, lab, e in rows]


@pytest.mark.parametrize(("seed", "n", "dim", "scale"), [(1, 400, 8, 0.3), (2, 300, 3, 0.02), (3, 300, 16, 50.0), (4, 200, 4, 2e6)])
def test_equals_all_pairs(spark, seed, n, dim, scale):
    rows = as_float32(some(seed, n, dim, scale))
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = as_float32(some(5, 500, 6))
    for name, value in {"BLOCK_BYTES": 8 * 6 * 7, "QUERIES": 3, "TILE": 16, "PAIRS": 5}.items():
        monkeypatch.setattr(hn, name, value)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(2)) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (None, 1, [0.5, 0.4]), (2, 2, [0.2, 0.2]), (2, 2, [0.2, 0.2]), (None, 3, [0.2, 0.2]), (3, 2, [0.2]), (4, 2, []), (5, 2, None)]
    rows += [(6, None, [0.3, 0.3]), (7, 2, [nan, 0.2]), (8, 2, [inf, 0.2]), (9, 2, [None, 0.2]), (100, 9, [0.1, 0.1]), (200, 1, [-0.5, -0.5]), (300, 2, [0.0, 0.0])]
    rows = as_float32(rows)
    frame = spark.createDataFrame([(*r, 0.0, "x") for r in rows], SCHEMA + ", score double, rid string")
    assert mined(frame) == plain([(i, lab, e and e + [0.0] * (2 - len(e)) if e != [] else [0.0, 0.0]) for i, lab, e in rows])
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [])], SCHEMA)) == []


def test_huge_components_do_not_crash(spark):
    rows = [(k, k % 2, [3e38 if k % 3 else 1.0, -3e38]) for k in range(0, 400, 50)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) is not None


def test_only_rows_that_may_enter_are_scored(spark, monkeypatch):
    """Bounds hold for every row, and most rows are never scored."""
    import numpy as np

    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.normal(0, 0.125, (4000, 64)))
    mean, spread = q.mean(0), 3 * q.std(0)
    stats = hn.Stats(64, q.min(0), q.max(0), np.ceil((mean - spread)[:, None] + (2 * spread)[:, None] * np.linspace(0, 1, hn.CELLS + 1)[1:-1]))
    block = hn.Block(np.arange(20), np.zeros(20, int), q[:20], np.full((20, 1), -np.inf), np.full((20, 1), np.inf), 10, True)
    state, scored = hn.Search(block, stats, slice(0, 20)), []
    plain_merge = state._merge
    monkeypatch.setattr(state, "_merge", lambda a, *rest: (scored.append(len(a)), plain_merge(a, *rest)))
    state.add(np.arange(4000), np.arange(4000), np.zeros(4000, bool), np.zeros(4000, int), stats.cells(q), q)
    exact = q @ q[:20].T
    least, most = (sum(t[d][stats.cells(q)[:, d]] for d in range(64)) for t in state._tables())
    assert (least - state.slack <= exact).all() and (exact <= most + state.slack).all()
    assert sum(scored) < 0.3 * 4000 * 20


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({queries.OP12_SQL})").fetchall()
    got = [tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect()]
    assert len(got) > 100 and sorted(got) == sorted(want)
