import json
import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import graph, scoring, similarity, vote
from plumbline.sources import repo
from plumbline.streaming import sessions


def test_vote_tie_goes_to_first_seen(spark):
    rows = spark.createDataFrame([("g", 1, "b"), ("g", 2, "a"), ("g", 3, "a"), ("g", 4, "b")], "g string, id long, p string")
    out = vote.vote(rows, "g", "p", "id").first()
    assert (out.dominant, out.dominant_count, out.total, out.consistency, out.flagged) == ("b", 2, 4, 50, False)


def test_temporal_weight(spark):
    rows = spark.createDataFrame([(0,), (90,), (None,), (-5,)], "a int")
    got = [r[0] for r in rows.select(vote.temporal_weight(F.col("a"))).collect()]
    assert [round(x, 9) for x in got] == [2.0, 1.0, 1.0, 2.0]


def test_seed_injects_unseen_pattern(spark):
    rows = spark.createDataFrame([("g", 1, "a")], "g string, id long, p string")
    out = vote.seeded_vote(rows, "g", "p", "id", "z", 0.9).first()
    assert (out.dominant, out.raw_dominant, out.matches_hint) == ("z", "a", False)


def test_health_and_composite(spark):
    d = spark.createDataFrame([("c", "x", 0.5), ("c", "y", 0.2), ("k", "x", 0.0)], "category string, analyzer string, damage double")
    h = {r.category: r.health for r in scoring.health(d).collect()}
    assert math.isclose(h["c"], 0.4) and h["k"] == 1.0
    assert scoring.composite(scoring.health(d)).first().composite == math.floor(1000 * math.sqrt(0.4) + 0.5) / 10
    assert scoring.composite(scoring.health(d.where("false"))).first().composite == 100.0
    gain = {(r.category, r.analyzer): r.impact for r in scoring.leave_one_out(d).collect()}
    assert math.isclose(gain["c", "x"], 0.4) and math.isclose(gain["k", "x"], 0.0, abs_tol=1e-12)


def test_poisson_tail(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,)], "k long")
    got = [r[0] for r in rows.select(scoring.poisson_tail(F.col("k"), F.lit(2.0))).collect()]
    want = [1 - sum(math.exp(-2) * 2**i / math.factorial(i) for i in range(k)) for k in (0, 1, 3)]
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want, strict=True))


def test_lcs_against_dynamic_program(spark):
    pairs = [("a b c d e".split(), "a x c d y".split()), ("a".split(), "a b c".split()), ("a b a b a".split(), "b a b a b".split())]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r[0] for r in rows.select(similarity.lcs_similarity("a", "b")).collect()]
    assert got == [0.6, 0.0, 0.8]


def test_lsh_links_copies_as_a_star(spark):
    rows = spark.createDataFrame([(i, [1, 2, 3, 4]) for i in range(50)] + [(99, [9, 9, 9, 9])], "id long, sig array<long>")
    pairs = similarity.lsh_pairs(rows, "id", "sig", 2, 4).collect()
    assert len(pairs) == 49 and {r.a for r in pairs} == {0}


def test_clusters(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.id: r.cluster for r in graph.clusters(pairs).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_cosine_of_zero_and_unequal(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_cooldown_depends_on_last_kept(spark):
    base = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", i, base + timedelta(seconds=s)) for i, s in enumerate((0, 4, 6, 8, 11))], "k string, id int, ts timestamp")
    kept = sorted(r.id for r in sessions.cooldown(rows, ["k"], "ts", "id", 5).collect())
    assert kept == [0, 2, 4]


def test_repo_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("import os\nx = 1\n")
    (tmp_path / "a" / "long.js").write_text("x" * 3000)
    (tmp_path / "node_modules" / "y.js").write_text("1")
    (tmp_path / "b.txt").write_text("no source")
    rows = repo.files(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.language, r.line_count) for r in rows] == [("a/x.py", "python", 3)]


def test_stream_and_batch_agree(spark, tmp_path):
    events = [{"aid": str(i), "sid": "s", "ts": f"2024-01-01T00:00:{i:02d}Z", "type": t, "file": "f", "category": "c"} for i, t in enumerate(["flag", "edit", "resolve"])]
    lines = [json.dumps(e) for e in [*events, events[0]]] + ["{broken"]
    src = tmp_path / "in"
    src.mkdir()
    (src / "l.jsonl").write_text("\n".join(lines))
    batch = sessions.open_findings(sessions.read_ledger(spark, str(src), streaming=False)).collect()
    q = sessions.open_findings(sessions.read_ledger(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").collect() == batch and batch[0].raised == 1 and batch[0].state == "resolve"


def test_file_scores_do_not_hang_on_the_order_of_findings(spark):
    rows = [("p", "a", "error", c, 1.0) for c in (0.3 + 0.1 * 6, 0.3, 0.3 + 0.1 * 6, 0.3 + 0.1 * 6)]
    for given in (rows, [rows[i] for i in (0, 2, 1, 3)]):
        found = spark.createDataFrame(given, "path string, analyzer string, severity string, confidence double, importance double").coalesce(1)
        assert [tuple(r) for r in scoring.file_scores(found).collect()] == [("p", 4, 48)]  # 100 * (1 - 0.7 * 0.75) is 47.5
