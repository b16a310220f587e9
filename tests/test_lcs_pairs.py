"""All pairs by their longest common subsequence, against every pair."""

import random

from pyspark.sql import functions as F

from plumbline.operators import similarity as M


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_no_pair_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE_WORDS", 300)  # several tiles a class of length
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.choice([1, 2, 7, 20, 60, 100]))]
        texts += [base, base] + [[w if rng.random() > p else f"x{rng.randrange(99)}" for w in base] for p in (0.05, 0.2, 0.3)] + [base[: max(1, len(base) * 7 // 13)]]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(texts)] + [(9000, []), (9001, None)], "doc_id long, w array<string>")
    got = {(r.a, r.b): r.lcs for r in M.lcs_pairs(rows, "doc_id", "w").collect()}
    want = {(i, j): s for i, a in enumerate(texts) for j, b in enumerate(texts[i + 1 :], i + 1) if (s := 2 * common(a, b) / (len(a) + len(b))) >= 0.7}
    assert len(want) > 100 and got == want
    # links through bands, one star for the copies of a text, leave some of them out
    sigs = M.text_signatures(rows.select("doc_id", F.array_join("w", " ").alias("text")), "doc_id", "text")
    assert set(got) - {tuple(r) for r in M.wide_pairs(sigs, "doc_id", "sig").collect()}
