"""Ranked search against a plain computation of every score."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import lexical_search as ls
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    """Rows of documents are told apart by their place."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 100 - 90 + ((90 * sum(b.values()) * n) // length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item long, term string").repartition(parts)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ls.rank(d, q).collect()), key=str)


def some(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "straße", "ß9", "中文"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda k: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, weights, k=k))
    return [(k, text(rng.randint(0, 80))) for k in range(n)], [(k, text(rng.randint(0, 15)).upper()) for k in range(12)]


def test_bits():
    for values in ([0], [0] * 128, [1, 2, 3], [2**31, 0, 5], list(range(100))):
        assert ls.unpack(ls.pack(np.array(values)), len(values)).tolist() == values


@pytest.mark.parametrize(("seed", "n", "shard"), [(1, 700, 10_000), (2, 300, 37), (3, 60, 10_000)])
def test_equals_all_scores(spark, monkeypatch, seed, n, shard):
    monkeypatch.setattr(ls, "SHARD_DOCS", shard)
    docs, items = some(seed, n)
    assert ranked(spark, docs, items) == plain(docs, items)


def test_small_blocks_give_the_same(spark, monkeypatch):
    for name, value in {"BLOCK": 4, "STRETCHES": 3, "QUERY_TERMS": 20, "SHARD_POSTINGS": 900, "TERM_BYTES": 0}.items():
        monkeypatch.setattr(ls, name, value)
    docs, items = some(4, 400)
    assert ranked(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n-"), (4, "a b"), (4, "a b"), (None, "a b"), (5, "A"), (6, "z" * 3_000_000), (7, "a " * 500_000), (8, "c d e"), (9, "a b")]
    items = [(1, None), (2, ""), (3, "nothing"), (4, "a b a B"), (4, "a b"), (None, "z" * 3_000_000), (5, "c")]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, None)], items) == []


def test_blocks_are_passed_over(monkeypatch):
    """Most blocks of a common term stay packed once a rare term has set the threshold."""
    n = 40 * ls.BLOCK
    ns = np.full(n, 10, np.int64)
    ns[:20] = 0
    ms = ls._ms(ns, n, n * 10)
    seal = lambda d, tf, w: ls.PostingList(w, len(d), ls.BLOCK, *[r[c] for c in ("last", "peak", "ends", "blob")], ms) if (r := sealed(d, tf, w)) else None

    def sealed(d, tf, w):
        import pyarrow as pa

        kinds = {"shard": pa.int64(), "term": pa.binary(), "docs": pa.binary(), "tfs": pa.binary(), "weight": pa.int64(), "ns": pa.binary()}
        row = {"shard": 0, "term": b"t", "docs": np.array(d, np.int32).tobytes(), "tfs": np.array(tf, np.int32).tobytes(), "weight": w, "ns": ns[d].astype(np.int32).tobytes()}
        batch = pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in kinds.items()], names=list(kinds))
        return next(iter(ls._sealer(n, n * 10)([batch]))).to_pylist()[0]

    common, rare = seal(range(n), [1] * n, 5), seal(range(20), [3] * 20, 900)
    docs, scores = ls.best_of_shard([common, rare], 10)
    assert docs.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    monkeypatch.setattr(ls, "STRETCHES", 1)
    common.open.clear()
    ls.best_of_shard([common, rare], 10)
    assert len(common.open) == 1


def test_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(f"select item_id, rank, doc_id, score from ({queries.OP13_SQL})").fetchall()
    got = [tuple(r) for r in queries.op13_ranked_search(spark, SF).collect()]
    assert len(got) > 300 and sorted(got) == sorted(want)
