"""Texts of a million characters: equal to the whole-text result and to the library, in bounded time."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import langid, suffix_dedup, token_offsets

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLANKS = {"blanks": " ", "newlines": "\n", "mixed": " \t\r\n\x85\xa0 　", "tabs": "\t"}


@pytest.fixture(scope="module")
def tokens():
    return token_offsets.Tokens(BYTES)


@pytest.mark.parametrize("kind", BLANKS)
@pytest.mark.parametrize("tail", ["", "x", "\x1cx", "7 a", "é"])
def test_runs_of_white_space_are_cut_as_the_pattern_does(tokens, kind, tail):
    """Below the length where the library fails it is asked itself."""
    rng = random.Random(kind + tail)
    text = "a b" + "".join(rng.choices(BLANKS[kind], k=token_offsets.LONG_RUN + 77)) + tail + "  z" + " " * (token_offsets.LONG_RUN - 1) + "y"
    assert tokens._ids(text) == tokens.encoding.encode_ordinary(text)


@pytest.mark.parametrize("kind", BLANKS)
def test_a_million_blanks_do_not_crash(tokens, kind):
    start = time.time()
    text = "one" + (BLANKS[kind] * 1_200_000)[:1_200_000] + "two" + BLANKS[kind][0] * 1_000_000
    first, end = tokens.spans(text)
    assert first[0] == 0 and end[-1] == len(text) and tokens.encoding.decode(tokens._ids(text)) == text
    assert time.time() - start < 60


def plain_counts(text):
    """Cells of all 1- to 3-grams of a whole text, one at a time."""
    chars = [ord(c) if c.isalpha() else 32 for c in f"  {text.lower()}  "]
    found = Counter()
    for at in range(len(chars)):
        h = 0
        for n in range(3):
            if at + n >= len(chars):
                break
            h = (h * 0xD6E8FEB86659FD93 + chars[at + n] + 1) % 2**64
            if any(c != 32 for c in chars[at : at + n + 1]):
                found[(h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS)] += 1
    return found


@pytest.mark.parametrize("chunk", [1 << 19, 7, 64])
def test_grams_are_those_of_the_whole_text(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK_CHARS", chunk)
    rng = random.Random(1)
    texts = ["", "a", "İΣ", " x ", "".join(rng.choice("abc ÉΣß1中\n") for _ in range(700)), "zz" * 40]
    counts, letters = langid.gram_counts(texts)
    for text, row, n in zip(texts, counts, letters, strict=True):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(plain_counts(text)) and n == sum(c.isalpha() for c in text.lower())


def test_long_text_equals_its_pieces_whatever_stands_beside_it():
    text = "".join(random.Random(2).choice("abcde fgh.") for _ in range(1_300_000))
    start = time.time()
    alone, _ = langid.gram_counts([text])
    assert time.time() - start < 30
    assert (langid.gram_counts(["before", text, "after"])[0][1] == alone[0]).all()
    assert {int(k): int(alone[0][k]) for k in np.flatnonzero(alone[0])} == dict(plain_counts(text))


def test_predictions_are_recomputed():
    """Centroid, cosine, score and rejection of a small model, in plain Python."""
    words = {"x": ["alpha", "beta", "gamma"], "y": ["uno", "dos", "tres"]}
    rng = random.Random(3)
    texts = [(lang, " ".join(rng.choices(w, k=12))) for lang, w in words.items() for _ in range(30)]
    model = langid.Centroids(langid.gram_counts([t for _, t in texts])[0], [lang for lang, _ in texts])
    counts, _ = langid.gram_counts(["alpha beta", "dos dos tres"])
    langs, scores, _ = model.predict(["alpha beta", "dos dos tres"])
    for row, lang, score, want in zip(counts, langs, scores, ("x", "y"), strict=True):
        v = np.log(1 + row.astype(float)) * model.idf
        cosines = [float((v / np.sqrt((v**2).sum()) * c).sum()) for c in model.centre]
        assert model.langs[int(np.argmax(cosines))] == lang == want
        nearest = [max(c for c, w in zip(cosines, model.langs, strict=True) if w == name) for name in ("x", "y")]
        assert score == pytest.approx(1 / sum(np.exp(12 * (c - max(nearest))) for c in nearest), abs=1e-5)


def test_suffix_arrays_take_few_bytes_a_position():
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(1).integers(97, 123, 1 << 19, dtype=np.uint8)
    data[1 << 18 : (1 << 18) + 5000] = data[:5000]
    starts = np.arange(len(data) - 250 + 1, dtype=np.int32)
    tracemalloc.start()
    before, after = suffix_dedup.factors(data, starts, 250)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(data)
    assert (before >= 250).sum() == (after >= 250).sum() == 4751


def test_kept_texts_go_to_the_toxicity_model_once_and_in_parts(spark):
    from plumbline.llm import toxic_neighbours
    from plumbline.llm.common import map_batches

    sizes = map_batches(spark.range(10, numPartitions=1), lambda b: pa.RecordBatch.from_pydict({"id": [b.num_rows]}), "id long", rows=4)
    assert sorted(r.id for r in sizes.collect()) == [2, 4, 4]
    model = toxic_neighbours.Neighbours([{"good": 1}, {"bad": 1}], [0, 1], (1.0, 1.0))
    docs = spark.createDataFrame([(i, "bad" if i % 2 else None) for i in range(2 * toxic_neighbours.ROWS + 1)], "doc_id long, text string").coalesce(1)
    out = toxic_neighbours.score(docs, model, keep=("doc_id", "text"))
    assert "__text" not in out._jdf.queryExecution().analyzed().toString()
    got = {r.doc_id: (r.text, r.predicted) for r in out.collect()}
    assert got == {i: ("bad", 1) if i % 2 else (None, got[0][1]) for i in range(2 * toxic_neighbours.ROWS + 1)}
