"""Every stage of the pipeline on odd rows, and its result against plain Python."""

import hashlib
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "é🙂中 " * 40), (6, "word " * 5000), (7, "x"), (7, "x"), (None, "x y z"), (None, "x y z"), (8, "q w e r t y"), (8, "a different text of the same key"), (9, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if d else None, None, 0, "clash", 1, 2.0) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, contaminated string, rid int, score double")


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    got = stage(spark, odd, SF).collect()
    assert len(stage(spark, odd.where("false"), SF).collect()) == 0
    if name == "tokenize":
        assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
        return
    assert list(got[0].asDict()) == list(corpus_pipeline.COLUMNS)
    if name in ("toxicity", "decontaminate"):
        assert len(got) == len(ODD)
    if name == "simhash_dedup":  # one of the empty texts, of the x, of the null keys; both texts of key 8
        assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:3]) for r in got) == [(False, 1, ""), (False, 4, "x"), (False, 5, "é🙂中"), (False, 6, "wor"), (False, 8, "a d"), (False, 8, "q w"), (False, 9, "wor"), (True, 0, "x y")]
    if name == "suffix_array_dedup":
        by = {r.doc_id: r for r in got if r.doc_id}
        assert len(got) == len(ODD) and by[9].text == LONG and 0 < len(by[6].text) < 300 and by[1].text == ""


def test_run_against_plain_python(spark):
    """All stages by brute force over the smallest table, given the same toxicity model."""
    import sentencepiece

    from plumbline.llm import pigeonhole, toxic_neighbours
    from plumbline.llm.common import held_out, table, written

    docs = table(spark, SF, "documents")
    model = toxic_neighbours.fit(docs, table(spark, SF, "labels").where(~held_out("doc_id", 5, 0)))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.h for r in docs.select("doc_id", held_out("doc_id", 5, 0).alias("h")).collect())
    scores = model.score([toxic_neighbours.Counter(toxic_neighbours.terms(t)) for _, t in rows])[0]
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    # near copies: Jaccard 0.8 of five-word shingles, connected
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    # repeated strings
    seen, out = set(), []
    for d, t in rows:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - corpus_pipeline.STRING_BYTES + 1):
            s = raw[i : i + corpus_pipeline.STRING_BYTES]
            if s in seen:
                gone.update(range(i, i + corpus_pipeline.STRING_BYTES))
            seen.add(s)
        kept = b""
        for run in re.finditer(r"K+|G+", "".join("G" if i in gone else "K" for i in range(len(raw)))):
            a, b = run.span()
            part = raw[a:b]
            if run[0][0] == "G":  # a cut character stays whole: the bytes at either edge that are half of one
                while part and part[0] & 0xC0 == 0x80:
                    kept, part, a = kept + part[:1], part[1:], a + 1
                tail = b""
                while part and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    tail, part, b = part[-1:] + tail, part[:-1], b - 1
                kept += tail
            else:
                kept += part
        if not gone or kept.strip():
            out.append((d, kept.decode()))
    matcher = pigeonhole.Matcher([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for d, t in out:
        if not matcher.find(t):
            ids = lib.encode(t, add_eos=True)
            want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    before = written()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) < docs.count()
    assert written() == before + 1  # the rows that the last stage reads
