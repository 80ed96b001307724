"""The pipeline's stages on a small table, each against its operator."""

import corpus_pipeline
from evigraph.llm import linededup, queries, simhash, suffixdedup
from evigraph.llm.util import written


def test_stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "stage")
        out[name] = before, docs
    for name in list(out)[:-1]:
        before, after = out[name]
        assert after.columns == list(corpus_pipeline.COLUMNS) and after.count() <= before.count()
        assert after.where("n_chars <> length(text)").count() == 0 or name == "toxicity"
    before, after = out["line dedup"]
    want = {r.doc_id: r.text for r in linededup.dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = out["simhash near-dedup"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = out["suffix-array dedup"]
    kept = {r.doc_id: r.kept_text for r in suffixdedup.remove_repeats(before, text=True).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == kept
    assert {r.doc_id for r in out["packing"][1].collect()} == set(kept)


def test_null_and_repeated_ids(spark, sf):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, word(1)), (None, word(2)), (None, word(3)), (5, word(3)), (6, word(4)), (6, word(4)), (7, word(5)), (7, word(6)), (8, word(5)), (8, word(7)), (1, word(7)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    count = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    want = [(None, None), (None, word(1)), (None, word(2)), (5, word(3)), (6, word(4)), (7, word(5)), (7, word(6)), (1, word(7))]
    kept = corpus_pipeline.simhash_dedup(spark, docs, sf)
    assert count(kept) == sorted(want, key=str) and kept.columns == list(corpus_pipeline.COLUMNS)
    for stage in (corpus_pipeline.toxicity_filter, corpus_pipeline.line_dedup, corpus_pipeline.suffix_dedup):
        assert sorted((r.doc_id for r in stage(spark, docs, sf).collect()), key=str) == sorted((i for i, _ in rows), key=str)
    packed = {r.doc_id for r in corpus_pipeline.pack(spark, docs, sf).collect()}
    assert packed == {i for i, _ in rows}


def test_cut_characters():
    """Broken characters go, real replacement characters stay."""
    text = "zz \ufffd zz é" + "ü" * 5 + " \ufffd end 中"
    data = text.encode()
    for a in range(len(data)):
        for z in range(a + 1, len(data) + 1):
            at, out = 0, ""
            for c in text:
                if at + len(c.encode()) <= a or at >= z:
                    out += c
                at += len(c.encode())
            assert suffixdedup.kept_text(data, [(a, z)]) == out
    assert suffixdedup.kept_text(data, [(3, 4), (5, 6)]) == text.replace("\ufffd", "", 1)


def test_stages_keep_replacement_characters(spark, sf):
    shared = "same passage in two texts of ü umlauts and \ufffd signs, " * 8
    rows = [(1, "first \ufffd one é" + shared + "ü tail of one \ufffd"), (2, "second \ufffd ö" + shared + "ö tail of two"), (3, None), (4, ""), (5, "long \ufffd word " * 9000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, kept_text string, rid int")
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, sf).collect()}
    assert got[1].startswith("first \ufffd one") and got[1].endswith("tail of one \ufffd") and got[2].startswith("second \ufffd") and "passage" not in got[1] + got[2]
    assert got[3] == got[4] == "" and len(got) == 5
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage is corpus_pipeline.pack or out.columns == list(corpus_pipeline.COLUMNS)
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5} or stage is corpus_pipeline.simhash_dedup
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
