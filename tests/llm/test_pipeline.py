"""The pipeline's stages, each against what it promises, and the whole."""

import corpus_pipeline
from lociweave.llm import debruijn, minhash
from lociweave.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "substring dedup", "mixing sources", "byte-level BPE"]
    named = stages["language ID"](spark, docs, folder)
    assert named.columns == COLUMNS and named.count() == docs.count()  # all of them are clean text
    single = stages["MinHash near-dedup"](spark, named, folder)
    kept = {r.component_id for r in minhash.near_duplicates(named).select("component_id").collect()}
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == kept
    cut = stages["substring dedup"](spark, single, folder)
    assert cut.columns == COLUMNS
    lost = {r.doc_id: (r.n_words, r.n_removed) for r in debruijn.deduplicated(single).collect()}
    for r in cut.collect():
        assert len(r.text.split()) == lost[r.doc_id][0] - lost[r.doc_id][1] and r.n_chars == len(r.text)
    mixed = stages["mixing sources"](spark, cut, folder)
    assert mixed.columns == COLUMNS and 0 < mixed.count() <= cut.count()


def test_stages_take_empty_and_odd_documents(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words in a row", "en", None, 20), (None, "words without an id", "en", "a", 19)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
        assert docs.count() <= len(rows)


def test_short_texts_are_not_rejected_unjudged(spark, folder):
    """Texts of 1 to 3 letters have no n-gram; they stay with their own lang, while letter-free and foreign texts go."""
    plain = [(i, "the words of a plain text in a row", "en", "a", 34) for i in range(9)]
    short = [(10, "A.", "fr", "a", 2), (11, "Re.", "en", "a", 3), (12, "De", "de", "a", 2), (13, "x", None, "a", 1), (14, "A. b", "en", "a", 4), (15, "日", "en", "a", 1)]
    gone = [(20, "12.", "en", "a", 3), (21, None, "en", "a", 0), (22, "!", "en", "a", 1), (23, "zqxj kvwq", None, "a", 9)]
    docs = spark.createDataFrame(plain + short + gone, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, folder).collect()}
    assert out == {i: "en" for i in range(9)} | {r[0]: r[2] for r in short}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert rows and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
