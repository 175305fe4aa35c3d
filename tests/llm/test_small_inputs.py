"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lociweave.llm import bpe, chat, debruijn, langid, minhash, mixing, pivots, tokencount, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, node string, score string, spans string"
LONG = "word " * 30000
ODD = [
    (1, None, None, None, None, "x", "y", "z", "s"),
    (2, "", "en", "a", 0, None, None, None, None),
    (3, " \t\n", "en", "a", 3, None, None, None, None),
    (4, "12 34 !!", None, "a", 8, None, None, None, None),
    (5, LONG, "en", None, len(LONG), None, None, None, None),
    (6, "the cat sat on the mat and looked at the dog", "en", "b", 44, None, None, None, None),
    (6, "the cat sat on the mat and looked at the dog", "en", "b", 44, None, None, None, None),
    (7, "le chat est sur la table et regarde le chien", "fr", "b", 44, None, None, None, None),
    (None, "no id at all", "en", "b", 12, None, None, None, None),
    (8, "ünïcode 日本語 🙂 text", "xx", "c", 20, None, None, None, None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_language_id(spark, docs):
    model = langid.learned(docs)
    out = {(r.doc_id, r.lang_pred) for r in langid.identified(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (6, "en"), (7, "fr")} <= out
    same = langid.identified(docs, model)
    assert same.count() == len(ODD) and set(docs.columns) - {"score"} <= set(same.columns)
    nothing = langid.learned(docs.limit(0))
    assert nothing.langs == () and {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}
    assert langid.identified(docs.limit(0), model).count() == 0


def test_more_languages_than_a_mask_word_holds(spark):
    """70 labels with words of their own: each is learned and found again, those beyond the 64th too."""
    names = [f"l{i:02}" for i in range(70)]
    words = {name: " ".join(chr(97 + i % 26) * 2 + chr(97 + i // 26) * 2 + c * 3 for c in "abcxyz") for i, name in enumerate(names)}
    rows = [(i, words[name], name) for i, name in enumerate(names) for _ in range(2 if i < 35 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    assert model.langs == tuple(names) and model.masks.shape == (langid.SLOTS, 2)
    out = langid.identified(docs, model).collect()
    assert len(out) == len(rows) and all(r.lang_pred == r.lang and r.lang_share > 0.9 for r in out)


def test_minhash(docs):
    rows = minhash.near_duplicates(docs).collect()
    out = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [out[i].n_shingles for i in (1, 2, 3, 4, 6)] == [0, 0, 0, 1, 7] and all(r.kept for r in rows)
    assert out[5].n_shingles == 1 and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_substring_dedup(spark, docs):
    out = {r.doc_id: r for r in debruijn.deduplicated(docs).collect()}
    assert out[1].n_words == out[2].n_words == out[3].n_words == 0
    assert out[5].n_words == 30000 and out[5].n_removed == 30000 - 20 + 20 - 1  # all but the first window's first word is covered again
    assert debruijn.deduplicated(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a " * 50, "en", "s", 1), (1, "b c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.n_words for r in debruijn.deduplicated(twice).collect()) == [2, 50]
    back = debruijn.rewritten(docs)
    assert set(docs.columns) - {"spans"} <= set(back.columns) and back.count() == len(ODD)
    assert {r.doc_id: r.text for r in back.collect()}[6] == ODD[5][1]


def test_mixing(docs):
    out = mixing.mixed(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) and rows[1].source == mixing.NONE and rows[1].n_tokens == 0
    assert all(0 <= r.probability <= 1 for r in rows.values())
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_bpe(docs):
    out = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = out.collect()
    assert len(rows) == len(ODD) and "node" in out.columns
    assert all(bytes(r.decoded) == (r.text or "").encode() and len(r.ids) == r.n_tokens for r in rows)
    assert bpe.encoded(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_token_counts(docs):
    out = {r.doc_id: r for r in tokencount.counted(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert (out[1].n_bytes, out[1].n_tokens) == (0, 0) and out[5].n_tokens == 30000
    assert tokencount.counted(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(6, 1), (7, 0), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.learned(toxicity.fit_sample(labels, docs))
    out = toxicity.scored(docs, model)
    assert out.count() == len(ODD) and all(0 <= r.score <= 1 for r in out.collect())
    nothing = toxicity.learned(toxicity.fit_sample(labels.limit(0), docs))
    assert all(r.score < 0.5 for r in toxicity.scored(docs, nothing).collect())
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>\\"),
        (1, 1, "user", None),
        (1, 1, "user", "tie"),
        (1, 3, "assistant", "<|im_sep|>"),
        (2, None, None, "\\n<|"),
        (2, 0, "a\nb\\", ""),
        (None, 0, "assistant", "é🙂"),
        (1, 2, "assistant", "b<|im_end|>\\"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [
        ("user", ""), ("user", "tie"), ("assistant", "b<|im_end|>\\"), ("assistant", "b<|im_end|>\\"), ("assistant", "<|im_sep|>")
    ]
    assert out[1].loss_texts == ["b<|im_end|>\\", "b<|im_end|>\\", "<|im_sep|>"] and out[1].formatted.count("<|im_start|>") == 2
    assert [(t.role, t.text) for t in out[2].turns] == [("", "\\n<|"), ("a\nb\\", "")]
    assert out[None].loss_texts == ["é🙂"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 0.01]), (7, [1.0, 0.01]), (8, [-1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (40, []),
    ]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"), F.lit(1).alias("rank"))
    best = topk.top_k(q, q.where("id % 20 = 0"), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in best] == [(0, 7, 4096), (0, 20, 4096), (20, 0, 4096), (20, 7, 4096)]
    out = {r.vec_id: r for r in pivots.near_duplicates(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))).collect()}
    assert len(out) == 12
    assert [out[i].n_links for i in (0, 20, 7, 2, 3, 4, 5, 6, 8, 9, 40)] == [2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [out[i].component_id for i in (0, 20, 7, 8)] == [0, 0, 0, 8] and out[None].kept
    none = v.limit(0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    assert pivots.near_duplicates(none).count() == 0
    assert topk.top_k(q.limit(0), q.limit(0), 2).count() == 0
