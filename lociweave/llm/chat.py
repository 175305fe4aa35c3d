"""Chat formatting with Spark expressions only: sorted turn structs, merged roles, reversible escapes, a loss mask.

The template is one text per conversation:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n        one block per run of turns with the same role

Inside roles and texts every backslash is doubled and `<|` becomes `<\\|`, so that no control string can be made by
a text; in roles a line end gets a backslash too. Reading is the reverse: cut at control strings, drop one backslash
of each pair. `loss_spans` are byte ranges of the formatted text that hold assistant texts and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """`text` without any control string; `unescaped` gives it back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """The text that `escaped` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _running(sizes: Column) -> Column:
    """Running sums of an array<long>, by pieces of the square root of its length, so that no step copies more than one."""

    def sums(some: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(some, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x)))

    root = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), root - 1), lambda i: sums(F.slice(sizes, i * root + 1, root)))
    before = sums(F.transform(parts, lambda part: F.coalesce(F.get(part, F.size(part) - 1), F.lit(0).cast("long"))))
    before = F.concat(F.array(F.lit(0).cast("long")), before)
    return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), before.alias("before")), lambda x: F.transform(F.coalesce(x["part"], F.array().cast("array<bigint>")), lambda y: y + x["before"])))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, formatted string, loss_spans array<struct<start, bytes>>.

    turns: conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn (null first), and rows with
    equal turn by role and text, so repeated rows stay, each as a turn of its own. Null roles and texts count as empty.
    A null conv_id is a conversation of its own. An empty table gives no rows. A conversation is one output text, so its turns meet in
    one row; nothing larger than a conversation does.
    """
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = F.sequence(F.lit(1), F.size("turns"))
    opens = F.filter(
        at,
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    chats = chats.withColumn("opens", opens)
    blocks = F.transform(
        "opens",
        lambda start, k: F.struct(
            F.element_at("turns", start)["role"].alias("role"),
            F.transform(
                F.slice("turns", start, F.coalesce(F.get("opens", k + 1), F.size("turns") + 1) - start),
                lambda t: escaped(t["text"]),
            ).alias("texts"),
        ),
    )
    chats = chats.select("conv_id", blocks.alias("blocks"))
    # pieces: the formatted text in order, each with whether it is learned
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(
                    F.struct(
                        F.concat(F.lit(START), F.replace(escaped(b["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("text"),
                        F.lit(False).alias("learned"),
                    )
                ),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)).alias("text"), F.lit(False).alias("learned")),
                            F.struct(t.alias("text"), (b["role"] == LEARNED_ROLE).alias("learned")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("learned"))),
            ),
        )
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    spans = F.zip_with(
        "pieces",
        _running(F.transform("pieces", lambda p: _bytes(p["text"]))),
        lambda p, end: F.struct((end - _bytes(p["text"])).alias("start"), _bytes(p["text"]).alias("bytes"), p["learned"].alias("learned")),
    )
    spans = F.transform(F.filter(spans, lambda x: x["learned"]), lambda x: F.struct(x["start"].alias("start"), x["bytes"].alias("bytes")))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_texts array<string>, both read from the formatted text."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n.*$"
    # the head of a block is found once, whatever its turns
    heads = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, head, 1).alias("head"), b.alias("block")))
    bodies = F.transform(
        heads,
        lambda x: F.struct(
            unescaped(x["head"]).alias("role"),
            F.split(
                F.substr(x["block"], F.length(x["head"]) + 2, F.length(x["block"]) - F.length(x["head"]) - 1 - len(END) - 1),
                r"<\|im_sep\|>",
            ).alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(bodies, lambda x: F.transform(x["texts"], lambda t: F.struct(x["role"].alias("role"), unescaped(t).alias("text"))))
    )
    # a cast of a whole string to binary copies nothing, so each span costs its own length only
    learned = F.transform(
        "loss_spans",
        lambda s: unescaped(
            F.decode(F.substring(F.col("formatted").cast("binary"), (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8")
        ),
    )
    return chats.select("*", turns.alias("turns"), learned.alias("loss_texts"))
