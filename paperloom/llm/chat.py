"""Chat formatting: turns to one string a conversation, with a loss mask, and back.

Turns are collected as structs and sorted, adjacent turns of one role merge
into a block by array functions over runs, and blocks are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Control strings inside texts and roles are escaped by one more backslash after
``<``, so nothing but the template holds ``<|``. The loss mask is an array of
spans, one for each assistant text, whose places an aggregation over the
segments' lengths gives. DataFrame functions only.

Cases: a null text or role is empty; null conversation ids form one
conversation; ties of turn go by role, then text, and repeated rows are turns
of their own; texts of any length are kept whole; an empty table gives an
empty result; other columns are not read. A conversation is one row and must
fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
#: Segments or spans of a conversation that are gone through at once.
PART = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def _blocks(turns: Column, starts: Column) -> Column:
    """Array of (role, texts) from sorted turns and the positions, from 1, where a role begins: adjacent turns of one role merge."""

    def block(at: Column, k: Column) -> Column:
        end = F.when(k + 1 < F.size(starts), starts[F.least(k + 1, F.size(starts) - 1)]).otherwise(F.size(turns) + 1)
        return F.struct(turns[at - 1]["role"].alias("role"), F.transform(F.slice(turns, at, end - at), lambda t: t["text"]).alias("texts"))

    return F.transform(starts, block)


def _starts(turns: Column) -> Column:
    """Positions, from 1, of turns that have another role than the one before."""
    return F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (turns[i - 1]["role"] != turns[F.greatest(i - 2, F.lit(0))]["role"]))


def _parts(array: Column) -> Column:
    """Numbers, from 0, of the parts of an array, PART elements each: arrays grow within a part only, so that long ones take no quadratic time."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(array) / PART).cast("int") - 1, F.lit(0)))


def _part(array: Column, k: Column) -> Column:
    return F.slice(array, k * PART + 1, F.lit(PART))


def _segments(block: Column) -> Column:
    """Array of (text, masked) of one block; masked texts are under the loss."""
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("masked"))
    texts = F.transform(block["texts"], lambda t, i: F.array(plain(F.when(i > 0, SEP).otherwise("")), F.struct(escape(t).alias("text"), (block["role"] == "assistant").alias("masked"))))
    return F.concat(F.array(plain(F.concat(F.lit(START), _role(block["role"]), F.lit("\n")))), F.flatten(texts), F.array(plain(F.lit(END + "\n"))))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns id, formatted, loss_spans (array of start, length; code points, from 1)."""
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    grouped = turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    cut = grouped.withColumn("starts", _starts(F.col("turns"))).select("id", _blocks(F.col("turns"), F.col("starts")).alias("blocks"))
    cut = cut.select("id", F.flatten(F.transform("blocks", _segments)).alias("segments")).withColumn("parts", _parts(F.col("segments")))
    segments, parts = F.col("segments"), F.col("parts")
    sizes = F.transform(parts, lambda k: F.aggregate(_part(segments, k), F.lit(0), lambda n, x: n + F.length(x["text"])))
    tops = F.aggregate("sizes", F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def span(s: Column, x: Column) -> Column:
        n = F.length(x["text"])
        one = F.array(F.struct((s["at"] + 1).alias("start"), n.alias("length")))
        return F.struct((s["at"] + n).alias("at"), F.when(x["masked"], F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    spans = F.transform(parts, lambda k: F.aggregate(_part(segments, k), F.struct(F.col("tops")[k].alias("at"), none.alias("spans")), span, lambda s: s["spans"]))
    placed = cut.withColumn("sizes", sizes).withColumn("tops", tops)
    return placed.select("id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), F.flatten(spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text): the turns of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(F.substring(head, len(START) + 1, 1 << 30), F.lit(NEWLINE), F.lit("\n")))
        body = F.substring(b, F.length(head) + 2, F.length(b))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask. Spans stand in order, so each part of them is read from its own stretch of the text."""

    def text(k: Column) -> Column:
        some = _part(spans, k)
        first = some[0]["start"]
        last = F.element_at(some, -1)
        whole = F.struct(some.alias("some"), first.alias("first"), F.substring(formatted, first, last["start"] + last["length"] - first).alias("stretch"))
        return F.transform(F.array(whole), lambda w: F.array_join(F.transform(w["some"], lambda s: unescape(F.substring(w["stretch"], s["start"] - w["first"] + 1, s["length"]))), ""))[0]

    return F.when(F.size(spans) > 0, F.array_join(F.transform(_parts(spans), text), "")).otherwise("")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = END + START + "assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = format_chats(rows.unionByName(added))
    back = out.select("id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
c AS (
  SELECT *, CASE WHEN before IS NULL OR before <> role THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
                 ELSE length('<|im_sep|>') END
            + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
