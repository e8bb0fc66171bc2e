"""Quality rules: signals of each whole text, and line frequency across the documents of a host.

A text fails the base rules if it has few words or mostly repeats itself. Lines
that more than ``max_docs`` documents of a host share are removed; a document
that keeps too little of its words is rejected. Lines are told apart by the
64-bit hash of their normal form, three-word windows of a text by their words.
quality gives the verdicts, without_common_lines the texts that are left.
DataFrame functions only.

Cases: null and empty texts have no words and fail; a null host counts as the
host ''; rows that repeat an id count as one document of a host and each gets
its own verdict; null ids count as one document; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, documents, words
from .lines import NORMAL_SQL, line_hash, lines, normal_lines, words_hash

#: A line in more documents of one host than this is removed.
MAX_DOCS = 20
#: A document is depleted if fewer of its words, or a smaller share of them, than this are left.
MIN_LEFT, MIN_SHARE = 25, 0.5
#: Base rules.
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
#: Low bits of a packed window that hold its position: as many as an array can need.
POSITION_BITS = 31


def window_hash(a: Column, b: Column, c: Column) -> Column:
    """What windows are sorted by first; equal values need not be equal windows."""
    return F.xxhash64(a, b, c)


def _covered(at: Column) -> Column:
    """Words covered by three-word windows that start at sorted positions."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")), lambda s: s["n"])


def signals(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, __lines (struct h, n: hash and words of each line with a word).

    Hashes of the three-word windows, cut to their high bits, are packed with
    their positions and sorted: windows that share those bits are neighbours, and
    all equal windows are among them. Only these are sorted by whole hash and
    words, so that equal windows are neighbours whatever their hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    first = docs.select(*keep, symbols.cast("long").alias("n_symbols"), words(text).alias("__w"), full.alias("__full"), normal_lines(text).alias("__n"))
    w = F.col("__w")
    chars = F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    hashes = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window_hash(w[i], w[i + 1], w[i + 2])))
    second = first.select(
        *keep, "n_symbols", chars.alias("word_chars"), F.size("__w").cast("long").alias("n_words"), (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.transform(F.filter("__n", lambda x: F.size(x) > 0), lambda x: F.struct(words_hash(x).alias("h"), F.size(x).alias("n"))).alias("__lines"), "__w", hashes.alias("__h"),
    )
    low = F.lit((1 << POSITION_BITS) - 1)
    packed = F.sort_array(F.transform("__h", lambda x, i: x.bitwiseAND(F.lit(-1 << POSITION_BITS)).bitwiseOR(i.cast("long"))))
    third = second.withColumn("__s", packed)
    s, h = F.col("__s"), F.col("__h")
    alike = lambda j, k: F.shiftright(s[j].bitwiseXOR(s[k]), POSITION_BITS) == 0
    last = F.size(s) - 1
    met = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & alike(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & alike(j, F.least(j + 1, last))))
    fourth = third.withColumn("__c", F.when(F.size(s) > 1, F.transform(met, lambda j: s[j].bitwiseAND(low).cast("int"))))
    window = lambda i: F.struct(h[i].alias("h"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))
    fifth = fourth.withColumn("__t", F.when(F.size("__c") > 0, F.sort_array(F.transform("__c", window))))
    t = F.col("__t")
    same = lambda j: (t[j]["h"] == t[j - 1]["h"]) & (t[j]["a"] == t[j - 1]["a"]) & (t[j]["b"] == t[j - 1]["b"]) & (t[j]["c"] == t[j - 1]["c"])
    sixth = fifth.withColumn("__j", F.when(F.size(t) > 1, F.filter(F.sequence(F.lit(1), F.size(t) - 1), same)))
    at = F.sort_array(F.array_distinct(F.flatten(F.transform("__j", lambda j: F.array(t[j]["i"], t[j - 1]["i"])))))
    repeat = F.when(F.size("__j") > 0, _covered(F.transform(at, lambda x: x.cast("long")))).otherwise(F.lit(0).cast("long"))
    return sixth.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "__lines")


def common_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Columns host, h of lines that more than max_docs documents of a host have, from rows (host, h, id), one for each line."""
    common = rows.select("host", "h", "id").distinct().groupBy("host", "h").count().where(F.col("count") > max_docs).select("host", "h")
    return as_table(common, "common")


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, the signals, words_left, base_failed, kept."""
    keyed = docs.select(F.col(id_col).alias("id"), _host(host_col).alias("host"), F.col(text_col).alias("__text"))
    table = as_table(signals(keyed, ["id", "host"], "__text").withColumn("rid", F.monotonically_increasing_id()), "signals")
    rows = table.select("rid", "id", "host", F.explode("__lines").alias("l")).select("rid", "id", "host", "l.h", "l.n")
    gone = rows.join(common_lines(rows, max_docs), ["host", "h"]).groupBy("rid").agg(F.sum("n").alias("gone"))
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    kept = ~failed & (left >= MIN_LEFT) & (left >= MIN_SHARE * F.col("n_words"))
    return table.drop("__lines").join(gone, "rid", "left").select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", left.alias("words_left"), failed.alias("base_failed"), kept.alias("kept"))


def without_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs with the common lines taken out of their texts; other texts, null among them, stay as they are. Only marked texts meet a mark."""
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(host_col))
    rows = docs.select(F.col(id_col).alias("id"), _host(host_col).alias("host"), key.alias("key"), F.explode(F.array_distinct(F.transform(lines(F.col(text_col)), line_hash))).alias("h"))
    rows = as_table(rows.where("h is not null"), "lines")
    marks = rows.join(common_lines(rows, max_docs), ["host", "h"]).groupBy(F.col("key").alias("__key")).agg(F.collect_set("h").alias("__gone"))
    joined = docs.withColumn("__key_of", key).join(marks, F.col("__key_of") == F.col("__key"), "left")
    left = F.array_join(F.filter(lines(F.col(text_col)), lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_hash(x)), F.lit(False))), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
split AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
normed AS (SELECT doc_id, host, line, {NORMAL_SQL} AS n, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM split),
full_lines AS (SELECT * FROM normed WHERE nw > 0),
common AS (SELECT host, n FROM full_lines GROUP BY host, n HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN c.n IS NOT NULL THEN nw ELSE 0 END) AS gone
  FROM full_lines f LEFT JOIN common c ON f.host = c.host AND f.n = c.n GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM twice WHERE c > 1) GROUP BY doc_id),
joined AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN by_doc ON d.doc_id = by_doc.doc_id LEFT JOIN repeats ON d.doc_id = repeats.doc_id),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM joined)
SELECT *, NOT base_failed AND words_left >= {MIN_LEFT} AND words_left >= {MIN_SHARE} * n_words AS kept FROM judged
"""
