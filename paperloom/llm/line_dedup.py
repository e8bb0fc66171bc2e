"""Line dedup by distinct-site spread.

A HyperLogLog sketch of sites per normalised line merges by aggregation; lines
whose estimate is near the threshold get an exact distinct count. A line that
reaches the threshold is boilerplate: it stays in the document with the
smallest id that has it, as often as it stands there, and goes from all others.
Lines are told apart by the 64-bit hash of their normal form. DataFrame
functions only.

Cases: a null text stays null, an empty one empty; lines without a word never
go; a null site counts as the site ''; equal rows are cleaned alike; a null id
never owns a line while another id has it; if no id has it, all rows keep it;
an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, documents
from .lines import NORMAL_SQL, line_hashes, lines

#: Distinct sites that make a line boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers, and the share around MIN_SITES that is counted exactly: over six standard errors.
LG_K, NEAR = 12, 0.1


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Columns id, key, site, pos, h for each line with a word, written once: texts are split and hashed in one pass."""
    at = F.posexplode(line_hashes(F.col(text_col))).alias("pos", "h")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), at)
    return as_table(rows.where("h is not null"), "lines")


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Columns h, owner from a line table: hash of each line that at least min_sites sites have, and the smallest id that has it."""
    spread = rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.min("id").alias("owner"))
    spread = as_table(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = rows.join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR))
    return as_table(sure.select("h", "owner").union(near.join(exact, "h", "left_semi").select("h", "owner")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with cleaned texts, and a column removed_lines."""
    rows = line_table(docs, id_col, text_col, site_col)
    found = boilerplate(rows, min_sites)
    marks = rows.join(found, "h").where(F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner")))
    marks = marks.groupBy(F.col("key").alias("__key"), F.col("id").alias("__id")).agg(F.collect_set("pos").alias("__gone"))
    keyed = docs.withColumn("__key_of", F.xxhash64(id_col, text_col))
    joined = keyed.join(marks, (F.col("__key_of") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    split = lines(F.col(text_col))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    out = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), split)).withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    cleaned = F.array_join(F.transform("__stay", lambda i: F.col("__lines")[i]), "\n")
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(cleaned)
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "removed_lines"), removed.cast("long").alias("removed_lines"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return remove_boilerplate(docs).select("doc_id", "text", "removed_lines")


OP6_SQL = rf"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
normed AS (SELECT *, {NORMAL_SQL} AS n FROM split),
spread AS (SELECT n, min(doc_id) AS owner FROM normed WHERE n <> '' GROUP BY n HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT doc_id, pos, line, spread.n IS NOT NULL AND doc_id <> owner AS gone FROM normed LEFT JOIN spread USING (n)),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS cleaned,
         count(*) FILTER (WHERE gone) AS removed_lines
  FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE cleaned END AS text, removed_lines
FROM documents JOIN joined USING (doc_id)
"""
