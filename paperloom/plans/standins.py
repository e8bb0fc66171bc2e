"""Test tables dressed as the records of the ledger: columns stand in, semantics stay.

Each DataFrame function has a SQL twin of the same name in SQL, used in WITH clauses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("gas_cylinder", "da_gas", "liquid_nitrogen", "liquid_tank_decant", "delivery_challan")
TIE = ("l_linenumber", "l_partkey", "l_suppkey")
KEY = ("l_orderkey", *TIE)
ZOOMS = (8, 10, 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as the text boxes of a page."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("item_no", "text"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes on a page of 100 by 100."""
    t = F.col("l_tax") * 100 + 0.0
    return table(spark, sf_dir, "lineitem").select(
        *KEY, F.col("l_partkey").cast("string").alias("digits"), (F.col("l_suppkey") % 100).cast("double").alias("x0"), F.col("l_quantity").alias("y0"),
        ((F.col("l_suppkey") % 100) + 5).cast("double").alias("x1"), (F.col("l_quantity") + t).alias("y1"), F.lit(100.0).alias("w"), F.lit(100.0).alias("h"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("type"), (F.col("l_returnflag") == "R").alias("is_label"), F.col("l_discount").alias("l_discount"), "l_quantity",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three zooms read each order line: columns KEY, zoom_idx, text (null for some), q (what the second reader goes by)."""
    q = F.col("l_quantity").cast("long")
    lines = table(spark, sf_dir, "lineitem").select(*KEY, q.alias("q"), F.posexplode(F.array(*map(F.lit, ZOOMS))).alias("zoom_idx", "zoom"))
    text = F.when((F.col("l_partkey") + F.col("zoom")) % 11 != 0, F.expr("q * zoom div 100").cast("string"))
    return lines.select(*KEY, "zoom_idx", text.alias("text"), "q")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each line after votes: KEY, text, votes, variants, nominated, prediction. Equal keys are one crop."""
    from paperloom.operators.consensus import vote

    voted = vote(reads(spark, sf_dir), KEY, deal=["l_orderkey"], carry=["q"])
    return voted.select(*KEY, "text", "votes", "variants", F.expr("cast(q * 10 div 100 as string)").alias("nominated"), F.expr("cast(q * 8 div 100 as string)").alias("prediction"))


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as filed pages: book (label) is the priority, number the part."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderpriority").alias("label"), F.col("l_partkey").cast("string").alias("number"), *KEY, "o_custkey", "o_orderstatus")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.floor(F.col("value") * 100).cast("string").alias("number"))


#: SQL twins. reads has one row for each line and zoom, numbered from 0.
SQL = {
    "items": "items AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS item_no FROM documents)",
    "candidates": """candidates AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey AS VARCHAR) AS digits, CAST(l_suppkey % 100 AS DOUBLE) AS x0, l_quantity AS y0,
  CAST(l_suppkey % 100 + 5 AS DOUBLE) AS x1, l_quantity + (l_tax * 100 + CAST(0 AS DOUBLE)) AS y1, CAST(100 AS DOUBLE) AS w, CAST(100 AS DOUBLE) AS h,
  ['gas_cylinder', 'da_gas', 'liquid_nitrogen', 'liquid_tank_decant', 'delivery_challan'][l_orderkey % 5 + 1] AS type, l_returnflag = 'R' AS is_label, l_discount, l_quantity FROM lineitem)""",
    "reads": """lined AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
reads AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z.zoom_idx, CASE WHEN (l_partkey + z.zoom) % 11 <> 0 THEN CAST(q * z.zoom // 100 AS VARCHAR) END AS text
  FROM lined, (VALUES (0, 8), (1, 10), (2, 12)) AS z(zoom_idx, zoom))""",
    "voted": """by_text AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, text, count(*) AS votes, min(zoom_idx) AS first FROM reads GROUP BY ALL),
totals AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(votes) AS variants FROM by_text GROUP BY ALL),
best AS (SELECT * FROM by_text WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY votes DESC, first) = 1),
voted AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, text, CAST(votes AS BIGINT) AS votes, CAST(CASE WHEN text IS NOT NULL THEN variants END AS BIGINT) AS variants
  FROM totals LEFT JOIN best USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))""",
    "readings": """one AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(q) AS q FROM lined GROUP BY ALL),
readings AS (SELECT voted.*, CAST(q * 10 // 100 AS VARCHAR) AS nominated, CAST(q * 8 // 100 AS VARCHAR) AS prediction FROM voted JOIN one USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)),
selected AS (SELECT *, text IS NOT NULL AND votes = variants AS is_full,
    coalesce(prediction = nominated, FALSE) OR coalesce(text <> nominated AND prediction = text, FALSE) AS confirmed FROM readings),
finals AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nominated,
    CASE WHEN is_full THEN text WHEN confirmed THEN prediction END AS text, CASE WHEN is_full THEN votes WHEN confirmed THEN 2 END AS votes, CASE WHEN is_full THEN variants WHEN confirmed THEN 2 END AS variants FROM selected)""",
    "gated": """gated AS (SELECT *, CASE WHEN text IS NULL OR votes < 2 THEN 'unreadable' WHEN votes < variants THEN 'review' ELSE 'accepted' END AS status FROM finals)""",
    "resolved": """pages_resolved AS (SELECT l_orderkey, CASE WHEN count(DISTINCT text) FILTER (WHERE status = 'accepted') = 1 THEN min(text) FILTER (WHERE status = 'accepted') END AS number,
    count(*) FILTER (WHERE status = 'accepted') AS n_accepted FROM gated GROUP BY l_orderkey)""",
    "filed": """filed AS (SELECT o_orderpriority AS label, CAST(l_partkey AS VARCHAR) AS number, l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "dups": "dups AS (SELECT label, number, count(*) AS n FROM filed GROUP BY ALL HAVING count(*) >= 3)",
    "outliers": """nums AS (SELECT event_type AS label, CAST(floor(value * 100) AS BIGINT) AS number, count(*) AS n FROM events WHERE floor(value * 100) >= 0 GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY label) AS u FROM nums),
cores AS (SELECT *, max(CASE WHEN i = u // 20 THEN number END) OVER (PARTITION BY label) AS core_lo, max(CASE WHEN i = u * 19 // 20 - 1 THEN number END) OVER (PARTITION BY label) AS core_hi FROM ranks WHERE u >= 20),
outs AS (SELECT label, number, n, core_lo, core_hi FROM cores
  WHERE number < core_lo - CAST(0.5 AS DOUBLE) * greatest(1, core_hi - core_lo) OR number > core_hi + CAST(0.5 AS DOUBLE) * greatest(1, core_hi - core_lo))""",
}


def sql(names: str, query: str) -> str:
    """A query over the named twins."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
