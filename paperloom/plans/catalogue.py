"""All ledger queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import params, text
from paperloom.functions.params import Anchor, Band
from paperloom.operators import admission, analytics, candidates, classify, consensus, ledger, routing, scoring
from paperloom.operators import pages as pages_plan
from paperloom.plans import standins as S
from paperloom.sources import files, session, sinks
from paperloom.streaming import ledger_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def query(sql: str | None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Items and page types

NORM = r"upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'SS'))"


@query(S.sql("items", f"SELECT doc_id, item_no, {NORM} AS norm FROM items"))
def normalize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items(spark, sf_dir).select("doc_id", F.col("item_no").cast("long").alias("item_no"), text.normalise(F.col("text")).alias("norm"))


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.65 AS DOUBLE) END AS conf, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents),
d AS (SELECT *, regexp_replace(token, '\D', '', 'g') AS digits FROM t)
SELECT doc_id, token, digits FROM d WHERE conf >= CAST(0.65 AS DOUBLE) AND length(digits) BETWEEN 1 AND 6 AND CAST(length(digits) AS DOUBLE) / length(token) >= CAST(0.6 AS DOUBLE)""")
def candidate_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("doc_id") % 10 == 0, F.lit(0.6)).otherwise(F.lit(0.65))
    tokens = S.table(spark, sf_dir, "documents").select("doc_id", conf.alias("conf"), F.explode(F.split("text", r"\s+", -1)).alias("token"))
    return tokens.withColumn("digits", text.candidate_digits(F.col("token"), F.col("conf"))).where("digits is not null").drop("conf")


#: Markers that occur in the test texts, in the place of the forms' own.
MARKERS = (("LICENSE", "delivery_challan"), ("@", "liquid_nitrogen"), ("###", "liquid_tank_decant"), ("!!", "da_gas"), ("***", "irrelevant:petty_cash_ledger"), ("%%%", "irrelevant:stock_report"))
REQUIRED = ("TH", "QU")
_FLAGS = ", ".join(f"bool_or(contains(norm, '{m}')) AS m{i}" for i, (m, _) in enumerate(MARKERS))
_CASES = " ".join(f"WHEN m{i} THEN '{k}'" for i, (_, k) in enumerate(MARKERS))


@query(rf"""
WITH t AS (SELECT 'documents' AS src, doc_id AS page_id, unnest(string_split(text, chr(10))) AS text FROM documents
           UNION ALL SELECT 'pages', page_id, unnest(string_split(html, chr(10))) FROM pages),
n AS (SELECT *, {NORM} AS norm, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) >= 2 AS prose FROM t),
f AS (SELECT src, page_id, {_FLAGS}, bool_or(contains(norm, 'TH')) AS r0, bool_or(contains(norm, 'QU')) AS r1, bool_or(prose) AS prose FROM n GROUP BY ALL)
SELECT src, page_id, CASE {_CASES} WHEN prose THEN 'other' WHEN r0 AND r1 THEN 'gas_cylinder' ELSE 'other' END AS type FROM f""")
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("page_id"), "text")
    pages = S.table(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), "page_id", F.col("html").alias("text"))
    items = docs.union(pages).select("src", "page_id", F.explode(F.split("text", "\n", -1)).alias("text"))
    return classify.classify_pages(items, ["src", "page_id"], MARKERS, REQUIRED)


@query(S.sql("items", "SELECT doc_id, bool_or(len(regexp_extract_all(text, '[A-Za-z]{3,}')) >= 2) AS prose FROM items GROUP BY doc_id"))
def english_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(text.is_prose(F.col("text"))).alias("prose"))


# Candidates

BANDS = params.BANDS
_BANDS = ", ".join(f"('{b.type}', {b.y_lo}::DOUBLE, {b.y_hi}::DOUBLE, {b.x_min}::DOUBLE, {b.x_max}::DOUBLE, {b.digits_lo}, {b.digits_hi}, {i})" for i, b in enumerate(BANDS))
_IN_BANDS = f"""bands(b_type, y_lo, y_hi, x_min, x_max, digits_lo, digits_hi, region) AS (VALUES {_BANDS}),
inside AS (SELECT c.*, region FROM candidates c JOIN bands ON type = b_type AND x0 BETWEEN x_min * w AND x_max * w AND y0 BETWEEN y_lo * h AND y_hi * h
  AND y1 - y0 BETWEEN 0.02::DOUBLE * h AND 0.15::DOUBLE * h AND length(digits) BETWEEN digits_lo AND digits_hi)"""


@query(S.sql("candidates", f", {_IN_BANDS} SELECT {KEYS}, type, digits, region FROM inside"))
def band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.in_bands(S.candidates(spark, sf_dir), BANDS).select(*S.KEY, "type", "digits", "region")


@query(S.sql("candidates", f"SELECT {KEYS}, digits, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(trunc(y1) AS INT) - CAST(trunc(y0) AS INT) DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM candidates"))
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.ranked(S.candidates(spark, sf_dir), ["l_orderkey"], S.TIE).select(*S.KEY, "digits", "place")


def _anchored(spark: SparkSession, sf_dir: str, anchor: Anchor) -> DataFrame:
    all_ = S.candidates(spark, sf_dir)
    labels = all_.where("is_label").select("l_orderkey", ((F.col("y0") + F.col("y1")) / 2).alias("ly"), F.col("x1").alias("lx1"))
    return candidates.anchored(all_.where("not is_label"), labels, ["l_orderkey"], anchor).select(*S.KEY, "digits")


def _anchor_sql(a: Anchor) -> str:
    right = "AND c.x0 >= l.x1" if a.right_of_label else ""
    return f"""SELECT {KEYS}, digits FROM candidates c WHERE NOT is_label AND x0 BETWEEN {a.x_min}::DOUBLE * w AND {a.x_max}::DOUBLE * w
  AND EXISTS (SELECT 1 FROM candidates l WHERE l.is_label AND l.l_orderkey = c.l_orderkey AND abs((c.y0 + c.y1) / 2 - (l.y0 + l.y1) / 2) <= {a.tolerance}::DOUBLE * c.h {right})"""


@query(S.sql("candidates", _anchor_sql(params.GATE_PASS)))
def label_anchor_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir, params.GATE_PASS)


@query(S.sql("candidates", _anchor_sql(params.CHALLAN)))
def label_anchor_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir, params.CHALLAN)


@query(S.sql("candidates", f""", a AS ({_anchor_sql(params.GATE_PASS)}), b AS ({_anchor_sql(params.CHALLAN)})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE l_orderkey NOT IN (SELECT l_orderkey FROM a)"""))
def fallback_if_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.first_that_finds(_anchored(spark, sf_dir, params.GATE_PASS), _anchored(spark, sf_dir, params.CHALLAN), ["l_orderkey"])


@query(S.sql("candidates", f""", {_IN_BANDS}, one AS (SELECT * FROM inside WHERE type = 'liquid_nitrogen'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, x0, y0, x1, y1 ORDER BY region, l_linenumber, l_partkey, l_suppkey) = 1)
SELECT {KEYS}, digits, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(trunc(y1) AS INT) - CAST(trunc(y0) AS INT) DESC, region, l_linenumber, l_partkey, l_suppkey) AS place FROM one"""))
def dual_region_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = candidates.in_bands(S.candidates(spark, sf_dir).where("type = 'liquid_nitrogen'"), BANDS)
    order = ["region", *S.TIE]
    return candidates.ranked(candidates.distinct_boxes(both, ["l_orderkey"], order), ["l_orderkey"], order).select(*S.KEY, "digits", "place")



@query(S.sql("candidates", f""", wide AS (SELECT {KEYS}, x0, y0, x1 + 10 AS x1, y1 FROM candidates),
p AS (SELECT {KEYS}, greatest(0::DOUBLE, x0 - (x1 - x0) * 0.3::DOUBLE) AS a, greatest(0::DOUBLE, y0 - (y1 - y0) * 0.3::DOUBLE) AS b,
  least(100::DOUBLE, x1 + (x1 - x0) * 0.3::DOUBLE) AS c, least(100::DOUBLE, y1 + (y1 - y0) * 0.3::DOUBLE) AS d FROM wide),
q AS (SELECT {KEYS}, least(340, CAST(trunc(a * 3.4::DOUBLE) AS INT)) AS cx0, least(340, CAST(trunc(b * 3.4::DOUBLE) AS INT)) AS cy0, least(340, CAST(trunc(c * 3.4::DOUBLE) AS INT)) AS cx1, least(340, CAST(trunc(d * 3.4::DOUBLE) AS INT)) AS cy1 FROM p)
SELECT *, CAST(cx1 - cx0 AS DOUBLE) / (cy1 - cy0) <= 4.5::DOUBLE AS readable FROM q WHERE cx1 - cx0 >= 40 AND cy1 - cy0 >= 30"""))
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = S.candidates(spark, sf_dir).withColumn("x1", F.col("x1") + 10)
    out = wide.select(*S.KEY, candidates.crop(F.lit(340), F.lit(340), F.col("w"), F.col("h")).alias("c")).where("c is not null").select(*S.KEY, "c.*")
    return out.withColumn("readable", candidates.readable_shape(F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")))


# Readings

@query(S.sql("candidates", """SELECT l_orderkey, digits, l_discount AS score FROM candidates WHERE regexp_full_match(digits, '\\d{1,6}')
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) = 1"""))
def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.best_read(S.candidates(spark, sf_dir).withColumn("score", F.col("l_discount") + 0.0), ["l_orderkey"], S.TIE)


@query(S.sql("reads voted", f"SELECT {KEYS}, text, votes, variants FROM voted"))
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.vote(S.reads(spark, sf_dir), S.KEY, deal=["l_orderkey"])


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = consensus.select_reading(*(F.col(c) for c in ("nominated", "text", "votes", "variants", "prediction")))
    return S.readings(spark, sf_dir).select(*S.KEY, "nominated", chosen.alias("r")).select(*S.KEY, "nominated", "r.text", "r.votes", "r.variants")


@query(S.sql("reads voted readings", f"SELECT {KEYS}, nominated, text, votes, variants FROM finals"))
def confirm_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(spark, sf_dir)


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(spark, sf_dir).withColumn("status", consensus.status(F.col("text"), F.col("votes"), F.col("variants")))


@query(S.sql("reads voted", f"""SELECT {KEYS}, text, CASE WHEN text IS NULL OR votes < 2 THEN 'unreadable' WHEN votes < variants THEN 'review' ELSE 'accepted' END AS status,
  round(CAST(votes AS DOUBLE) / variants, 6) AS agreement FROM voted"""))
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = consensus.vote(S.reads(spark, sf_dir), S.KEY, deal=["l_orderkey"])
    cols = [F.col(c) for c in ("text", "votes", "variants")]
    return v.select(*S.KEY, "text", consensus.status(*cols).alias("status"), F.round(consensus.agreement(*cols[1:]), 6).alias("agreement"))


@query(S.sql("reads voted readings gated resolved", "SELECT l_orderkey, number, n_accepted FROM pages_resolved"))
def resolve_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.resolve(_gated(spark, sf_dir), ["l_orderkey"])


@query(S.sql("reads voted readings gated", "SELECT l_orderkey, bool_and(status = 'accepted') AS clean FROM gated GROUP BY l_orderkey"))
def file_is_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.is_clean(_gated(spark, sf_dir), ["l_orderkey"])


@query(S.sql("reads voted readings", """, n AS (SELECT l_orderkey, nominated AS x FROM finals UNION SELECT l_orderkey, text FROM finals)
SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS numbers FROM n WHERE x IS NOT NULL GROUP BY l_orderkey"""))
def nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _finals(spark, sf_dir)
    return consensus.nominations(f.withColumnRenamed("nominated", "digits"), f, ["l_orderkey"]).select("l_orderkey", F.array_join("numbers", ",").alias("numbers"))


# Routing

TYPE = "CASE o_orderkey % 11 WHEN 0 THEN 'irrelevant:petty_cash_ledger' WHEN 1 THEN 'other' ELSE o_orderpriority END"
_PAGES = f"""typed AS (SELECT o_custkey, o_orderkey, {TYPE} AS type, o_orderpriority, o_orderstatus, number FROM orders LEFT JOIN pages_resolved ON o_orderkey = l_orderkey)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = consensus.resolve(_gated(spark, sf_dir), ["l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey")
    return S.table(spark, sf_dir, "orders").join(resolved, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.expr(TYPE).alias("type"), "o_orderpriority", "o_orderstatus", "number")


@query(S.sql("reads voted readings gated resolved", f""", {_PAGES}, tagged AS (SELECT *, printf('%d_p%03d.pdf', o_custkey, o_orderkey + 1) AS tag FROM typed)
SELECT o_orderkey, CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' THEN 'discarded' WHEN number IS NOT NULL THEN 'scanned' ELSE 'review' END AS status,
  CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' THEN 'discarded' WHEN number IS NOT NULL THEN 'scanned/' || o_orderpriority ELSE 'review' END AS folder,
  CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' THEN tag WHEN number IS NOT NULL THEN number || '.pdf' ELSE tag END AS name,
  CASE WHEN type LIKE 'irrelevant:%' THEN substr(type, 12) WHEN type = 'other' THEN 'unclassified' END AS kind FROM tagged"""))
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf"))
    r = routing.route(F.col("type"), F.col("number"), F.col("o_orderpriority"), text.page_tag(name, F.col("o_orderkey")), text.extension(name))
    return _typed(spark, sf_dir).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.*")


@query(S.sql("reads voted readings gated resolved", f""", {_PAGES}
SELECT o_orderkey, type, number, number IS NOT NULL AND row_number() OVER (PARTITION BY type, number ORDER BY o_custkey, o_orderkey) > 1 AS repeat FROM typed"""))
def repeat_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.repeats(_typed(spark, sf_dir), ["o_custkey", "o_orderkey"]).select("o_orderkey", "type", "number", "repeat")


@query(S.sql("filed", f""", disk AS (SELECT label, number, count(*) AS n FROM filed WHERE o_orderstatus = 'F' GROUP BY ALL),
p AS (SELECT f.*, row_number() OVER (PARTITION BY f.label, f.number ORDER BY {KEYS}) + coalesce(n, 0) AS place FROM filed f LEFT JOIN disk USING (label, number) WHERE o_orderstatus <> 'F')
SELECT label, {KEYS}, number || CASE WHEN place > 1 THEN '_' || place ELSE '' END || '.pdf' AS name FROM p"""))
def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.filed(spark, sf_dir).withColumnsRenamed({"label": "folder", "number": "stem"}).withColumn("ext", F.lit(".pdf"))
    disk = f.where("o_orderstatus = 'F'").groupBy("folder", "stem").agg(F.count("*").alias("n"))
    out = routing.unique_names(f.where("o_orderstatus <> 'F'"), disk, S.KEY)
    return out.select(F.col("folder").alias("label"), *S.KEY, "name")


@query(r"""
WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$') || CASE page_id % 4 WHEN 0 THEN ' .pdf' WHEN 1 THEN '..pdf' WHEN 2 THEN '.pdf' ELSE '' END AS name FROM pages),
e AS (SELECT *, regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM n)
SELECT page_id, name, ext, regexp_replace(regexp_replace(name[1:length(name) - length(ext)], '^\s+|\s+$', '', 'g'), '\.+$', '') || printf('_p%03d', page_id + 1) || ext AS tag FROM e""")
def page_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("case page_id % 4 when 0 then ' .pdf' when 1 then '..pdf' when 2 then '.pdf' else '' end")
    names = S.table(spark, sf_dir, "pages").select("page_id", F.concat(text.basename(F.col("url")), end).alias("name"))
    return names.select("page_id", "name", text.extension(F.col("name")).alias("ext"), text.page_tag(F.col("name"), F.col("page_id")).alias("tag"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = S.table(spark, sf_dir, "orders").select("o_custkey").distinct()
    done = S.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return routing.not_done(work, done, ["o_custkey"])


@query("""WITH f AS (SELECT o_custkey, count(*) AS pages FROM orders GROUP BY 1), w AS (SELECT o_custkey, unnest(range(pages)) AS page_index FROM f)
SELECT o_custkey, page_index FROM w ORDER BY o_custkey, page_index LIMIT 500""")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("pages"))
    work = routing.work_list(files).select("o_custkey", F.col("page_index").cast("long").alias("page_index"))
    return routing.first_pages(work, ["o_custkey", "page_index"], 500)


@query("""WITH s AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS seen FROM orders GROUP BY 1)
SELECT *, total = seen AS complete FROM s""")
def file_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True))
    pages = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(seen, "o_orderkey", "left")
    return routing.completion(pages, ["o_custkey"], F.col("seen").isNotNull())


# Ledger

STATUS = {"F": "scanned", "O": "review", "P": "discarded"}
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'scanned' WHEN 'O' THEN 'review' ELSE 'discarded' END"


@query(f"WITH v(status) AS (VALUES ('scanned'), ('review'), ('discarded'), ('error')), c AS (SELECT {_STATUS} AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (status)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.zero_filled(S.table(spark, sf_dir, "orders").select(F.expr(_STATUS).alias("status")), "status", ["scanned", "review", "discarded", "error"])


@query(f"""WITH b AS (SELECT o_custkey, count(*) FILTER (WHERE s = 'scanned') AS scanned, count(*) FILTER (WHERE s = 'review') AS review, count(*) FILTER (WHERE s = 'discarded') AS discarded, count(*) FILTER (WHERE s = 'error') AS errors
  FROM (SELECT o_custkey, {_STATUS} AS s FROM orders) GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE review = 0) AS done, CAST(sum(scanned) AS BIGINT) AS scanned, CAST(sum(review) AS BIGINT) AS review, CAST(sum(discarded) AS BIGINT) AS discarded, CAST(sum(errors) AS BIGINT) AS errors FROM b)
SELECT *, scanned + review + discarded > 0 AS started, total > 0 AND total = done AS fully_done FROM t""")
def status_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.table(spark, sf_dir, "orders").select("o_custkey", F.expr(_STATUS).alias("s"))
    return ledger.snapshot(log, "o_custkey", "s", {"scanned": "scanned", "review": "review", "discarded": "discarded", "errors": "error"})


@query("SELECT strftime(o_orderdate, '%Y-%m') AS name, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) > 0")
def month_pending_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending_and_done(S.table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F").orderBy("name")


BOOKS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


@query(f"WITH v(label) AS (VALUES {', '.join(f'({b!r})' for b in BOOKS)}), c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT label, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (label)")
def book_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.zero_filled(S.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("label")), "label", BOOKS)


@query("""SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC, event_id DESC) = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.table(spark, sf_dir, "events")
    return ledger.latest(log, ["user_id"], (F.col("event_type") == "error").cast("int"), "event_id", ["event_id", "event_type"])


@query("""WITH results AS (SELECT user_id AS page, event_type AS type, event_id AS line, 0 AS source_prio FROM events),
rescues AS (SELECT o_custkey AS page, o_orderpriority AS type, o_orderkey AS line, 1 AS source_prio FROM orders WHERE o_orderstatus = 'P'),
both_logs AS (SELECT * FROM results UNION ALL SELECT * FROM rescues)
SELECT page, type, line, source_prio FROM both_logs QUALIFY row_number() OVER (PARTITION BY page ORDER BY source_prio DESC, line DESC) = 1""")
def union_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("type"), F.col("event_id").alias("line"))
    rescues = S.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("line"))
    return ledger.latest(ledger.union_of_logs(results, rescues), ["page"], F.col("source_prio"), "line", ["type", "line", "source_prio"])


@query("""SELECT d.doc_id, l.quality AS detected, CAST(json_extract(e.props, '$.k') AS BIGINT) AS suggested FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN events e ON d.doc_id = e.event_id""")
def review_queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = S.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("detected"))
    suggested = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("suggested"))
    return ledger.review_view(S.table(spark, sf_dir, "documents").select("doc_id"), detected, suggested, "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' WHEN l.toxic = 1 THEN 'toxic' ELSE 'manual' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def discard_reasons_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = S.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("manual").alias("reason"))
    return ledger.discard_view(S.table(spark, sf_dir, "documents").select("doc_id"), reasons, "doc_id")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 7 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS number, o_orderpriority AS book FROM orders WHERE o_orderstatus = 'P')
SELECT o.o_orderkey, coalesce(CASE WHEN regexp_full_match(c.number, '\\d+') THEN c.book END, o.o_orderpriority) AS book, coalesce(CASE WHEN regexp_full_match(c.number, '\\d+') THEN c.number END, CAST(o.o_orderkey AS VARCHAR)) AS number,
  CASE WHEN regexp_full_match(c.number, '\\d+') AND c.number <> CAST(o.o_orderkey AS VARCHAR) THEN 'corrected' ELSE 'unchanged' END AS outcome FROM orders o LEFT JOIN c USING (o_orderkey)""".replace("\\\\d", "\\d"))
def submit_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    fixes = o.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("book"), F.expr("case when o_orderkey % 7 = 0 then concat('x', o_custkey) when o_orderkey % 7 = 1 then cast(o_orderkey as string) else cast(o_custkey as string) end").alias("number"))
    return ledger.corrected(o.select("o_orderkey", F.col("o_orderpriority").alias("book"), F.col("o_orderkey").cast("string").alias("number")), fixes, "o_orderkey")


# Analytics

@query(S.sql("filed dups", "SELECT * FROM dups"))
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.duplicate_groups(S.filed(spark, sf_dir)).orderBy(F.desc("n"), "label", F.expr("try_cast(number as bigint)"))


@query(S.sql("outliers", "SELECT * FROM outs"))
def outlier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outlier_groups(S.numbered_events(spark, sf_dir)).orderBy("label", F.desc("number"))


@query(S.sql("filed dups outliers", """SELECT 'duplicate' AS kind, label, number, n, CAST(NULL AS BIGINT) AS core_lo, CAST(NULL AS BIGINT) AS core_hi FROM dups
UNION ALL SELECT 'outlier', label, CAST(number AS VARCHAR), n, core_lo, core_hi FROM outs"""))
def anomaly_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.anomaly_groups(analytics.duplicate_groups(S.filed(spark, sf_dir)), analytics.outlier_groups(S.numbered_events(spark, sf_dir)))


@query(S.sql("filed dups outliers", "SELECT kind, count(*) AS n_groups FROM (SELECT 'duplicate' AS kind FROM dups UNION ALL SELECT 'outlier' FROM outs) GROUP BY 1"))
def anomaly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.anomaly_totals(anomaly_groups(spark, sf_dir))


@query(S.sql("filed dups", f"SELECT label, number, {KEYS} FROM filed SEMI JOIN dups USING (label, number)"))
def duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.filed(spark, sf_dir).withColumn("number", text.without_suffix(F.concat("number", F.lit("_2"))))
    return analytics.group_items(f, analytics.duplicate_groups(f)).select("label", "number", *S.KEY)


_AI = "CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE lpad(CAST(l_partkey % 50 AS VARCHAR), 3, '0') END"


@query(f"""WITH a AS (SELECT {KEYS}, {_AI} AS number FROM lineitem), n AS (SELECT DISTINCT l_orderkey, regexp_replace(CAST(l_suppkey % 50 AS VARCHAR), '^0+', '') AS z FROM lineitem)
SELECT a.* FROM a WHERE number <> '' AND EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = a.l_orderkey AND n.z = regexp_replace(a.number, '^0+', ''))""")
def agreement_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).where("outcome = 'filed'").drop("outcome")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = S.table(spark, sf_dir, "lineitem")
    answers = l.select(*S.KEY, F.expr(_AI.replace("VARCHAR", "STRING")).alias("number"))
    return ledger.hybrid_split(answers, l.select("l_orderkey", (F.col("l_suppkey") % 50).cast("string").alias("nomination")), "l_orderkey")


@query(f"""WITH a AS (SELECT {KEYS}, {_AI} AS number FROM lineitem), n AS (SELECT DISTINCT l_orderkey, regexp_replace(CAST(l_suppkey % 50 AS VARCHAR), '^0+', '') AS z FROM lineitem)
SELECT CASE WHEN number = '' THEN 'blank' WHEN EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = a.l_orderkey AND n.z = regexp_replace(a.number, '^0+', '')) THEN 'filed' ELSE 'suggested' END AS outcome, count(*) AS n FROM a GROUP BY 1""")
def ai_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


# Models

CLASSES = ("gas_cylinder", "irrelevant", "da_gas", "liquid_nitrogen", "delivery_challan")
COEF = [[((c * 31 + j * 17) % 13 - 6) / 10 for j in range(64)] for c in range(5)]
BIAS = [c / 10 for c in range(5)]
_COEF = "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in COEF) + "]::DOUBLE[][]"
_SCORED = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT vec_id, e, list_sum(e) / len(e) AS mu FROM v),
s AS (SELECT vec_id, e, mu, sqrt(list_sum(list_transform(e, lambda x: (x - mu) * (x - mu))) / len(e)) AS sd FROM m),
z AS (SELECT vec_id, list_transform(e, lambda x: (x - mu) / (sd + 1e-6::DOUBLE)) AS z FROM s),
w AS (SELECT unnest(range(5)) AS c, unnest({_COEF}) AS row),
g AS (SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: z[i] * row[i])) + c / 10 AS g FROM z, w),
p AS (SELECT vec_id, c, g, exp(g - max(g) OVER (PARTITION BY vec_id)) AS x FROM g),
q AS (SELECT vec_id, c, x / sum(x) OVER (PARTITION BY vec_id) AS conf, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, c) AS r FROM p),
scored AS (SELECT vec_id, ['{"', '".join(CLASSES)}'][c + 1] AS label, conf FROM q WHERE r = 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    z = x.select("vec_id", scoring.standardise(F.col("e")).alias("z"))
    g = z.select("vec_id", scoring.logits(F.col("z"), COEF, BIAS).alias("g"))
    return g.select("vec_id", scoring.softmax_best(F.col("g"), CLASSES).alias("b")).select("vec_id", "b.label", "b.conf")


@query(f"WITH {_SCORED} SELECT vec_id, label, round(conf, 6) AS conf FROM scored")
def softmax_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {_SCORED} SELECT vec_id // 4 AS page_id, vec_id % 4 AS rot_idx, label, round(conf, 6) AS conf FROM scored WHERE label <> 'irrelevant' AND conf >= 0.98::DOUBLE
QUALIFY row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id % 4) = 1""")
def rescue_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = _scored(spark, sf_dir).select(F.expr("vec_id div 4").alias("page_id"), (F.col("vec_id") % 4).alias("rot_idx"), "label", "conf")
    return scoring.rescued(turned, ["page_id"]).withColumn("conf", F.round("conf", 6))


_FRAME = "CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 4 WHEN 'signup' THEN 5 ELSE 10 END"


@query(f"""WITH f AS (SELECT user_id, event_id, {_FRAME} AS v FROM events), g AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM f)
SELECT user_id, string_agg(CAST(v - 1 AS VARCHAR), '' ORDER BY event_id) FILTER (WHERE v <> 0 AND (before IS NULL OR before <> v)) AS digits FROM g GROUP BY user_id""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = S.table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.expr(_FRAME).alias("v")).alias("f"))
    rows = frames.groupBy("user_id").agg(F.sort_array(F.collect_list("f")).alias("f")).select("user_id", F.transform("f", lambda x: x["v"]).alias("frames"))
    return rows.select("user_id", scoring.collapse(F.col("frames")).alias("digits"))


@query("""WITH r AS (SELECT vec_id // 4 AS page_id, vec_id % 4 AS rot_idx, CASE WHEN vec_id % 3 = 0 THEN 'other' ELSE 'gas_cylinder' END AS type, CASE WHEN label % 4 = 0 THEN label % 3 ELSE 0 END AS n_cands FROM embeddings)
SELECT page_id, rot_idx, type, n_cands FROM r WHERE n_cands > 0 OR type <> 'other' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN n_cands > 0 THEN 0 ELSE 1 END, rot_idx) = 1""")
def first_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = S.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 4 as page_id", "vec_id % 4 as rot_idx", "case when vec_id % 3 = 0 then 'other' else 'gas_cylinder' end as type", "case when label % 4 = 0 then label % 3 else 0 end as n_cands")
    return classify.first_rotation(scans, ["page_id"])


SETTINGS = (0.2, 0.5, 0.8, 0.98)
_SCORE = "CAST(n_chars % 1000 AS DOUBLE) / 1000"


@query("\nUNION ALL ".join(f"""SELECT {s}::DOUBLE AS setting, count(*) FILTER (WHERE {_SCORE} >= {s}::DOUBLE AND quality = 1) AS tp, count(*) FILTER (WHERE {_SCORE} >= {s}::DOUBLE AND quality <> 1) AS fp,
  count(*) FILTER (WHERE {_SCORE} < {s}::DOUBLE AND quality = 1) AS fn, count(*) FILTER (WHERE {_SCORE} < {s}::DOUBLE AND quality <> 1) AS tn FROM documents JOIN labels USING (doc_id)""" for s in SETTINGS))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.expr(_SCORE).alias("score")).join(S.table(spark, sf_dir, "labels"), "doc_id")
    return analytics.sweep(rows, SETTINGS, F.col("score"), F.col("quality") == 1)


@query("""SELECT coalesce(lang, 'all') AS lang, count(*) AS filed, CAST(sum(quality) AS BIGINT) AS correct, CAST(count(*) - sum(quality) AS BIGINT) AS wrong, round(CAST(sum(quality) AS DOUBLE) / count(*), 6) AS precision
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def precision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "lang").join(S.table(spark, sf_dir, "labels"), "doc_id")
    return analytics.precision(rows, "lang", F.col("quality") == 1)


@query("""WITH r AS (SELECT n_chars % 3 AS a, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE n_chars % 2 END AS b, quality FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN b IS NULL THEN 'declined' WHEN a = b THEN 'agree' WHEN a = quality THEN 'disagree_right' ELSE 'disagree_wrong' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def reader_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(S.table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return analytics.reader_confusion(rows, n % 3, F.when(n % 5 != 0, n % 2), F.col("quality"))


@query("""SELECT CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS bundles FROM documents GROUP BY 1""")
def bundle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.expr("case cast(substr(source, 4) as int) % 5 when 0 then 'test' when 1 then 'valid' else 'train' end")
    by = S.table(spark, sf_dir, "documents").groupBy(split.alias("split"), "source").agg(F.count("*").alias("n"))
    return by.groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("bundles"))


# Calls and streams

@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id, TRUE AS admitted, [t] AS live FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.event_id, len(list_filter(f.live, lambda x: x > o.t - 86400)) < 2,
    CASE WHEN len(list_filter(f.live, lambda x: x > o.t - 86400)) < 2 THEN list_append(list_filter(f.live, lambda x: x > o.t - 86400), o.t) ELSE list_filter(f.live, lambda x: x > o.t - 86400) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, admitted FROM f""")
def rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return admission.admitted(calls, "user_id", cap=2).select("user_id", F.col("id").alias("event_id"), "admitted")


@query("WITH n AS (SELECT max(epoch_us(ts)) AS m FROM events) SELECT user_id, count(*) FILTER (WHERE epoch_us(ts) > m - 86400000000) AS n FROM events, n GROUP BY user_id")
def calls_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    now = calls.agg(F.max("t").alias("now"))
    return analytics.calls_within(calls.crossJoin(F.broadcast(now)), ["user_id"], F.col("now"), 86400 * 1_000_000)


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_stream.append_log(spark, f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_stream.resumed(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")


# A page from its candidates to its place

#: Labels of the test page: order lines returned, of two markers.
_MARK = "CASE l_linenumber % 2 WHEN 1 THEN 'G/P#' ELSE 'DC#' END"
_CHALLAN = f"""challan AS (SELECT * FROM candidates WHERE type = 'delivery_challan'),
marks AS (SELECT l_orderkey, {_MARK} AS marker, (y0 + y1) / 2 AS ly, x1 AS lx1 FROM candidates WHERE is_label),
gp AS (SELECT c.*, 0 AS region FROM challan c WHERE x0 BETWEEN 0.55::DOUBLE * w AND 1.0::DOUBLE * w
  AND EXISTS (SELECT 1 FROM marks m WHERE m.l_orderkey = c.l_orderkey AND m.marker = 'G/P#' AND abs((c.y0 + c.y1) / 2 - m.ly) <= 0.014::DOUBLE * c.h)),
dc AS (SELECT c.*, 0 AS region FROM challan c WHERE x0 BETWEEN 0.0::DOUBLE * w AND 0.5::DOUBLE * w
  AND EXISTS (SELECT 1 FROM marks m WHERE m.l_orderkey = c.l_orderkey AND m.marker = 'DC#' AND abs((c.y0 + c.y1) / 2 - m.ly) <= 0.024::DOUBLE * c.h AND c.x0 >= m.lx1))"""
_FOUND = f"""{_IN_BANDS}, {_CHALLAN},
boxes AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY l_orderkey, x0, y0, x1, y1 ORDER BY region, l_linenumber, l_partkey, l_suppkey) = 1),
found AS (SELECT * FROM boxes UNION ALL SELECT * FROM gp UNION ALL SELECT * FROM dc WHERE l_orderkey NOT IN (SELECT l_orderkey FROM gp))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = S.candidates(spark, sf_dir)
    labels = all_.where("is_label").select("l_orderkey", F.expr(_MARK).alias("marker"), ((F.col("y0") + F.col("y1")) / 2).alias("ly"), F.col("x1").alias("lx1"))
    return candidates.for_type(all_, labels, ["l_orderkey"], S.TIE)


@query(S.sql("candidates", f""", {_FOUND}
SELECT {KEYS}, type, digits, region, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(trunc(y1) AS INT) - CAST(trunc(y0) AS INT) DESC, region, l_linenumber, l_partkey, l_suppkey) AS place FROM found"""))
def candidates_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(*S.KEY, "type", "digits", "region", "place")


_KIND = "CASE o_orderkey % 11 WHEN 0 THEN 'irrelevant:petty_cash_ledger' WHEN 1 THEN 'other' ELSE kind END"
_FOLDERS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in params.FOLDERS.items())


@query(S.sql("candidates reads voted readings gated", f""", {_FOUND}, nominated AS (SELECT DISTINCT {KEYS} FROM found),
kept AS (SELECT g.* FROM gated g SEMI JOIN nominated n USING ({KEYS})),
pages_read AS (SELECT l_orderkey, count(*) AS n_read, CASE WHEN count(DISTINCT text) FILTER (WHERE status = 'accepted') = 1 THEN min(text) FILTER (WHERE status = 'accepted') END AS number FROM kept GROUP BY l_orderkey),
pages_typed AS (SELECT o_custkey, o_orderkey, {_KIND} AS type, coalesce(n_read, 0) AS n_read, number
  FROM (SELECT *, {list(S.TYPES)}[o_orderkey % 5 + 1] AS kind FROM orders) o LEFT JOIN pages_read ON l_orderkey = o_orderkey),
tagged AS (SELECT *, printf('%d_p%03d.pdf', o_custkey, o_orderkey + 1) AS tag, CASE type {_FOLDERS} END AS book FROM pages_typed)
SELECT o_orderkey, type, n_read, number, CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' THEN 'discarded' WHEN number IS NOT NULL THEN 'scanned' ELSE 'review' END AS status,
  CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' THEN 'discarded' WHEN number IS NOT NULL THEN 'scanned/' || book ELSE 'review' END AS folder,
  CASE WHEN type LIKE 'irrelevant:%' OR type = 'other' OR number IS NULL THEN tag ELSE number || '.pdf' END AS name,
  CASE WHEN type LIKE 'irrelevant:%' THEN substr(type, 12) WHEN type = 'other' THEN 'unclassified' END AS kind FROM tagged"""))
def page_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from its type to its place: candidates by type, votes of their reads, the second reader, the gate, one number a page, the route."""
    kind = F.element_at(F.array(*map(F.lit, S.TYPES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    name = F.concat(F.col("o_custkey").cast("string"), F.lit(".pdf"))
    pages = S.table(spark, sf_dir, "orders").withColumn("kind", kind).select("o_orderkey", F.expr(_KIND).alias("type"), text.page_tag(name, F.col("o_orderkey")).alias("tag"), text.extension(name).alias("ext"))
    finals = _finals(spark, sf_dir).join(_found(spark, sf_dir).select(*S.KEY).distinct(), list(S.KEY), "left_semi")
    return pages_plan.decided(pages, finals.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query(S.sql("candidates", f"""SELECT {KEYS}, CAST(trunc(trunc(x0) * 3.4::DOUBLE) AS INT) AS cx0, CAST(trunc(trunc(y0) * 3.4::DOUBLE) AS INT) AS cy0,
  CAST(trunc(trunc(x1) * 3.4::DOUBLE) AS INT) AS cx1, CAST(trunc(trunc(y1) * 3.4::DOUBLE) AS INT) AS cy1 FROM candidates WHERE CAST(trunc(trunc(y1) * 3.4::DOUBLE) AS INT) > CAST(trunc(trunc(y0) * 3.4::DOUBLE) AS INT)"""))
def tight_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.candidates(spark, sf_dir).select(*S.KEY, candidates.tight_crop().alias("c")).where("c is not null").select(*S.KEY, "c.*")


@query(S.sql("candidates", f""", a AS (SELECT {KEYS}, greatest(0, CAST(trunc((x0 + 5 * 0.5::DOUBLE) * 3.4::DOUBLE) AS INT)) AS cx0, greatest(0, CAST(trunc((y0 + 12 * -0.25::DOUBLE) * 3.4::DOUBLE) AS INT)) AS cy0,
  least(340, CAST(trunc((x0 + 5 * 4.0::DOUBLE) * 3.4::DOUBLE) AS INT)) AS cx1, least(340, CAST(trunc((y0 + 12 * 1.25::DOUBLE) * 3.4::DOUBLE) AS INT)) AS cy1 FROM candidates)
SELECT * FROM a WHERE cx1 - cx0 >= 40 AND cy1 - cy0 >= 30"""))
def anchor_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [F.lit(v) for v in (0.5, 4.0, -0.25, 1.25)]
    crop = candidates.anchored_crop(F.col("x0"), F.col("y0"), F.lit(5), F.lit(12), shares, F.lit(340), F.lit(340))
    return S.candidates(spark, sf_dir).select(*S.KEY, crop.alias("c")).where("c is not null").select(*S.KEY, "c.*")


@query("""WITH p AS (SELECT p_partkey, p_size AS width, p_size + 7 AS height FROM part), z(zoom) AS (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE))
SELECT p_partkey, zoom, CAST(round_even(width * zoom, 0) + 48 AS INT) AS zw, CAST(round_even(height * zoom, 0) + 48 AS INT) AS zh, zoom >= 1 AS smooth FROM p, z""")
def zoom_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select("p_partkey", F.inline(candidates.zoomed(F.col("p_size"), F.col("p_size") + 7)))


@query(S.sql("candidates", "SELECT l_orderkey, coalesce(bool_or(x0 <= 0.45::DOUBLE * w AND y0 BETWEEN 0.02::DOUBLE * h AND 0.30::DOUBLE * h AND regexp_replace(t, '[^0-9]', '', 'g') <> ''), FALSE) AS written FROM (SELECT *, CASE WHEN l_partkey % 4 = 0 THEN 'none' ELSE digits END AS t FROM candidates) GROUP BY l_orderkey"))
def blank_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = S.candidates(spark, sf_dir).withColumn("text", F.when(F.col("l_partkey") % 4 == 0, "none").otherwise(F.col("digits")))
    return candidates.column_has_digits(items, ["l_orderkey"])


# Corrections, discards and pools

_DISK = "disk AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'gas_cylinder' WHEN '2-HIGH' THEN 'da_gas' ELSE 'liquid_nitrogen' END AS type, CAST(o_custkey AS VARCHAR) AS stem, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"
_FIXES = """fixes AS (SELECT o_orderkey, o_orderkey || '.pdf' AS source_file, CASE o_orderpriority WHEN '1-URGENT' THEN 'gas_cylinder' WHEN '2-HIGH' THEN 'da_gas' WHEN '3-MEDIUM' THEN 'unknown' ELSE 'liquid_nitrogen' END AS type,
  CASE o_orderkey % 7 WHEN 0 THEN 'x' || o_custkey WHEN 1 THEN ' ' || o_custkey || ' ' ELSE CAST(o_custkey AS VARCHAR) END AS number FROM orders WHERE o_orderstatus <> 'F')"""


def _correction_log(note: str) -> str:
    return f"""WITH {_DISK}, {_FIXES},
valid AS (SELECT *, trim(number) AS stem, CASE type {_FOLDERS} END AS folder FROM fixes WHERE regexp_full_match(trim(number), '[0-9]+') AND type <> 'unknown'),
placed AS (SELECT v.*, row_number() OVER (PARTITION BY v.folder, v.stem ORDER BY o_orderkey) + coalesce(d.n, 0) AS place FROM valid v LEFT JOIN disk d ON d.type = v.type AND d.stem = v.stem)
SELECT source_file, CAST(NULL AS INT) AS page, '{note}' AS status, type, 'scanned/' || folder || '/' || stem || CASE WHEN place > 1 THEN '_' || place ELSE '' END || '.pdf' AS destination, o_orderkey FROM placed"""


def _corrections(spark: SparkSession, sf_dir: str, note: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    disk = o.where("o_orderstatus = 'F'").selectExpr("case o_orderpriority when '1-URGENT' then 'gas_cylinder' when '2-HIGH' then 'da_gas' else 'liquid_nitrogen' end as type", "cast(o_custkey as string) as stem")
    disk = ledger.in_folders(disk).groupBy("folder", "stem").agg(F.count("*").alias("n"))
    kind = "case o_orderpriority when '1-URGENT' then 'gas_cylinder' when '2-HIGH' then 'da_gas' when '3-MEDIUM' then 'unknown' else 'liquid_nitrogen' end as type"
    number = "case o_orderkey % 7 when 0 then concat('x', o_custkey) when 1 then concat(' ', o_custkey, ' ') else cast(o_custkey as string) end as number"
    fixes = o.where("o_orderstatus <> 'F'").selectExpr("o_orderkey", "concat(o_orderkey, '.pdf') as source_file", kind, number, "'.pdf' as ext")
    return ledger.correction_log(fixes, disk, ["o_orderkey"], note)


@query(_correction_log("corrected"))
def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrections(spark, sf_dir, "corrected")


@query(_correction_log("restored"))
def restore_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrections(spark, sf_dir, "restored")


@query("""WITH moved AS (SELECT o_orderkey, o_custkey || '.pdf' AS filename FROM orders WHERE o_orderstatus = 'P'), disk AS (SELECT o_custkey AS stem, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
placed AS (SELECT m.*, replace(filename, '.pdf', '') AS s, row_number() OVER (PARTITION BY filename ORDER BY o_orderkey) + coalesce(n, 0) AS place FROM moved m LEFT JOIN disk d ON m.filename = d.stem || '.pdf')
SELECT filename AS source_file, CAST(NULL AS INT) AS page, 'manual' AS matched_type, 'discarded/' || s || CASE WHEN place > 1 THEN '_' || place ELSE '' END || '.pdf' AS destination, o_orderkey FROM placed""")
def discard_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    disk = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("stem")).agg(F.count("*").alias("n")).withColumn("folder", F.lit("discarded"))
    return ledger.discard_log(o.where("o_orderstatus = 'P'").selectExpr("o_orderkey", "concat(o_custkey, '.pdf') as filename"), disk, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderpriority AS suggestion FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def suggestions_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    return ledger.without(o.select("o_orderkey", F.col("o_orderpriority").alias("suggestion")), o.where("o_orderstatus = 'P'"), ["o_orderkey"])


@query("""WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'out/scanned/' || o_orderpriority || '/' || o_custkey || '.pdf' WHEN 'O' THEN 'out/review/' || o_custkey || '.PDF' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'out/discarded/' || o_custkey || '.pdf' ELSE 'out/discarded/' || o_custkey || '.csv' END END AS path FROM orders)
SELECT path, CASE WHEN path LIKE 'out/scanned/%' THEN 'scanned' WHEN path LIKE 'out/review/%' THEN 'review' ELSE 'discarded' END AS pool, CASE WHEN path LIKE 'out/scanned/%' THEN string_split(path, '/')[3] END AS book, string_split(path, '/')[-1] AS filename
FROM p WHERE lower(path) LIKE '%.pdf'""")
def pool_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "case o_orderstatus when 'F' then concat('out/scanned/', o_orderpriority, '/', o_custkey, '.pdf') when 'O' then concat('out/review/', o_custkey, '.PDF') else if(o_orderkey % 2 = 0, concat('out/discarded/', o_custkey, '.pdf'), concat('out/discarded/', o_custkey, '.csv')) end as path"
    return files.pools(S.table(spark, sf_dir, "orders").selectExpr(path))


@query("WITH f AS (SELECT o_custkey, count(*) AS pages FROM orders GROUP BY 1) SELECT o_custkey, pages, (SELECT CAST(sum(pages) AS BIGINT) FROM f) AS total FROM f")
def input_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_total(S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("pages")), "o_custkey", "pages")


@query("SELECT count(*) AS n FROM events")
def log_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.row_count(S.table(spark, sf_dir, "events"))


@query("SELECT count(DISTINCT o_custkey) AS files FROM orders")
def work_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.file_count(S.table(spark, sf_dir, "orders"), ["o_custkey"])


@query("""WITH f AS (SELECT o_custkey, CAST(count(*) AS INT) AS pages FROM orders GROUP BY 1)
SELECT o_custkey, CAST("first" AS INT) AS "first", CAST(least("first" + 3, pages - 1) AS INT) AS "last" FROM (SELECT *, unnest(range(0, pages, 4)) AS "first" FROM f)""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("pages"))
    return routing.page_ranges(per_file, 4).select("o_custkey", "first", "last")


@query("SELECT DISTINCT o_custkey, o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS done FROM orders")
def done_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = S.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return routing.done_check(S.table(spark, sf_dir, "orders").select("o_custkey").distinct(), marks, ["o_custkey"])


@query(f"""WITH t AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE {list(S.TYPES)}[o_orderkey % 5 + 1] END AS type FROM orders)
SELECT CASE type {_FOLDERS} END AS folder, count(*) AS n FROM t GROUP BY 1""")
def book_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, S.TYPES)), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return ledger.in_folders(S.table(spark, sf_dir, "orders").select(kind.alias("type"))).groupBy("folder").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1) SELECT o_custkey, CAST(floor(done * CAST(100 AS DOUBLE) / total + CAST(0.5 AS DOUBLE)) AS BIGINT) AS percent FROM b""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = S.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return by.select("o_custkey", analytics.percent(F.col("done"), F.col("total")).alias("percent"))


@query("WITH t AS (SELECT event_type, epoch_us(ts) / 1000000 AS s FROM events) SELECT event_type, count(*) AS pages, max(s) - min(s) AS elapsed, round((max(s) - min(s)) / count(*), 6) AS per_page FROM t GROUP BY 1")
def page_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.per_page(S.table(spark, sf_dir, "events"), ["event_type"], F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


# Training tables

@query(S.sql("candidates", f""", log AS (SELECT DISTINCT l_orderkey, CAST(l_partkey AS VARCHAR) AS number FROM lineitem WHERE l_linestatus = 'F')
SELECT log.l_orderkey, log.number, l_linenumber, l_partkey, l_suppkey FROM log JOIN candidates c ON c.l_orderkey = log.l_orderkey AND c.digits = log.number
QUALIFY row_number() OVER (PARTITION BY log.l_orderkey, log.number ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""))
def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", F.col("l_partkey").cast("string").alias("number")).distinct()
    return analytics.truth_join(log, S.candidates(spark, sf_dir), ["l_orderkey"], S.TIE)


_READ = "CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN CAST(l_partkey + 1 AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END"


@query(f"WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS t, {_READ} AS p FROM lineitem) SELECT count(*) FILTER (WHERE t = p) AS correct, count(*) AS total, round(CAST(count(*) FILTER (WHERE t = p) AS DOUBLE) / count(*), 6) AS accuracy FROM r")
def crop_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.read_accuracy(S.table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string"), F.expr(_READ.replace("VARCHAR", "STRING")))


@query(f"SELECT {KEYS}, p AS prediction FROM (SELECT *, {_READ} AS p FROM lineitem) WHERE p IS DISTINCT FROM CAST(l_partkey AS VARCHAR)")
def wrong_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = S.table(spark, sf_dir, "lineitem").select(*S.KEY, F.expr(_READ.replace("VARCHAR", "STRING")).alias("prediction"))
    return analytics.wrong_reads(read, F.col("l_partkey").cast("string"), F.col("prediction"))


_GLYPHS = """strokes AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, l_suppkey AS x, l_discount * 10 AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cut AS (SELECT o_orderkey, number, list_sort(list(x)) AS xs FROM strokes WHERE share >= CAST(0.3 AS DOUBLE) GROUP BY ALL),
seen AS (SELECT o_orderkey, unnest(range(1, len(xs) + 1)) AS i, xs, number FROM cut WHERE len(xs) = length(number)),
glyphs AS (SELECT o_orderkey, substr(number, CAST(i AS INT), 1) AS digit, xs[i] AS x FROM seen)"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    strokes = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select("o_orderkey", F.col("o_custkey").cast("string").alias("number"), F.col("l_suppkey").alias("x"), (F.col("l_discount") * 10).alias("share"))
    return analytics.glyphs(strokes, ["o_orderkey"], "number")


@query(f"WITH {_GLYPHS} SELECT * FROM glyphs")
def glyph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glyphs(spark, sf_dir)


@query(f"WITH {_GLYPHS} SELECT digit, count(*) AS n FROM glyphs GROUP BY 1")
def glyph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glyphs(spark, sf_dir).groupBy("digit").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey * 7919 % 1000003, o_orderkey) - 1) // 64 AS batch FROM orders")
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.training_batches(S.table(spark, sf_dir, "orders").select("o_orderkey"), F.struct(F.col("o_orderkey") * 7919 % 1000003, "o_orderkey"))


@query("SELECT o_orderkey, array_to_string(list_transform(string_split(CAST(o_custkey AS VARCHAR), ''), lambda d: CAST(d AS INT) + 1), ',') AS frames FROM orders")
def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(scoring.encode_label(F.col("o_custkey").cast("string")).cast("array<string>"), ",").alias("frames"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best FROM embeddings")
def frame_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "embeddings").select("vec_id", scoring.arg_max(F.col("embedding")).alias("best"))


# Times, turns, previews, answers

@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", text.log_time(F.col("ts")).alias("at"))


@query("SELECT o_orderkey, (((o_orderkey % 4 * 90) + CASE o_orderkey % 3 WHEN 0 THEN -90 WHEN 1 THEN 270 ELSE 180 END) % 360 + 360) % 360 AS rotation FROM orders")
def turned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.expr("case o_orderkey % 3 when 0 then -90 when 1 then 270 else 180 end")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", text.turned(F.col("o_orderkey") % 4 * 90, by).alias("rotation"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 4 * 90 AS rotation, CASE WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN -90 WHEN 1 THEN 450 ELSE 45 END END AS by_degrees FROM orders)
SELECT o_orderkey, CASE WHEN by_degrees % 90 = 0 THEN ((rotation + by_degrees) % 360 + 360) % 360 ELSE rotation END AS rotation, CASE WHEN by_degrees IS NULL THEN 'unchanged' WHEN by_degrees % 90 = 0 THEN 'turned' ELSE 'refused' END AS outcome FROM t""")
def rotate_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    turns = o.where("o_orderstatus = 'P'").selectExpr("o_orderkey", "case o_orderkey % 3 when 0 then -90 when 1 then 450 else 45 end as degrees")
    return ledger.turned_pages(o.selectExpr("o_orderkey", "o_orderkey % 4 * 90 as rotation"), turns, ["o_orderkey"])


@query("SELECT page_id, 'data:image/jpeg;base64,' || base64(encode(coalesce(html, ''))) AS uri FROM pages")
def preview_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", sinks.preview(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("uri"))


@query(f"""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN 'none' ELSE {list(S.TYPES)}[o_orderkey % 6 + 1] END AS type, CASE o_orderkey % 4 WHEN 0 THEN '12a' WHEN 1 THEN '1234567' WHEN 2 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS number FROM orders)
SELECT o_orderkey, type <> 'none' AND coalesce(regexp_full_match(number, '[0-9]{{1,6}}'), FALSE) AS valid FROM a""")
def valid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 6 == 5, "none").otherwise(F.try_element_at(F.array(*map(F.lit, S.TYPES)), (F.col("o_orderkey") % 6 + 1).cast("int")))
    number = F.expr("case o_orderkey % 4 when 0 then '12a' when 1 then '1234567' when 2 then null else cast(o_custkey as string) end")
    return S.table(spark, sf_dir, "orders").select("o_orderkey", text.valid_answer(kind, number, list(S.TYPES)).alias("valid"))


@query("""WITH b AS (SELECT vec_id, list_transform(range(0, 4), lambda i: embedding[2 * i + 1]) AS xs, list_transform(range(0, 4), lambda i: embedding[2 * i + 2]) AS ys FROM embeddings)
SELECT vec_id, CAST(list_min(xs) AS DOUBLE) AS x0, CAST(list_min(ys) AS DOUBLE) AS y0, CAST(list_max(xs) AS DOUBLE) AS x1, CAST(list_max(ys) AS DOUBLE) AS y1 FROM b""")
def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    box = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(e[i * 2].alias("x"), e[i * 2 + 1].alias("y")))
    return S.table(spark, sf_dir, "embeddings").select("vec_id", candidates.bounds(box).alias("b")).select("vec_id", "b.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"number\":\"' || event_id || '\",\"type\":\"' || event_type || '\"}' AS suggestion FROM events")
def suggestion_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.to_json(F.struct(F.col("event_id").cast("string").alias("number"), F.col("event_type").alias("type")))
    return S.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string", {"mode": "PERMISSIVE"})["k"].alias("k"), told.alias("suggestion"))


# Streams and sinks, written and read back

_STREAM = "CASE WHEN event_type IN ('error', 'signup') THEN 'drop' ELSE 'submit' END"


@query("SELECT event_id, user_id, event_type FROM events")
def stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_stream.ordered_run(spark, f"{sf_dir}/events.parquet", ["event_id"]).select("event_id", "user_id", "event_type")


@query(f"""WITH e AS (SELECT user_id, event_id, {_STREAM} AS kind FROM events), p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id, event_id FROM p WHERE kind = 'submit' AND (before IS NULL OR before = 'drop')""")
def stream_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lambda events: ledger_stream.submissions(events.select("user_id", "event_id", F.expr(_STREAM).alias("kind")), "user_id", "kind", "event_id")
    return ledger_stream.run_plan(spark, f"{sf_dir}/events.parquet", plan)


@query(ORACLE_SQL["rolling_cap"])
def stream_rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = lambda events: events.select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    out = ledger_stream.run_plan(spark, f"{sf_dir}/events.parquet", lambda events: admission.admitted_stream(calls(events), "user_id", cap=2))
    return out.select("user_id", F.col("id").alias("event_id"), "admitted")


@query("SELECT DISTINCT user_id FROM events")
def stream_each_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lambda events: ledger_stream.each_once(events.select("user_id", F.col("ts").cast("timestamp").alias("at")), "user_id", "at").select("user_id")
    return ledger_stream.run_plan(spark, f"{sf_dir}/events.parquet", plan)


@query(f"""SELECT o_custkey || '.pdf' AS source_file, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 40 + 1 AS INT) END AS page, {_STATUS} AS status, o_orderpriority AS type,
  'out "' || o_orderkey || '",' || chr(10) || 'x' AS destination, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders""")
def results_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows appended as CSV in two goes, with quotes, commas and line ends in a name, and read back by their schema."""
    page = "case when o_orderkey % 5 <> 0 then cast(o_orderkey % 40 + 1 as int) end as page"
    rows = S.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 2 as half", "concat(o_custkey, '.pdf') as source_file", page, f"{_STATUS} as status", "o_orderpriority as type", "concat('out \"', o_orderkey, '\",\n', 'x') as destination", "o_orderdate as timestamp")
    path = f"{session.shared_folder(spark)}/results.csv"
    for half in (0, 1):
        sinks.append_csv(rows.where(F.col("half") == half).drop("half"), path)
    return files.read_results(spark, path).select("source_file", "page", "status", "type", "destination", text.log_time(F.col("timestamp")).alias("at"))


@query("""WITH changes AS (SELECT user_id AS k, max(event_type) AS v FROM events GROUP BY 1), old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer)
SELECT k, v FROM changes UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM changes)""")
def suggestions_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("event_type").alias("v"))
    return sinks.upsert(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v")), changes, "k")


@query("SELECT count(*) AS appended, count(*) AS dry, count(*) AS there FROM lineitem")
def append_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a table, counted as they are written; a dry run writes none."""
    rows, path = S.table(spark, sf_dir, "lineitem"), f"{session.shared_folder(spark)}/log"
    n, dry = sinks.append_table(rows, path), sinks.append_table(rows, path, dry_run=True)
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("appended"), F.lit(dry).cast("long").alias("dry"), F.count("*").alias("there"))
