"""Operators on the cases of FIXTURES.md."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import params, text
from paperloom.operators import admission, analytics, candidates, classify, consensus, ledger, routing, scoring


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize(
    ("items", "want"),
    [
        (["DELIVERY CHALLAN"], "delivery_challan"),
        (["CHALLAN OF CASH"], "irrelevant:bank_treasury_challan"),
        (["MCL-ECRLN-015"], "liquid_nitrogen"),
        (["LIQUID TANK DECANT REPORT"], "liquid_tank_decant"),
        (["D/A"], "da_gas"),
        (["Daily Summery Report Plate Form"], "irrelevant:daily_summary"),
        (["OPENING BALANCE", "Delivery  challan"], "delivery_challan"),
        (["oil filter change", "MCL", "CP"], "other"),
        (["oil", "filter"], "other"),
        (["MCL", "CP"], "gas_cylinder"),
        (["MCL"], "other"),
        ([None, ""], "other"),
    ],
)
def test_classify(spark, items, want):
    rows = spark.createDataFrame([(1, t) for t in items], "page int, text string")
    assert [r["type"] for r in classify.classify_pages(rows, ["page"]).collect()] == [want]


def test_candidate_digits(spark):
    cases = [("035", 0.92, "035"), ("1888", 0.649, None), ("1888", 0.65, "1888"), ("12-07-26", 0.9, "120726"), ("1234567", 0.9, None), ("No 12", 0.9, None), ("A", 0.9, None), (" 12 ", 0.9, "12"), ("٣٤5", 0.9, "٣٤5"), (None, 0.9, None), ("1", None, None)]
    got = values(spark, [c[:2] for c in cases], "t string, c double", text.candidate_digits(F.col("t"), F.col("c")))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_names(spark):
    cases = [("scan .pdf", "scan", ".pdf"), ("a..pdf", "a", ".pdf"), ("a ..pdf", "a ", ".pdf"), (".pdf", ".pdf", ""), ("plain", "plain", ""), ("..x", "..x", ""), ("a.b.c", "a.b", ".c"), ("x.", "x", ".")]
    got = values(spark, [(c[0],) for c in cases], "n string", text.output_stem(F.col("n")), text.extension(F.col("n")))
    assert got == [c[1:] for c in cases]
    assert values(spark, [("scan.pdf", 0), ("scan.pdf", 1233)], "n string, i int", text.page_tag(F.col("n"), F.col("i"))) == [("scan_p001.pdf",), ("scan_p1234.pdf",)]


def test_scalars(spark):
    agree = [("03", "3", True), ("0", "00", True), ("", "0", False), ("12", "13", False), (None, "1", False)]
    assert values(spark, [a[:2] for a in agree], "a string, b string", text.agree(F.col("a"), F.col("b"))) == [(a[2],) for a in agree]
    assert values(spark, [(0, -90), (270, 180)], "a int, b int", text.turned(F.col("a"), F.col("b"))) == [(270,), (90,)]
    assert values(spark, [("irrelevant:a:b",), ("other",)], "t string", text.kind_of(F.col("t"))) == [("a:b",), (None,)]
    assert values(spark, [("12_2",), ("12_2_3",), ("12",)], "t string", text.without_suffix(F.col("t"))) == [("12",), ("12_2",), ("12",)]
    assert values(spark, [("gas", "12"), ("none", "12"), ("gas", "1234567"), (None, None)], "t string, n string", text.valid_answer(F.col("t"), F.col("n"), ["gas"])) == [(True,), (False,), (False,), (False,)]


BOX = "page int, item_no int, x0 double, y0 double, x1 double, y1 double, digits string, w double, h double, type string"


def box(no, x0, y0, height=30.0, digits="12", type_="gas_cylinder"):
    return (1, no, float(x0), float(y0), x0 + 50.0, y0 + height, digits, 1500.0, 1000.0, type_)


def test_bands(spark):
    rows = [box(0, 900, 110), box(1, 900, 111), box(2, 825, 50), box(3, 900, 50, 19.0), box(4, 900, 50, 20.0), box(5, 300, 150, type_="liquid_nitrogen"), box(6, 1200, 150, 40.0, "123", "liquid_nitrogen"), box(7, 1200, 150, 40.0, "12", "liquid_nitrogen")]
    got = candidates.in_bands(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(r["item_no"] for r in got) == [0, 4, 5, 6]
    both = candidates.in_bands(spark.createDataFrame(rows[5:7], BOX))
    assert [r["item_no"] for r in candidates.ranked(both, ["page"], ["region", "item_no"]).orderBy("place").collect()] == [6, 5]


def test_anchors(spark):
    rows = spark.createDataFrame([box(0, 900, 69), box(1, 900, 69.6), box(2, 600, 37), box(3, 20, 37)], BOX)
    label = spark.createDataFrame([(1, 70.0, 100.0), (1, 70.0, 400.0)], "page int, ly double, lx1 double")
    find = lambda a, l=label: sorted(r["item_no"] for r in candidates.anchored(rows, l, ["page"], a).collect())
    assert find(params.GATE_PASS) == [0]
    assert find(params.CHALLAN) == [2]
    assert find(params.CHALLAN, label.where("lx1 > 1000")) == []
    first = candidates.anchored(rows, label, ["page"], params.GATE_PASS)
    second = candidates.anchored(rows, label, ["page"], params.CHALLAN)
    assert [r["item_no"] for r in candidates.first_that_finds(first, second, ["page"]).collect()] == [0]
    assert [r["item_no"] for r in candidates.first_that_finds(first.where("false"), second, ["page"]).collect()] == [2]


def test_boxes(spark):
    df = spark.createDataFrame([([(3.0, 1.0), (9.0, 2.0), (8.0, 7.0), (2.0, 6.0)],)], "box array<struct<x double, y double>>")
    assert tuple(df.select(candidates.bounds(F.col("box")).alias("b")).select("b.*").first()) == (2.0, 1.0, 9.0, 7.0)
    same = spark.createDataFrame([box(1, 5, 5), box(0, 5, 5), box(2, 6, 5)], BOX)
    assert sorted(r["item_no"] for r in candidates.distinct_boxes(same, ["page"], ["item_no"]).collect()) == [0, 2]


def test_votes(spark):
    zooms = {1: ["726", "726", "726"], 2: ["12", None, "12"], 3: ["1", "2", "3"], 4: [None] * 3, 5: ["9", "8", "8"]}
    rows = [(c, i, t) for c, ts in zooms.items() for i, t in enumerate(ts)]
    got = {r["crop"]: (r["text"], r["votes"], r["variants"]) for r in consensus.vote(spark.createDataFrame(rows, "crop int, zoom_idx int, text string"), ["crop"]).collect()}
    assert got == {1: ("726", 3, 3), 2: ("12", 2, 3), 3: ("1", 1, 3), 4: (None, None, None), 5: ("8", 2, 3)}


def test_best_read(spark):
    rows = spark.createDataFrame([(1, 0, "12", 0.8), (1, 1, "13", 0.8), (1, 2, "1234567", 0.9), (2, 0, "x", 0.9)], "img int, item_no int, digits string, score double")
    assert [tuple(r) for r in consensus.best_read(rows, ["img"], ["item_no"]).collect()] == [(1, "12", 0.8)]


READING = "nominated string, text string, votes long, variants long, prediction string"


def select(spark, rows):
    got = spark.createDataFrame(rows, READING).select(consensus.select_reading(*(F.col(c) for c in ("nominated", "text", "votes", "variants", "prediction"))).alias("r"))
    return [tuple(x["r"]) if x["r"] else None for x in got.collect()]


def test_confirm(spark):
    rows = [("35", "35", 3, 3, "99"), ("35", "36", 2, 3, "36"), ("35", "36", 2, 3, "35"), ("35", "36", 2, 3, "99"), ("35", "35", 2, 3, "35"), ("35", None, None, None, None)]
    assert select(spark, rows) == [("35", 3, 3), ("36", 2, 2), ("35", 2, 2), None, ("35", 2, 2), None]


def test_confirm_never_yields_a_third_value(spark):
    opts = ["1", "2", "3", None]
    rows = [(n, t, v if t else None, 3 if t else None, p) for n, t, v, p in itertools.product(opts[:3], opts, (1, 2, 3), opts)]
    for (n, t, *_), got in zip(rows, select(spark, rows), strict=True):
        assert got is None or got[0] in (n, t)


def test_gate_and_resolve(spark):
    rows = [(1, "12", 3, 3), (2, "12", 3, 3), (2, None, None, None), (3, "12", 3, 3), (3, "13", 3, 3), (4, "12", 3, 3), (4, "12", 2, 2), (5, "7", 2, 3), (6, "7", 1, 3)]
    df = spark.createDataFrame(rows, "page int, text string, votes long, variants long").withColumn("status", consensus.status(F.col("text"), F.col("votes"), F.col("variants")))
    assert [r["status"] for r in df.collect()] == ["accepted", "accepted", "unreadable", "accepted", "accepted", "accepted", "accepted", "review", "unreadable"]
    assert {r["page"]: r["number"] for r in consensus.resolve(df, ["page"]).collect()} == {1: "12", 2: "12", 3: None, 4: "12", 5: None, 6: None}
    assert {r["page"]: r["clean"] for r in consensus.is_clean(df, ["page"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_route_is_total(spark):
    rows = [(t, n) for t in ("gas_cylinder", "other", "irrelevant:petty_cash_ledger") for n in ("12", None)]
    df = spark.createDataFrame(rows, "type string, number string")
    got = df.select(routing.route(F.col("type"), F.col("number"), F.lit("Gas Cylinder"), F.lit("s_p001.pdf"), F.lit(".pdf")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("scanned", "scanned/Gas Cylinder", "12.pdf", None), ("review", "review", "s_p001.pdf", None), *[("discarded", "discarded", "s_p001.pdf", "unclassified")] * 2, *[("discarded", "discarded", "s_p001.pdf", "petty_cash_ledger")] * 2]


def test_names_and_work(spark):
    new = spark.createDataFrame([("d", "12", ".pdf", 1), ("d", "12", ".pdf", 2), ("d", "13", ".pdf", 3)], "folder string, stem string, ext string, i int")
    disk = spark.createDataFrame([("d", "12", 2)], "folder string, stem string, n int")
    assert sorted(r["name"] for r in routing.unique_names(new, disk, ["i"]).collect()) == ["12_3.pdf", "12_4.pdf", "13.pdf"]
    files = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "path string, pages int")
    work = routing.work_list(routing.not_done(files, spark.createDataFrame([("c",)], "path string"), ["path"]))
    assert [(r["path"], r["page_index"]) for r in work.collect()] == [("a", 0), ("a", 1)]


def test_duplicates_and_outliers(spark):
    f = lambda rows: spark.createDataFrame([("b", x) for x in rows], "label string, number string")
    assert [tuple(r) for r in analytics.duplicate_groups(f(["3", "03", "3", "3", "x"]), 2).collect()] == [("b", "3", 3)]
    assert analytics.outlier_groups(f([str(i) for i in range(1, 20)])).count() == 0
    got = analytics.outlier_groups(f([*(str(i) for i in range(1, 21)), "500", "0500", "99999999999999999999"])).collect()
    assert [tuple(r) for r in got] == [("b", 500, 2, 2, 19)]


def _mixed(batches):
    import numpy as np
    import pyarrow as pa

    t = pa.Table.from_batches(batches)
    yield from t.take(np.random.default_rng().permutation(len(t))).to_batches()


def test_core_of_large_books(spark):
    """The core's ends are exact ranks, though each reading of the numbers gives them in another order."""
    n = 100_000
    rows = spark.range(2 * n, numPartitions=1).selectExpr("concat('b', id % 2) as label", "id div 2 as number").mapInArrow(_mixed, "label string, number long")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert sorted(tuple(r) for r in analytics.core_ranges(rows).collect()) == [(b, n // 20, n * 19 // 20 - 1) for b in ("b0", "b1")]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_anomalies_without_label(spark):
    """Numbers without a label are judged as one book, for both kinds."""
    rows = [(b, str(i)) for b in (None, "b") for i in [*range(1, 21), 500, 500, 500]]
    f = spark.createDataFrame(rows, "label string, number string")
    got = analytics.anomaly_groups(analytics.duplicate_groups(f), analytics.outlier_groups(f)).collect()
    assert {tuple(r) for r in got} == {x for b in (None, "b") for x in (("duplicate", b, "500", 3, None, None), ("outlier", b, "500", 3, 2, 19))} and len(got) == 4


def test_collapse(spark):
    df = spark.createDataFrame([([0, 5, 5, 0, 5, 3, 3, 0, 1],), ([0, 0],), ([],), (None,)], "f array<int>")
    assert [r[0] for r in df.select(scoring.collapse(F.col("f"))).collect()] == ["4420", None, None, None]


def test_rescue(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.98), (1, 1, "b", 0.999), (2, 0, "a", 0.9799), (3, 0, "irrelevant", 1.0)], "page int, rot_idx int, label string, conf double")
    assert [tuple(r) for r in scoring.rescued(rows, ["page"]).collect()] == [(1, 0, "a", 0.98)]


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([800.0, 0.0, 0.0],)], "g array<double>")
    got = df.select(scoring.softmax_best(F.col("g"), ["a", "b", "c"]).alias("b")).select("b.*").collect()
    assert [r["label"] for r in got] == ["b", "a"]
    assert got[0]["conf"] == pytest.approx(1 / (2 + 2.718281828**-2))
    z = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(scoring.standardise(F.col("x"))).first()[0]
    assert z == pytest.approx([-1.2247433, 0.0, 1.2247433], abs=1e-5)


def test_cap_fixture():
    assert admission.admit([0, 10, 20, 86400, 86405, 86411], 2, 86400)[0] == [True, True, False, True, False, True]


@given(st.lists(st.floats(0, 1000), max_size=40), st.integers(1, 4))
@settings(max_examples=50, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_cap_holds(times, cap):
    times.sort()
    flags, _ = admission.admit(times, cap, 100)
    ok = [t for t, f in zip(times, flags, strict=True) if f]
    assert all(sum(t - 100 < u <= t for u in ok if u <= t) <= cap or ok.count(t) > 1 for t in ok)


def test_cap_stream_is_batch(spark, tmp_path):
    rows = [(u, i, float(i * 7 % 50 + 10 * u)) for u in (1, 2) for i in range(30)]
    rows.sort(key=lambda r: r[2])
    schema = "user_id int, id int, t double"
    spark.createDataFrame(rows[:30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = admission.admitted_stream(stream, "user_id", 2, 20.0).writeStream.format("memory").queryName("cap").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = admission.admitted(spark.createDataFrame(rows, schema), "user_id", 2, 20.0)
    assert sorted(map(tuple, spark.table("cap").collect())) == sorted(map(tuple, batch.collect()))


def test_corrections(spark):
    filed = spark.createDataFrame([(1, "a", "5"), (2, "a", "6"), (3, "b", "7"), (4, "b", "8")], "k int, book string, number string")
    fixes = spark.createDataFrame([(1, "a", "5"), (2, "b", "06"), (3, "b", "x")], "k int, book string, number string")
    assert sorted(map(tuple, ledger.corrected(filed, fixes, "k").collect())) == [(1, "a", "5", "unchanged"), (2, "b", "06", "corrected"), (3, "b", "7", "unchanged"), (4, "b", "8", "unchanged")]


def test_repeats_without_numbers(spark):
    """Unread pages never repeat and meet in no task of their own; one number may have most pages."""
    rows = [("gas", None, i, 0) for i in range(50)] + [("gas", "12", i, 1) for i in range(40)] + [("da", "12", 3, 1), (None, "12", 4, 1), (None, "12", 2, 1), (None, None, 1, 1)]
    df = spark.createDataFrame(rows, "type string, number string, path long, page int").repartition(5)
    got = {(r["type"], r["number"], r["path"]): r["repeat"] for r in routing.repeats(df, ["path", "page"]).collect()}
    assert len(got) == len(rows)
    for k, v in got.items():
        assert v == (k[1] is not None and any(o[0] == k[0] and o[1] == k[1] and o[2] < k[2] for o in got))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbered_across_tasks(spark, parts):
    """One key may have most rows: its places go on from task to task."""
    rows = [("a" if i % 5 else "b", i % 7, i) for i in range(300)] + [(None, 1, 1000), (None, 0, 1001)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(4)
    got = sorted(((r["k"] or "", r["n"]), (r["o"], r["i"])) for r in routing.numbered(df, ["k"], ["o", "i"], "n", parts).collect())
    want = []
    for k in ("", "a", "b"):
        own = sorted((o, i) for x, o, i in rows if (x or "") == k)
        want += [((k, n + 1), r) for n, r in enumerate(own)]
    assert got == want
    assert routing.numbered(df.limit(0), ["k"], ["o"], "n", parts).count() == 0


def test_attempts_without_a_key_stay(spark):
    rows = spark.createDataFrame([("a", 1, 0.0), (None, 2, 1.0), ("a", 3, 2.0), (None, 4, 3.0)], "k string, id long, t double")
    got = {r["id"]: r["admitted"] for r in admission.admitted(rows, "k", cap=1).collect()}
    assert got == {1: True, 2: None, 3: False, 4: None}


def test_for_type(spark):
    """Bands, both anchors in turn, and types without a rule, side by side."""
    c = "page long, i int, type string, digits string, x0 double, y0 double, x1 double, y1 double, w double, h double"
    rows = [
        (1, 0, "gas_cylinder", "12", 60.0, 5.0, 70.0, 10.0, 100.0, 100.0), (1, 1, "gas_cylinder", "13", 10.0, 5.0, 70.0, 10.0, 100.0, 100.0),
        (2, 0, "delivery_challan", "7", 60.0, 50.0, 65.0, 53.0, 100.0, 100.0), (2, 1, "delivery_challan", "8", 30.0, 60.0, 35.0, 63.0, 100.0, 100.0),
        (3, 0, "delivery_challan", "9", 30.0, 60.0, 35.0, 63.0, 100.0, 100.0), (4, 0, "other", "5", 60.0, 5.0, 70.0, 10.0, 100.0, 100.0),
    ]
    labels = spark.createDataFrame([(2, "G/P#", 51.5, 20.0), (2, "DC#", 61.5, 20.0), (3, "DC#", 61.5, 20.0)], "page long, marker string, ly double, lx1 double")
    got = candidates.for_type(spark.createDataFrame(rows, c), labels, ["page"], ["i"])
    assert sorted((r["page"], r["digits"], r["place"]) for r in got.collect()) == [(1, "12", 1), (2, "7", 1), (3, "9", 1)]


def test_zooms(spark):
    got = spark.range(1).select(candidates.zoomed(F.lit(101), F.lit(40)).alias("z")).first()["z"]
    assert [(r["zoom"], r["zw"], r["zh"], r["smooth"]) for r in got] == [(0.8, 81 + 48, 32 + 48, False), (1.0, 149, 88, True), (1.2, 121 + 48, 48 + 48, True)]


def test_label_codes(spark):
    """What is encoded and set between blanks is read back."""
    for label in ("4420", "0", "998877"):
        df = spark.createDataFrame([(label,)], "l string").select(scoring.encode_label(F.col("l")).alias("e"))
        spaced = F.flatten(F.transform("e", lambda v: F.array(F.lit(0), v, v)))
        assert df.select(scoring.collapse(spaced)).first()[0] == label


def test_correction_rows(spark):
    fixes = spark.createDataFrame([(1, "a.pdf", "gas_cylinder", " 12 ", ".pdf"), (2, "b.pdf", "gas_cylinder", "12", ".pdf"), (3, "c.pdf", "nothing", "12", ".pdf"), (4, "d.pdf", "da_gas", "1x", ".pdf"), (5, "e.pdf", None, "1", ".pdf"), (6, "f.pdf", "da_gas", None, ".pdf")], "at int, source_file string, type string, number string, ext string")
    taken = spark.createDataFrame([("Gas Cylinder", "12", 1)], "folder string, stem string, n long")
    got = [(r["source_file"], r["page"], r["status"], r["destination"]) for r in ledger.correction_log(fixes, taken, ["at"], "renamed").orderBy("at").collect()]
    assert got == [("a.pdf", None, "renamed", "scanned/Gas Cylinder/12_2.pdf"), ("b.pdf", None, "renamed", "scanned/Gas Cylinder/12_3.pdf")]
    moved = spark.createDataFrame([(1, "12.pdf"), (2, "12.pdf"), (3, "k")], "at int, filename string")
    got = [(r["matched_type"], r["destination"]) for r in ledger.discard_log(moved, taken.limit(0), ["at"]).orderBy("at").collect()]
    assert got == [("manual", "discarded/12.pdf"), ("manual", "discarded/12_2.pdf"), ("manual", "discarded/k")]
    assert sorted(r[0] for r in ledger.without(moved, moved.where("at = 3"), ["filename"]).select("at").collect()) == [1, 2]
