"""Files, logs, sinks, readers and streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import readers
from paperloom.sources import files, session, sinks
from paperloom.streaming import ledger_stream


def test_bundles(spark, tmp_path):
    for n in ("b.PDF", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"12")
    got = files.list_bundles(spark, str(tmp_path)).collect()
    assert [(r["path"].rpartition("/")[2], r["length"]) for r in got] == [("a.png", 2), ("b.PDF", 2)]


def test_logs(spark, tmp_path):
    (tmp_path / "r.csv").write_text('source_file,page,status,type,destination,timestamp\na.pdf,1,scanned,gas,"x\ny",2024-01-02 03:04:05\na.pdf,,corrected,,d,bad\n')
    got = files.read_results(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["page"], r["destination"], r["type"]) for r in got] == [(1, "x\ny", "gas"), (None, "d", None)]
    assert str(got[0]["timestamp"]) == "2024-01-02 03:04:05" and got[1]["timestamp"] is None
    (tmp_path / "s.json").write_text('{"a.pdf": {"number": "03", "type": "gas"}}')
    assert [tuple(r) for r in files.read_suggestions(spark, str(tmp_path / "s.json")).collect()] == [("a.pdf", "03", "gas")]
    (tmp_path / "bad.json").write_text("{oops")
    assert files.read_suggestions(spark, str(tmp_path / "bad.json")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.append_table(rows, f"{tmp_path}/t", dry_run=True) == 2
    assert not (tmp_path / "t").exists()
    sinks.append_table(rows, f"{tmp_path}/t")
    sinks.append_table(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    new = sinks.upsert(rows, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    assert sorted(map(tuple, new.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    sinks.append_csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    assert spark.createDataFrame([(b"hi",)], "b binary").select(sinks.preview(F.col("b"))).first()[0] == "data:image/jpeg;base64,aGk="
    out = f"{tmp_path}/page"
    pages = spark.createDataFrame([(b"abc", 1, 90, out)], "content binary, page_index int, rotation int, destination string")
    put = lambda path, data: open(path, "wb").write(data)  # noqa: E731, SIM115
    assert [tuple(r) for r in sinks.write_pages(pages, lambda c, i, r: c[i:], put).collect()] == [(out, 2)]


class FakeRenderer:
    def page_count(self, content, path):
        if content == b"bad":
            raise ValueError
        return len(content)

    def render(self, content, path, page_index):
        if page_index == 1:
            raise OSError("torn page")
        return np.zeros((100, 60), np.uint8), np.zeros((340, 204), np.uint8)


class FakeReader:
    def read(self, image):
        return [([(0, 0), (5, 0), (5, 2), (0, 2)], f"{image.shape[0]}x{image.shape[1]}", 0.9)]


def test_readers(spark):
    bundles = spark.createDataFrame([("a.pdf", b"xy"), ("b.pdf", b"bad")], "path string, content binary")
    assert [tuple(r) for r in readers.with_page_counts(bundles, FakeRenderer).orderBy("path").collect()] == [("a.pdf", 2), ("b.pdf", 0)]
    work = bundles.where("path = 'a.pdf'").withColumn("first", F.lit(0)).withColumn("last", F.lit(1))
    got = readers.read_items(work, lambda: (FakeRenderer(), FakeReader())).orderBy("page_index", "rot_idx").collect()
    assert [(r["page_index"], r["rot_idx"], r["items"][0]["text"] if r["items"] else r["error"]) for r in got] == [(0, 0, "45x60"), (0, 1, "27x100"), (0, 2, "27x100"), (0, 3, "45x60"), (1, 0, "OSError: torn page")]
    once = readers.read_items(work.withColumn("last", F.lit(0)), lambda: (FakeRenderer(), FakeReader()), enough=bool)
    assert once.count() == 1

    def asks():
        def ask(image):
            if image == b"bad":
                raise TimeoutError
            return {"type": "gas", "number": "12"}

        return ask

    answers = readers.ask_remote(bundles.withColumnRenamed("content", "image"), asks).orderBy("path").collect()
    assert [tuple(r) for r in answers] == [("a.pdf", "gas", "12"), ("b.pdf", None, None)]


def test_stream_reads_new_files_once(spark, tmp_path):
    schema = spark.range(1).schema
    run = lambda: ledger_stream.run_to_end(ledger_stream.read_files(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/log", f"{tmp_path}/cp")
    spark.range(5).write.parquet(f"{tmp_path}/in/a")
    run()
    run()
    spark.range(5, 8).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == list(range(8))


def test_stream_keeps_order_and_stops(spark, tmp_path):
    """Batches stay in the order they came in, rows in order within; a run that is stopped goes on where it was, and nothing is lost or doubled."""
    spark.range(1).write.parquet(f"{tmp_path}/in/0")
    for i in range(1, 6):
        spark.range(i * 10, i * 10 + 5).orderBy(F.desc("id")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.range(1).schema
    start = lambda: ledger_stream.append_in_order(ledger_stream.read_files(spark, f"{tmp_path}/in/*", schema, files_per_trigger=1), ["id"], f"{tmp_path}/log", f"{tmp_path}/cp")
    ledger_stream.run_until(start(), lambda read: read >= 1, pause=0.05)
    q = start()
    ledger_stream.run_until(q, lambda read: False)
    assert not q.isActive
    got = [tuple(r) for r in ledger_stream.ordered_log(spark, f"{tmp_path}/log", ["id"]).select("batch", "id").collect()]
    assert got == sorted(got) and sorted(i for _, i in got) == [0, *(i * 10 + j for i in range(1, 6) for j in range(5))]


def test_archive_and_progress(spark, tmp_path):
    """Files that are done move to the archive behind the stream; the listener counts rows and sees the end."""
    listener = ledger_stream.Progress()
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.range(10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        schema = spark.range(1).schema
        stream = lambda: ledger_stream.read_files(spark, f"{tmp_path}/in", schema, archive=f"{tmp_path}/done")
        ledger_stream.run_to_end(stream(), f"{tmp_path}/log", f"{tmp_path}/cp")
        spark.range(7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger_stream.run_to_end(stream(), f"{tmp_path}/log", f"{tmp_path}/cp")
        assert spark.read.parquet(f"{tmp_path}/log").count() == 37
        spark.range(1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger_stream.run_to_end(stream(), f"{tmp_path}/log", f"{tmp_path}/cp")
        moved = list((tmp_path / "done").rglob("*.parquet"))
        assert moved and spark.read.parquet(f"{tmp_path}/log").count() == 38
        until = time.time() + 20
        while len(listener.ended) < 1 or sum(listener.rows.values()) < 38:
            assert time.time() < until
            time.sleep(0.1)
        (name,) = listener.rows
        assert listener.rows[name] == 38 and listener.percent(name, 76) == 50 and listener.percent(name, 0) == 0
    finally:
        spark.streams.removeListener(listener)


def test_submitted_once_until_dropped(spark, tmp_path):
    schema = "page string, kind string, at long"
    batches = [[("a", "submit", 1), ("a", "submit", 2), ("b", "submit", 3)], [("a", "submit", 4), ("b", "drop", 5), ("b", "submit", 6)], [("a", "drop", 7), ("c", "drop", 8), ("c", "submit", 9)], [("a", "submit", 10), ("c", "submit", 11)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        events = ledger_stream.read_files(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
        ledger_stream.run_to_end(ledger_stream.submissions(events, "page", "kind", "at"), f"{tmp_path}/log", f"{tmp_path}/cp")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("a", 1), ("a", 10), ("b", 3), ("b", 6), ("c", 9)]


def test_each_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "page long, at string").select("page", F.to_timestamp("at").alias("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    ledger_stream.run_to_end(ledger_stream.each_once(ledger_stream.read_files(spark, f"{tmp_path}/in/*", rows.schema), "page", "at"), f"{tmp_path}/log", f"{tmp_path}/cp")
    assert sorted(r["page"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [1, 2]


def test_append_counts_as_it_writes(spark, tmp_path):
    """The plan of the rows runs once."""
    runs = spark.sparkContext.accumulator(0)

    def seen(parts):
        for p in parts:
            runs.add(len(p))
            yield p

    rows = spark.range(50).mapInPandas(seen, "id long")
    assert sinks.append_table(rows, f"{tmp_path}/t") == 50 and runs.value == 50
    assert sinks.append_table(rows, f"{tmp_path}/t", dry_run=True) == 50 and spark.read.parquet(f"{tmp_path}/t").count() == 50


def test_no_local_folder_on_a_cluster():
    """Without spark.checkpoint.dir a local session gets a temporary folder, a cluster an error, and the setting stays as it is."""

    class Fake:
        def __init__(self, master):
            self.conf = {}
            self.sparkContext = type("C", (), {"master": master, "applicationId": master})()

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_folder(Fake(master))


def test_listings(spark):
    paths = spark.createDataFrame([("o/scanned/Gas Cylinder/1.pdf",), ("o/review/x.PDF",), ("o/discarded/y.pdf",), ("o/scanned/z.pdf",), ("o/review/k.csv",), ("q.pdf",), ("review/scanned/b/7.pdf",), (None,)], "path string")
    got = {tuple(r)[1:] for r in files.pools(paths).collect()}
    assert got == {("scanned", "Gas Cylinder", "1.pdf"), ("review", None, "x.PDF"), ("discarded", None, "y.pdf"), ("scanned", "b", "7.pdf")}
    empty = files.with_total(spark.createDataFrame([], "path string, pages int"), "path", "pages")
    assert empty.count() == 0 and files.row_count(empty).first()["n"] == 0
