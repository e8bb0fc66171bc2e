"""Chat, Merkle trees, line dedup and quality rules: against SQL, plain Python and their stated cases."""

import gzip
import hashlib
import io
import random
import re
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat, line_dedup, merkle, quality, warc
from paperloom.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, source string, fp int, h string, key string, id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 9) for i, t, s in rows], DOCS)


def plain(df):
    return sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert plain(QUERIES[name](spark, sf_dir).toPandas()) == plain(con.sql(ORACLE_SQL[name]).df().astype(object))


def test_plans_are_native(spark, sf_dir):
    for name in ("op1_merkle", "op3_chat", "op6_line_spread", "op7_line_frequency"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Chat

ODD = ["<|im_end|>", r"<\|im_end|>", "<<|", "a<", "|b", "<|im_sep|>x<|nl|>", "", None, "\n<|im_start|>user\n", "é😀" * 50, "x" * 100_000]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in ODD if t], "t string")
    for t, e, u in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert u == t and "<|" not in e


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "assistant", "a\nb<|", None]
    rows = [(c, i, roles[(i * (c + 1)) % 5], t) for c in range(5) for i, t in enumerate(ODD)] + [(None, 0, "user", "q"), (7, 2, "assistant", "b"), (7, 2, "assistant", "b"), (7, None, "assistant", "a")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id int, turn int, role string, text string, formatted string")
    out = chat.format_chats(df).select("id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(out) == 7
    for r in out:
        own = sorted((x for x in rows if x[0] == r["id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        blocks = sum(1 for a, b in zip([None, *own], own) if a is None or (a[2] or "") != (b[2] or ""))
        assert r["formatted"].count("<|im_start|>") == blocks == r["formatted"].count("<|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    """A conversation of many short turns, in runs and alone, takes time that grows with it and reads back whole."""
    r = random.Random(4)
    rows = [(1, i, r.choice(["user", "assistant"]) if i % 500 else "system", f"t{i} <|im_end|> ü" * (i % 3)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    began = time.time()
    out = chat.format_chats(df).select("formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.time() - began < 60
    assert [tuple(t) for t in out["t"]] == [(x[2], x[3]) for x in rows]
    assert out["loss"] == "".join(x[3] for x in rows if x[2] == "assistant")
    assert "".join(chat_text(out["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]]) for s in out["loss_spans"]) == out["loss"]


def chat_text(escaped):
    return re.sub(r"<\\(\\*)\|", r"<\1|", escaped)


# Merkle

def tree(text):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cut = re.compile(r"(?s).{1,99}?(?:[.!?](?=\s|\Z)|\Z)|.{1,100}")
    pars = [[h(x) for x in cut.findall(p)] for p in (text or "").split("\n")]
    sections, now = [], []
    for i, x in enumerate(pars):
        now.append((h(",".join(x)), x))
        if now[-1][0] < "2" or i == len(pars) - 1:
            sections.append((h("|".join(a for a, _ in now)), "|".join(f"{a[:12]}:{','.join(y[:12] for y in b)}" for a, b in now)))
            now = []
    return h(";".join(a for a, _ in sections)) + "".join(f";{a[:12]}={b}" for a, b in sections)


def leaves(fp):
    return {x for s in fp.split(";")[1:] for p in s.split("=")[1].split("|") for x in p.split(":")[1].split(",") if x}


def like(a, b):
    x, y = leaves(a), leaves(b)
    return 1.0 if a == b else 2 * len(x & y) / max(1, len(x) + len(y))


TEXTS = [(5, "One two. Three four!\nFive six? " * 12), (4, None), (3, ""), (2, "word " * 300), (1, "Ünï. " * 40 + "\n\n\nend"), (None, "last one"), (9, "\n".join(f"Line {i} of it. And more." for i in range(60)))]


def test_merkle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "IDS", 2)
    got = {r["id"]: r for r in merkle.compare_with_next(docs(spark, [(i, t, None) for i, t in TEXTS])).withColumn("near", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()}
    order = sorted(TEXTS, key=lambda x: -(x[0] if x[0] is not None else -1))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        assert (r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"]) == (tree(t), tree(edited), tree(after))
        assert r["near"] == pytest.approx(like(tree(t), tree(edited)))


def test_merkle_query(spark, sf_dir):
    """Every column of the query against a plain version of its contract, on a whole table and one with a very long text."""
    con = duckdb.connect()
    rows = con.sql(f"select doc_id, coalesce(text, '') from '{sf_dir}/documents.parquet' order by doc_id desc").fetchall()
    got = {r["doc_id"]: r for r in merkle.op1_merkle(spark, sf_dir).collect()}
    long = [(7, "A long text. " * 40_000 + "x" * 50_000), (6, "Short.\n\n"), (5, "Ünï " * 30_000)]
    named = spark.createDataFrame(long, "doc_id long, text string")
    more = {r["id"]: r for r in merkle.compare_with_next(named).collect()}
    assert len(got) == len(rows) and len(more) == 3
    for docs, found in ((rows, got), (long, more)):
        for (i, text), (_, other) in zip(docs, docs[1:] + docs[:1], strict=True):
            n, r = len(text), found[i]
            edited = text[: n - n // 2] + other[: n // 2]
            assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (n, tree(text), tree(edited))
            if docs is rows:
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(tree(text), tree(edited))), pytest.approx(like(tree(text), tree(other))))
            else:
                assert (r["edited"], r["next_fingerprint"]) == (edited, tree(other))


def test_merkle_locates(spark):
    a, b = "\n".join(f"par {i}." for i in range(80)), "\n".join(f"par {i}." if i != 50 else "changed." for i in range(80))
    df = merkle.add_fingerprint(merkle.add_fingerprint(spark.createDataFrame([(a, b)], "a string, b string"), F.col("a"), "x"), F.col("b"), "y")
    found = df.select(merkle.changed_sections(F.col("x"), F.col("y")).alias("c"), merkle.root(F.col("x")) == merkle.root(F.col("x"))).first()
    assert 1 <= len(found["c"]) <= 2 and found[1]


def test_merkle_cases(spark):
    repeated = docs(spark, [(1, "a b.", "s"), (1, "a b.", "s"), (1, "c", "s")])
    assert merkle.compare_with_next(repeated).count() == 3
    assert merkle.compare_with_next(repeated.limit(0)).count() == 0


# Lines

def test_line_dedup(spark, monkeypatch):
    rows = [(i, f"Own {i}\n  SHARED \t line\n\nfew", f"s{i % 12}" if i % 12 else None) for i in range(24)] + [(100, None, "z"), (101, "", "z"), (3, "Own 3\n  SHARED \t line\n\nfew", "s3"), (None, "shared line\nx", "q")]
    rows = [(i, t.replace("few", "rare") if t and i is not None and i % 12 > 8 else t, s) for i, t, s in rows]
    got = line_dedup.remove_boilerplate(docs(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {*DOCS.replace(",", "").split()[::2], "removed_lines"}
    for r in got:
        i = r["doc_id"]
        if i in (100, 101):
            assert (r["text"], r["removed_lines"]) == ((None, 0) if i == 100 else ("", 0))
        elif i is None:
            assert (r["text"], r["removed_lines"]) == ("x", 1)
        else:
            last = "rare" if i % 12 > 8 else "few"
            assert r["text"] == (f"Own 0\n  SHARED \t line\n\n{last}" if i == 0 else f"Own {i}\n\n{last}")
    assert line_dedup.remove_boilerplate(docs(spark, rows).limit(0)).count() == 0


def test_line_spread_near_threshold_is_exact(spark):
    rows = [(1000 * n + k, f"line {n}", f"s{k}") for n in range(8, 13) for k in range(n)]
    found = line_dedup.boilerplate(line_dedup.line_table(docs(spark, rows))).collect()
    assert sorted(r["owner"] for r in found) == [10000, 11000, 12000]


# Quality

def signals(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(rep)


def test_quality(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "é😀 ## <p>|&%\n" * 20, " ".join(f"w{i % 7}" for i in range(90)), " ".join(f"w{i}" for i in range(60)), "line\n line\nline\n\n", "a\x0bb\x0cc\rd " * 9]
    out = quality.quality(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    for r in out:
        want = signals(texts[r["id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert {r["id"] for r in out if r["kept"]} == {10}


@pytest.mark.parametrize("one_hash", [False, True])
def test_windows_of_equal_hash(spark, monkeypatch, one_hash):
    """Windows are equal if their words are, even if the hashes of all windows are one."""
    if one_hash:
        monkeypatch.setattr(quality, "window_hash", lambda a, b, c: F.lit(1).cast("long"))
    other, twice, lone = "a521414 b c", "a621688 b c", "q1 q2 q3 q4"
    texts = [f"{twice} {other} {twice} {lone}", f"{other} {lone} {twice}", "a b a b a b a", "x x x x y z x x x", f"{twice} {lone} {twice}", "w " * 3000 + "v"]
    out = {r["id"]: r["n_repeat_words"] for r in quality.quality(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert out == {i: signals(t)[4] for i, t in enumerate(texts)}
    assert out[0] == 6 and out[1] == 0


def test_without_common_lines(spark):
    rows = [(i, f"Same  line\nown {i}\n\n same LINE", "a") for i in range(21)] + [(50 + i, f"same line\nown {i}", "b") for i in range(20)] + [(80, None, "a"), (81, "", "a"), (0, "Same  line\nown 0\n\n same LINE", "a")]
    out = quality.without_common_lines(docs(spark, rows))
    got = sorted((r["doc_id"], r["text"]) for r in out.where("text is not null").collect())
    assert out.columns == docs(spark, rows).columns and out.where("text is null").count() == 1
    assert got == sorted([(i, f"own {i}\n") for i in range(21)] + [(0, "own 0\n")] + [(50 + i, f"same line\nown {i}") for i in range(20)] + [(81, "")])
    assert quality.without_common_lines(docs(spark, rows[:1]).limit(0)).count() == 0


def test_line_frequency(spark):
    body = "\n".join(" ".join(f"c{k}w{j}" for j in range(10)) for k in range(6))
    own = lambda i: " ".join(f"d{i}x{j}" for j in range(60))
    rows = [(i, f"{body}\n{own(i)}", "a") for i in range(21)] + [(100 + i, f"{body}\n{own(i)}", "b") for i in range(20)] + [(i, body, "a") for i in range(200, 202)]
    got = {r["id"]: (r["kept"], r["words_left"]) for r in quality.quality(docs(spark, rows)).collect()}
    assert got[0] == (True, 60) and got[100] == (True, 120) and got[200] == (False, 0)
    assert quality.quality(docs(spark, rows).limit(0)).count() == 0
    twice = quality.quality(docs(spark, [rows[0], rows[0]])).collect()
    assert len(twice) == 2 and all(r["kept"] and r["words_left"] == 120 for r in twice)


# WARC

def test_warc(spark, tmp_path):
    long = "<p>" + "é" * 600
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (None, "u", long), (7, "http://a", long), (7, "http://a", long), (3, "http://s", "short"), (4, "http://s", "short"), (5, "http://n", None), (6, "http://l", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/warc"
    first = warc.write_archives(warc.choose(pages), folder)
    done = warc.normalise(first, folder)
    assert {p.suffix for p in (tmp_path / "warc").iterdir()} == {".gz", ".idx"}
    got = warc.read_archives(done, folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == sorted((i or 0, *(("revisit", 7) if h == long and i != 7 else ("response", None))) for i, _, h in rows)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        assert r["payload"] == (html.encode() if r["record_type"] == "response" else None)
    empty = warc.normalise(warc.write_archives(warc.choose(pages.limit(0)), folder), folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_cut_streams():
    """A stream cut anywhere, even within its trailer only, is an error; several members, and none, are not."""
    data = b"record " * 1000
    whole = gzip.compress(data)
    assert b"".join(warc.inflated(io.BytesIO(whole + whole))) == data + data
    assert b"".join(warc.inflated(io.BytesIO(b""))) == b""
    for n in (len(whole) - 1, len(whole) - 8, 20, len(whole) + 5):
        with pytest.raises(ValueError):
            list(warc.inflated(io.BytesIO((whole + whole)[:n])))


def test_file_systems(tmp_path):
    assert warc.file_system(f"file://{tmp_path}")[1] == str(tmp_path)
    fs, path = warc.file_system("s3a://bucket/folder?region=us-east-1")
    assert (fs.type_name, path) == ("s3", "bucket/folder")


def test_normaliser_rewrites_records():
    import gzip
    import io

    data = [warc.record(i, "http://x", b"\r\n\r\n" * i, "d", "response", None) for i in range(50)]
    mono = gzip.compress(b"".join(data))
    assert list(warc.records(warc.inflated(io.BytesIO(mono)))) == data
    members = b"".join(gzip.compress(x) for x in data)
    assert list(warc.records(warc.inflated(io.BytesIO(members)))) == data
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(iter([b"".join(data)[:-30]])))
