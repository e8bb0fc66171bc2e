"""Mixture, pieces, language and language model: against plain versions and their stated cases."""

import heapq
import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.llm import hmm, language, mixture, pieces, similar, simhash

# Mixture


def test_targets():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixture.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixture.targets([0, 0], [5, 2]) == [0, 0]
    assert mixture.targets([], []) == []
    r = np.random.default_rng(0)
    for _ in range(50):
        sizes = r.integers(0, 1000, 9).tolist()
        got = mixture.targets(sizes, [5, 2, 1] * 3)
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))


def test_knapsack_is_exact():
    r = np.random.default_rng(1)
    for _ in range(60):
        lengths, counts = r.integers(1, 12, 4).tolist(), r.integers(0, 4, 4).tolist()
        sums = {sum(a * b for a, b in zip(lengths, t)) for t in itertools.product(*(range(c + 1) for c in counts))}
        budget = int(r.integers(1, 60))
        got = mixture.knapsack(lengths, counts, budget)
        assert all(g <= c for g, c in zip(got, counts))
        assert sum(a * b for a, b in zip(lengths, got)) == max(s for s in sums if s <= budget)


def test_fit_meets_target(monkeypatch):
    monkeypatch.setattr(mixture, "WINDOW", 200)
    r = np.random.default_rng(2)
    lengths = np.arange(0, 300)
    counts = r.integers(1, 50, 300)
    total = int((lengths * counts).sum())
    for share in (0, 0.3, 0.999, 1, 1.7, 2.5, 3):
        passes, extra = mixture.fit(lengths, counts, share * total)
        assert (extra <= counts).all() and (extra >= 0).all() and extra[0] == 0
        assert 0 <= round(share * total) - passes * total - (extra * lengths).sum() <= 1


def test_mix(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 3}" if i % 3 else None, 0) for i in range(300)] + [(0, None, "s1", 0), (5, "w w", "s1", 0), (5, "w w", "s1", 0), (None, "q", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    m = mixture.mix(docs)
    out = m.docs.collect()
    assert len(out) == len(rows)
    sources = {(r["has"], r["src"]): (r["source_size"], r["target"]) for r in m.sources.collect()}
    assert set(sources) == {(True, "s1"), (True, "s2"), (False, "")}
    for key, (size, target) in sources.items():
        own = [r for r in out if (r["has"], r["src"]) == key]
        assert sum(r["size"] for r in own) == size and abs(sum(r["size"] * r["copies"] for r in own) - target) <= 1
    assert all(r["copies"] <= 3 for r in out)
    again = mixture.mix(docs.repartition(7)).docs
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    mixed = mixture.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixture.mix(docs.limit(0)).docs.count() == 0


def plain_targets(sizes):
    """Shares by weight; sources above three times their size are held there, one round after the other."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    held: dict = {}
    while True:
        open_ = [s for s in sizes if s not in held]
        left = sum(sizes.values()) - sum(held.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if shares[s] > 3 * sizes[s]]
        if not over:
            return held | shares
        held |= {s: 3 * sizes[s] for s in over}


def test_mixture_query(spark, sf_dir):
    """Every document of a whole table: sizes and targets, as many whole passes as fit, and then the best sum that the source's lengths can make, by the documents with the smallest hashes of a length."""
    import re

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in mixture.op2_mixture(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    own: dict = {}
    for r in rows:
        own.setdefault(r["source"], []).append(r["doc_id"])
    sizes = {s: sum(size[i] for i in ids) for s, ids in own.items()}
    aims = plain_targets(sizes)
    hashed = {r["doc_id"]: (r["k"], r["doc_id"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64(F.lit(mixture.SEED), "doc_id", "text").alias("k")).collect()}
    bucket = lambda i: (hashed[i][0] >> 20) % mixture.BUCKETS
    for s, ids in own.items():
        assert all((got[i]["size"], got[i]["source_size"]) == (size[i], sizes[s]) and got[i]["target"] == pytest.approx(aims[s]) for i in ids)
        passes = int(aims[s] // sizes[s])
        best = 1
        for i in ids:
            best |= best << size[i]
        rest = round(aims[s] - passes * sizes[s])
        reach = max(x for x in range(rest + 1) if best >> x & 1)
        assert sum(got[i]["taken"] for i in ids) == passes * sizes[s] + reach
        for n in {size[i] for i in ids} - {0}:
            alike = sorted((i for i in ids if size[i] == n), key=lambda i: (bucket(i), hashed[i]))
            copies = [got[i]["taken"] // n for i in alike]
            assert copies == sorted(copies, reverse=True) and set(copies) <= {passes, passes + 1} and max(copies) <= 3


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MAX_SOURCES", 3)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="sources"):
        mixture.mix(docs)
    assert mixture.mix(docs.where("doc_id < 3")).docs.count() == 3


# Pieces

ODD = ["", "a", "  ", "aaaa bbbb   cccc", "hello\nworld\n\n x", "日本語 ñandú 😀 \x00 \t z", "ab" * 300, " leading", "trailing  ", "----====", "a▁b ▁ c", "▁", "0" * 50]


def agenda(p, t, key, drop):
    table = {int(k): int(r) for k, r in zip(p.keys, p.ranks) if k >= 0}
    chars = [" ", *t]
    sym = [int(p.char[0x2581]) if c == " " else -1 if c == "▁" else int(p.char[ord(c)]) for c in chars]
    n = len(sym)
    nxt, prv, alive, heap = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n, []

    def push(i):
        j = nxt[i]
        if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (r := table.get(sym[i] * p.size + sym[j])) is not None:
            heapq.heappush(heap, (r, i, j, sym[i], sym[j]))

    for i in range(n):
        push(i)
    while heap:
        r, i, j, a, b = heapq.heappop(heap)
        if not (alive[i] and alive[j] and nxt[i] == j and (sym[i], sym[j]) == (a, b)):
            continue
        piece = int(p.rank_piece[r])
        if drop and int(pieces.candidate_hash(np.array([key], dtype=np.uint64), np.array([i]), np.array([piece]))[0]) < int(drop * 2**64):
            continue
        sym[i], alive[j], nxt[i] = piece, False, nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [x for i in range(n) if alive[i] for x in ([sym[i]] if sym[i] >= 0 else [int(p.byte[b]) for b in chars[i].encode()])]


@pytest.fixture(scope="module")
def sp():
    return pieces.model(pieces.MODEL)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]


def test_without_dropout_as_the_library(sp, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    some = [*texts, *(t for t in ODD if "▁" not in t)]
    ids, n = pieces.encode_batch(sp, some, [1] * len(some), 0.0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t) for t in some]


def test_dropout_as_the_agenda(sp, texts):
    some = [*(t[:600] for t in texts[:15]), *ODD[1:]]
    keys = [pieces.document_key(i, 5) for i in range(len(some))]
    for drop in (0.1, 0.6):
        ids, n = pieces.encode_batch(sp, some, keys, drop)
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [x.tolist() for x in got] == [agenda(sp, t, k, drop) for t, k in zip(some, keys)]
        assert [pieces.decode(sp, x) for x in got] == some


def test_encode(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(50, None, "x"), (0, "", "y"), (None, "some text here", "z"), (None, "some text here", "z"), (51, "some text here " * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lossless string")
    out = pieces.encode(docs, dropout=0.3).collect()
    assert all(r["lossless"] or r["text"] is None for r in out) and len(out) == len(rows)
    assert next(r for r in out if r["doc_id"] == 50)["token_ids"] is None
    a, b = (r["token_ids"] for r in out if r["doc_id"] is None)
    assert a == b
    other = pieces.encode(docs.where("doc_id = 51"), dropout=0.3, seed=99).first()["token_ids"]
    assert other != next(r for r in out if r["doc_id"] == 51)["token_ids"]
    assert pieces.encode(docs.limit(0)).count() == 0


# Language


def test_gradient():
    net, r = language.new_net(["a", "b", "c"], 4), np.random.default_rng(0)
    for k in net.w:
        net.w[k] = r.normal(0, 0.5, net.w[k].shape)
    seqs = sorted((bytes(r.integers(97, 101, n).tolist()) for n in (5, 3, 1, 6)), key=lambda s: -len(s))
    x, active = language._padded(seqs)
    y = np.array([0, 1, 2, 1])
    _, grad = language.gradients(net, x, active, y)
    for k, w in net.w.items():
        for _ in range(5):
            i = tuple(int(r.integers(97, 101)) if k[0] == "x" and d == 0 else int(r.integers(0, s)) for d, s in enumerate(w.shape))
            old, loss = w[i], []
            for step in (1e-4, -1e-4):
                w[i] = old + step
                loss.append(language.gradients(net, x, active, y)[0])
            w[i] = old
            assert grad[k][i] == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=2e-3)


def plain_gru(net, d, data):
    """Scores of one direction at each byte, one after the other, with scalars."""
    u, table, o = net.w[f"u{d}"].astype(float), net.w[f"x{d}"].astype(float) + net.w[f"b{d}"], net.w[f"o{d}"].astype(float)
    k = u.shape[0]
    h, out = [0.0] * k, {}
    for t in range(len(data)) if d == "f" else reversed(range(len(data))):
        gu = [sum(h[i] * u[i, j] for i in range(k)) for j in range(3 * k)]
        gx = table[data[t]]
        z = [1 / (1 + math.exp(-gx[j] - gu[j])) for j in range(k)]
        r = [1 / (1 + math.exp(-gx[k + j] - gu[k + j])) for j in range(k)]
        new = [math.tanh(gx[2 * k + j] + r[j] * gu[2 * k + j]) for j in range(k)]
        h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(k)]
        out[t] = [sum(h[j] * o[j, c] for j in range(k)) for c in range(o.shape[1])]
    return out


def plain_sums(net, data, window, context):
    total = [0.0] * len(net.langs)
    for s in range(0, len(data), window):
        e = min(len(data), s + window)
        lo, hi = max(0, s - context), min(len(data), e + context)
        f, b = plain_gru(net, "f", data[lo:e]), plain_gru(net, "b", data[s:hi])
        for t in range(s, e):
            x = [math.exp(f[t - lo][c] + b[t - s][c] + net.w["c"][c]) for c in range(len(total))]
            total = [v + y / sum(x) for v, y in zip(total, x, strict=True)]
    return total


@pytest.fixture(scope="module")
def small_net():
    net, r = language.new_net(["a", "b", "c"], 3, seed=4), np.random.default_rng(6)
    for k in net.w:
        net.w[k] = r.normal(0, 0.6, net.w[k].shape).astype(np.float32)
    return net


@pytest.mark.parametrize(("window", "context"), [(256, 32), (16, 5), (4, 7), (1, 1)])
def test_positions_as_the_plain_network(small_net, monkeypatch, window, context):
    """Every position of whole texts, across stretches of any size, in any company."""
    monkeypatch.setattr(language, "WINDOW", window)
    monkeypatch.setattr(language, "CONTEXT", context)
    texts = [b"a", "héllo wörld 123".encode(), b"x" * 70, bytes(range(97, 123)) * 3, "日本語".encode() * 9, b"ab" * 16]
    for beside in (1, 1024):
        monkeypatch.setattr(language, "BESIDE", beside)
        got = language.Reader(small_net).sums(texts)
        for t, s in zip(texts, got, strict=True):
            assert s == pytest.approx(plain_sums(small_net, t, window, context), rel=1e-4)
            assert s.sum() == pytest.approx(len(t), rel=1e-4)


def test_read(small_net, monkeypatch):
    """The mean of a text does not depend on its batch; texts without a letter are und; the text is read in lower case."""
    some = ["Aba xyx!", "x" * 1000, None, "123 !?", "", "ABA XYX!", "日本", "aba xyx!"]
    want = language.Reader(small_net).read(some)
    assert [i for i, w in enumerate(want) if w == ("und", 0.0)] == [2, 3, 4]
    assert want[0] == want[5] == want[7]
    s = plain_sums(small_net, b"aba xyx!", 256, 32)
    assert want[0] == (small_net.langs[int(np.argmax(s))], pytest.approx(max(s) / 8, rel=1e-4))
    monkeypatch.setattr(language, "BATCH", 1)
    got = [language.Reader(small_net).read([t])[0] for t in some]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-5)


def test_ties_go_to_the_first(small_net):
    net = language.Net(["a", "b"], {k: v[..., :2] * 0 if k[0] in "co" else v for k, v in small_net.w.items()})
    assert language.Reader(net).read(["text"])[0] == ("a", pytest.approx(0.5))


def test_reads_all_of_a_text(spark):
    """Labels that differ only far into an unspaced run, and scripts without spaces, are learned from whole texts."""
    head, tails = "qz" * 400, {"a": "abab", "b": "cdcd"}
    rows = [(i, head + tails[k] * 300, k) for i in range(40) for k in "ab"] + [(100 + i, "日本語の文章を読む" * (i + 3), "ja") for i in range(20)] + [(200 + i, "中华人民共和国成" * (i + 3), "zh") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs, language.fit(docs, held=9)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)


def test_rows_that_share_an_id(spark, monkeypatch):
    """A bounded sample of rows with null ids only, and of rows all alike, still teaches."""
    monkeypatch.setattr(language, "FIT_DOCS", 20)
    monkeypatch.setattr(language, "STEPS", 60)
    rows = [(None, f"the words of this text {i}", "en") for i in range(150)] + [(None, f"die worte dieses textes {i}", "de") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs).langs == ["de", "en"]
    alike = spark.createDataFrame([(None, "one and the same", "en")] * 300, "doc_id long, text string, lang string")
    net = language.fit(alike)
    out = language.identify(alike, net).select("lang_pred", "score").distinct().collect()
    assert net.langs == ["en"] and [(r["lang_pred"], r["score"]) for r in out] == [("en", 1.0)]


def test_held_out_accuracy(spark, sf_dir):
    found = language.op9_bigru(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, "text", None), (4, "!!", "b")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    net = language.fit(docs.where("lang is null"))
    assert net.langs == []
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs, net).collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), net).count() == 0


# Language model


def recursion(m, s):
    alphas, scales = [], []
    a = m.start * m.emit[:, s[0]]
    for t in range(len(s)):
        if t:
            a = (alphas[-1] @ m.move) * m.emit[:, s[t]]
        scales.append(a.sum())
        alphas.append(a / a.sum())
    beta, move, emit = np.ones(len(m.start)), np.zeros_like(m.move), np.zeros_like(m.emit)
    for t in reversed(range(len(s))):
        g = alphas[t] * beta
        emit[:, s[t]] += g / g.sum()
        if t:
            x = alphas[t - 1][:, None] * m.move * (m.emit[:, s[t]] * beta)[None]
            move += x / x.sum()
            beta = m.move @ (m.emit[:, s[t]] * beta) / scales[t]
    return np.log(scales).sum(), g / g.sum(), move, emit


def test_baum_welch():
    r = np.random.default_rng(0)
    m = hmm.first_model(r.uniform(1, 5, 12), 3, 1)
    seqs = [r.integers(0, 12, n) for n in (1, 2, 63, 64, 65, 128, 129, 500, 1, 7)]
    want = [recursion(m, s) for s in seqs]
    assert hmm.log_likelihoods(m, seqs) == pytest.approx([w[0] for w in want])
    start, move, emit, like = hmm.expected_counts(m, seqs)
    for got, k in ((start, 1), (move, 2), (emit, 3)):
        assert np.abs(got - sum(w[k] for w in want)).max() < 1e-9
    for _ in range(5):
        m = hmm.next_model(start, move, emit)
        start, move, emit, better = hmm.expected_counts(m, seqs)
        assert better > like - 0.5
        like = better


def plain_scores(texts, count, own_share, rounds):
    """log10 probability of each text, token by token: Baum-Welch over whole training texts, then the forward recursion."""
    n = sum(count.values())
    own = sorted(w for w, c in count.items() if c * own_share >= n or not w)
    number = {w: hmm.SUFFIXES + i for i, w in enumerate(own)}
    of = lambda w: number.get(w, zlib.crc32(w[-3:]) % hmm.SUFFIXES)
    weights, types = np.zeros(hmm.SUFFIXES + len(own)), Counter()
    for w, c in count.items():
        weights[of(w)] += c
        types[of(w)] += 1
    m = hmm.first_model(weights)
    trained = [np.array([of(w) for w in words]) for k, words in texts.items() if zlib.crc32(str(k).encode()) % 10]
    for _ in range(rounds):
        found = [recursion(m, s) for s in trained]
        m = hmm.next_model(*(sum(f[i] for f in found) for i in (1, 2, 3)))
    out = {}
    for k, words in texts.items():
        share = [math.log10((count[w] + 0.1) / (weights[of(w)] + 0.1 * (types[of(w)] + 1))) for w in words if w not in number]
        out[k] = recursion(m, [of(w) for w in words])[0] / math.log(10) + sum(share)
    return out


@pytest.mark.parametrize("beside", [1, 7])
def test_blocks_in_parts(monkeypatch, beside):
    """Counts and likelihoods are those of the plain recursion, however many blocks are worked on at once."""
    monkeypatch.setattr(hmm, "BLOCK", 5)
    monkeypatch.setattr(hmm, "BESIDE", beside)
    r = np.random.default_rng(2)
    m = hmm.first_model(r.random(6), 3, 2)
    seqs = [r.integers(0, 6, n).astype("<u2") for n in (1, 5, 6, 23, 10, 2, 31)]
    want = [recursion(m, s) for s in seqs]
    got = hmm.expected_counts(m, seqs)
    for i, k in ((0, 1), (1, 2), (2, 3)):
        assert np.abs(got[i] - sum(w[k] for w in want)).max() < 1e-9
    assert hmm.log_likelihoods(m, seqs) == pytest.approx([w[0] for w in want])


def test_a_million_tokens(spark):
    """One text of over a million tokens: exact, in time that grows with it, in little more memory than its tokens."""
    r = np.random.default_rng(3)
    m, seq = hmm.first_model(r.random(9), 2, 4), r.integers(0, 9, 1_100_000).astype("<u2")
    emit, a, like = m.emit.T, m.start, 0.0
    for x in seq.tolist():
        a = a * emit[x]
        total = a[0] + a[1]
        like += math.log(total)
        a = (a / total) @ m.move
    tracemalloc.start()
    _, move, out, got = hmm.expected_counts(m, [seq, seq[:100]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == pytest.approx(like + hmm.log_likelihoods(m, [seq[:100]])[0], rel=1e-9)
    assert out.sum() == pytest.approx(1_100_100) and move.sum() == pytest.approx(1_100_098)
    assert peak < 60 * len(seq)
    docs = spark.createDataFrame([(1, "a b " * 550_000), (2, "a b")], "doc_id long, text string")
    scored = {r["id"]: r for r in hmm.score_texts(docs, rounds=1).collect()}
    assert scored[1]["n_tokens"] == scored[1]["n_known"] == 1_100_001 and scored[1]["score"] == pytest.approx(scored[1]["base_score"], rel=1e-3)


def test_scores(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 50)
    monkeypatch.setattr(hmm, "KNOWN", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    rows = docs.collect()
    got = {r["id"]: r for r in hmm.score_texts(docs, rounds=2).collect()}
    count = Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in hmm.tokens(r["text"]))
    n, v = sum(count.values()), len(count)
    for r in rows:
        w, g = hmm.tokens(r["text"]), got[r["doc_id"]]
        assert g["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(x in count for x in w), n)
    want = plain_scores({r["doc_id"]: hmm.tokens(r["text"]) for r in rows}, count, 50, 2)
    assert {k: g["score"] for k, g in got.items()} == pytest.approx(want, rel=1e-6)
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_score_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "a b a", 3), (3, "A\x0bb c", 4)], "doc_id long, text string, rid int")
    got = hmm.score_texts(docs, rounds=1).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 4, 4]
    assert hmm.score_texts(docs.limit(0)).count() == 0
    none = hmm.score_texts(docs.where("doc_id is null"), folds=1).first()
    assert (none["train_tokens"], none["n_known"], none["base_score"]) == (0, 0, 0)


def test_model_is_a_distribution():
    """The probabilities of all texts of up to two tokens, and of longer ones, sum to one."""
    m = hmm.first_model(np.array([1.0, 2.0, 3.0]), 2, 3)
    for n in (1, 2, 3):
        total = sum(np.exp(hmm.log_likelihoods(m, [np.array(s)])[0]) for s in itertools.product(range(3), repeat=n))
        assert total == pytest.approx(1)


# Similar texts


def test_similar(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(similar, "PAIRED", 4)
    base = [f"w{i}" for i in range(200)]
    near = []
    for k in range(30):
        w = list(base)
        w[(k * 7) % 200] = f"x{k}"
        near.append((k, " ".join(w)))
    rows = [*near, (50, " ".join(base)), (51, " ".join(base)), (60, " ".join(f"z{i}" for i in range(100))), (61, None), (62, " "), (None, "one more")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bands int")
    got = {r["id"]: r["component_id"] for r in similar.similar_classes(docs, 5, 2, 0.8, "doc_id", "text").collect()}
    assert all(got[k] == 0 for k in (*range(30), 50, 51))
    assert (got[60], got[61], got[62], got[None]) == (60, 61, 61, None)
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 60, 61]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_similar_to_any_member_of_a_class(spark):
    """A text similar to a member of a fingerprint class, but not to the one with the smallest id, is linked; so are null ids and texts that share an id."""
    r = np.random.default_rng(3)
    apart = lambda a, b: (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()
    while True:
        a = [f"w{r.integers(1 << 30)}" for _ in range(300)]
        b = [f"x{i}" if i % 35 == 3 else w for i, w in enumerate(a)]
        c = [f"y{i}" if i % 60 == 20 else w for i, w in enumerate(b)]
        a, b, c = map(" ".join, (a, b, c))
        radius = apart(a, b)
        if min(apart(b, c), apart(a, c)) > radius:
            break
    other = " ".join(f"o{i}" for i in range(50))
    docs = spark.createDataFrame([(0, a), (1, b), (2, c), (3, other)], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in similar.similar_classes(docs, 5, radius, 0.8, "doc_id", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    docs = spark.createDataFrame([(1, b), (7, c), (7, "z " + other), (None, c), (9, "z y " + other)], "doc_id long, text string")
    got = sorted((-1 if r["id"] is None else r["id"], r["component_id"]) for r in similar.similar_classes(docs, 5, 0, 0.8, "doc_id", "text").collect())
    assert got == [(-1, 1), (1, 1), (7, 1), (7, 7), (9, 7)]


@pytest.mark.parametrize("longest", [1024, 4])
def test_similar_in_large_buckets(spark, monkeypatch, longest):
    """Texts on one template, each similar to one other text only: every pair is found, though few of them are centres."""
    monkeypatch.setattr(similar, "PAIRED", 4)
    monkeypatch.setattr(similar, "LIST", longest)
    monkeypatch.setattr(similar, "BLOCK", 16)
    signed = similar.signatures
    monkeypatch.setattr(similar, "signatures", lambda *x: signed(*x).withColumn("bands", F.array(F.lit(7).cast("long"))))  # all in one bucket
    r = np.random.default_rng(5)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(60):
        own = [f"p{k}_{i}" for i in range(30)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:-6] + [f"q{k}_{i}" for i in range(6)]))]
        tail = [f"s{k}_{i}" for i in range(60)]
        rows[-2:] = [(i, f"{t} {' '.join(tail)}") for i, t in rows[-2:]]
    docs = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "doc_id long, text string")
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    links = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert links == {(2 * k, 2 * k + 1) for k in range(60)}
    got = {r["id"]: r["component_id"] for r in similar.similar_classes(docs, 5, 0, 0.8, "doc_id", "text").collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_linked_roots():
    """A job joins what a plain comparison of all pairs joins, with one side and with two."""
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 12, r.integers(1, 14)).astype("<u8")) for _ in range(80)]
    for side in (np.zeros(80, int), np.arange(80) % 2):
        rows = pd.DataFrame({"side": side, "node": np.arange(80), "root": np.arange(80) // 3 + 100, "shingles": [x.view(np.int64) for x in sets]})
        up = {i: i for i in range(100, 127)}
        for a, b in itertools.combinations(range(80), 2):
            if (side[a] != side[b] or not side.any()) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                x, y = up[a // 3 + 100], up[b // 3 + 100]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
        got = similar.linked_roots(rows, 0.8)
        assert dict(zip(got["b"], got["a"])) == {k: v for k, v in up.items() if k != v}
