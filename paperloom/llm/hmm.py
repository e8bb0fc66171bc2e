"""Language-model scoring by a hidden Markov model.

Latent states emit classes of words: a class for each word of at least one in
OWN training tokens, and SUFFIXES classes by ending for the rest. Within a
class a word has its smoothed share. Baum-Welch trains start, transition and
emission: every partition returns its expected counts, and their sum makes the
next model. Scores are exact likelihoods of the class sequence by the scaled
forward recursion, times the shares of the words.

The commonest words, KNOWN at most, go to every task with their counts; counts
of rarer words are joined. A recursion over a long
text runs over blocks of BLOCK tokens at once, whose transfer matrices are then
chained. Texts are taken in batches of TOKENS tokens, and blocks in parts, so
that a long text needs little more memory than its tokens.

Cases: a null text is empty, and an empty one has its end as the only token;
texts of any length are scored whole; a null id counts as the empty string for
the fold; repeated rows count as often as they occur; without training texts
every token is unknown; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, documents, slices

#: Bounds: classes of their own, words known to every task, classes by ending.
OWN, KNOWN, SUFFIXES = 8192, 262144, 256
STATES, ROUNDS, SEED, STAY = 4, 4, 5, 0.98
#: Of a count that is added to every word, end and unknown word of the base model.
ADD = 0.1
#: Tokens of a block, blocks worked on at once; most rows, tokens and bytes of text in a batch, unless one text has more.
BLOCK, BESIDE, ROWS, TOKENS, TEXT = 64, 2048, 1000, 200_000, 2 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, then the end: b''."""
    return [*(text or "").encode().lower().split(), b""]


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


@dataclass
class Model:
    """start[k], move[k, k'], emit[k, class]; classes of their own follow those by ending."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(weights: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """Shares of classes, each state's disturbed by seeded factors; states mostly stay."""
    emit = (weights + 0.1) * np.random.default_rng(seed).gamma(1, 1, (states, len(weights)))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


class Blocks:
    """Sequences cut into blocks, longest blocks first, and where each stands in its sequence."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs], dtype=np.int64)
        self.n_seqs, per = len(seqs), -(-lens // BLOCK)
        seq = np.repeat(np.arange(len(seqs)), per)
        step = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
        size = np.minimum(BLOCK, lens[seq] - step * BLOCK)
        begin = np.repeat(np.cumsum(lens) - lens, per) + step * BLOCK
        order = np.argsort(-size, kind="stable")
        self.seq, self.step, self.size, self.begin = seq[order], step[order], size[order], begin[order]
        self.flat = np.concatenate(seqs)
        place = np.empty(len(seq), dtype=np.int64)
        place[order] = np.arange(len(seq))
        #: Of each block that before it in its sequence; not of the first.
        self.previous = place[np.maximum(order - 1, 0)]
        #: The blocks of each step, all in time that grows with the blocks.
        self.by_step = np.split(np.argsort(self.step, kind="stable"), np.cumsum(np.bincount(self.step))[:-1]) if len(seq) else []

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Blocks in parts of BESIDE: which, symbols x[t, b], and how many have a symbol at each t."""
        for lo in range(0, len(self.seq), BESIDE):
            part = slice(lo, min(lo + BESIDE, len(self.seq)))
            size = self.size[part]
            at = self.begin[part][None, :] + np.minimum(np.arange(BLOCK)[:, None], size[None, :] - 1)
            yield part, self.flat[at].astype(np.int64), np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")


def transfer(m: Model, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of each block, from predicted states before it to those after it, scaled, and the log of its scale."""
    k, n = len(m.start), len(b.seq)
    step = np.ascontiguousarray(m.move.T)
    mats, logs = np.empty((n, k, k)), np.zeros(n)
    for part, x, active in b.parts():
        p, log = np.zeros((k, k, x.shape[1])), np.zeros(x.shape[1])  # p[before, after, block]
        p[np.arange(k), np.arange(k)] = 1
        for t in range(BLOCK):
            a = active[t]
            if not a:
                break
            p[:, :, :a] = np.matmul(step, p[:, :, :a] * np.take(m.emit, x[t, :a], axis=1)[None])
            if t % 8 == 7 or t == BLOCK - 1:
                s = p.sum((0, 1))
                p /= s
                log += np.log(s)
        s = p.sum((0, 1))
        mats[part], logs[part] = (p / s).transpose(2, 0, 1), log + np.log(s)
    return mats, logs


def chained(m: Model, b: Blocks, mats: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted states before each block, and the log likelihood of each sequence."""
    before, now, like = np.empty((len(b.seq), len(m.start))), np.tile(m.start, (b.n_seqs, 1)), np.zeros(b.n_seqs)
    for at in b.by_step:
        seq = b.seq[at]
        before[at] = now[seq]
        v = np.einsum("nk,nkj->nj", now[seq], mats[at])
        s = v.sum(1)
        now[seq] = v / s[:, None]
        like[seq] += np.log(s) + logs[at]
    return before, like


def log_likelihoods(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence of classes, exact."""
    b = Blocks(seqs)
    return chained(m, b, *transfer(m, b))[1]


def expected_counts(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over all sequences, and their log likelihood, by forward and backward recursion."""
    b = Blocks(seqs)
    k, n, width = len(m.start), len(b.seq), m.emit.shape[1]
    mats, logs = transfer(m, b)
    before, like = chained(m, b, mats, logs)
    after, now = np.ones((n, k)), np.ones((b.n_seqs, k))
    for at in reversed(b.by_step):
        seq = b.seq[at]
        after[at] = now[seq]
        v = np.einsum("nkj,nj->nk", mats[at], now[seq])
        now[seq] = v / v.sum(1, keepdims=True)
    last, lead = np.zeros((n, k)), np.zeros((n, k))  # states at each block's end, and what its first token and all later ones say of them
    start, move, out = np.zeros(k), np.zeros((k, k)), np.zeros((k, width))
    step = np.ascontiguousarray(m.move.T)
    for part, x, active in b.parts():
        emit, alpha = np.zeros((BLOCK, k, x.shape[1])), np.zeros((BLOCK, k, x.shape[1]))
        p, f = before[part].T.copy(), np.zeros((k, x.shape[1]))
        for t in range(BLOCK):
            a = active[t]
            if not a:
                break
            e = emit[t, :, :a] = np.take(m.emit, x[t, :a], axis=1)
            now = p[:, :a] * e
            now /= now.sum(0)
            alpha[t, :, :a] = f[:, :a] = now
            p[:, :a] = step @ now
        last[part] = f.T
        ahead = after[part].T.copy()  # weight of each predicted state after a token
        xs, gs = [], []
        for t in reversed(range(BLOCK)):
            a = active[t]
            if not a:
                continue
            beta = m.move @ ahead[:, :a]
            g = alpha[t, :, :a] * beta
            g /= g.sum(0)
            xs.append(x[t, :a])
            gs.append(g)
            weight = emit[t, :, :a] * beta
            weight /= weight.sum(0)
            if t:
                prev = alpha[t - 1, :, :a]
                move += m.move * (prev @ (weight / ((step @ prev) * weight).sum(0)).T)
            else:
                start += g[:, b.step[part] == 0].sum(1)
                lead[part] = weight.T
            ahead[:, :a] = weight
        every, weights = np.concatenate(xs), np.concatenate(gs, 1)
        out += np.stack([np.bincount(every, weights=weights[i], minlength=width) for i in range(k)])
    later = np.flatnonzero(b.step > 0)
    prev = last[b.previous[later]]
    z = ((prev @ m.move) * lead[later]).sum(1, keepdims=True)
    move += m.move * (prev.T @ (lead[later] / z))
    return start, move, out, float(like.sum())


def next_model(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """Model of expected counts, with a little added so that nothing is impossible."""
    start, move, emit = start + 1e-3, move + 1e-3, emit + 0.01
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % folds


def _packed(seqs: list[np.ndarray]) -> list[bytes]:
    return [s.astype("<u2").tobytes() for s in seqs]


def _unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u2") for x in b.column("seq")]


def _slices(stream: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    for b in stream:
        yield from slices(b, column, ROWS, size)


def count_tokens(texts: DataFrame) -> DataFrame:
    """Columns w (binary), c of all tokens of a column text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in _slices(stream, "text", TEXT):
            for t in b.column("text"):
                held.update(tokens(t.as_py()))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_pydict({"w": list(held), "c": list(held.values())}, pa.schema([("w", pa.binary()), ("c", pa.int64())]))
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"w": list(held), "c": list(held.values())}, pa.schema([("w", pa.binary()), ("c", pa.int64())]))

    return texts.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def known_from(counts: DataFrame) -> int:
    """The least count of the words that go to every task: as many of the commonest as KNOWN allows, told from a histogram of counts by sixteenths of an octave."""
    places = counts.groupBy(F.floor(F.log2("c") * 16).alias("place")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("place")).collect()
    least, total = 1 << 62, 0
    for r in places:
        total += r["n"]
        if total > KNOWN:
            break
        least = r["least"]
    return least


def score_texts(docs: DataFrame, folds: int = 10, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (_fold(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    counts = as_table(count_tokens(rows.where("not held_out").select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    own_of = (F.col("c") * OWN >= n) | (F.length("w") == 0)
    least = known_from(counts)
    known = {r["w"]: r["c"] for r in counts.where((F.col("c") >= least) | own_of).select("w", "c").collect()}
    known = {bytes(w): c for w, c in sorted(known.items())}
    names = [w for w, c in known.items() if c * OWN >= n or not w]
    names = names if b"" in names else [b"", *names]
    own = {w: SUFFIXES + i for i, w in enumerate(names)}
    by_suffix = counts.where(~own_of).groupBy((F.crc32(F.substring("w", -3, 3)) % SUFFIXES).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    share = np.log10(np.full(SUFFIXES, ADD))  # log10 of what each class's words share
    weights = np.array([0.0] * SUFFIXES + [float(known.get(w, 0)) for w in names])
    for r in by_suffix.collect():
        share[r["g"]], weights[r["g"]] = math.log10(r["c"] + ADD * (r["v"] + 1)), r["c"]
    model = first_model(weights, states)

    index = {w: i for i, w in enumerate(known)}
    of_class = np.array([own.get(w, suffix_class(w)) for w in known], dtype=np.int64)
    log_count = np.array([math.log10(c + ADD) for c in known.values()])
    tables = spark.sparkContext.broadcast((index, of_class, log_count, share, own[b""]))
    fields = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_local", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("seq", pa.binary()), ("rare", pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])))])

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of_class, log_count, share, end = tables.value
        lone = math.log10(ADD)
        for b in _slices(stream, "text", TEXT):
            out: dict[str, list] = {f.name: [] for f in fields if f.name != "rare"}
            rare_words: list[bytes] = []
            rare_counts: list[int] = []
            ends = [0]
            for rid, ident, held, text in zip(*(b.column(c).to_pylist() for c in ("rid", "id", "held_out", "text")), strict=True):
                words = tokens(text)
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                here = at >= 0
                seq = np.empty(len(words), dtype=np.int64)
                seq[here] = of_class[at[here]]
                missing = np.flatnonzero(~here)
                others = [words[i] for i in missing]
                seq[missing] = [suffix_class(w) if w else end for w in others]
                base = log_count[at[here]].sum() + lone * len(missing)
                ending = seq[seq < SUFFIXES]
                apart = here & (seq >= SUFFIXES)
                inner = base - log_count[at[apart]].sum() - share[ending].sum() - lone * (end == seq[missing]).sum()
                rare = Counter(others)
                rare.pop(b"", None)
                rare_words += rare
                rare_counts += rare.values()
                ends.append(len(rare_words))
                for name, value in zip(out, (rid, ident, held, len(words), int(here.sum()), float(base), float(inner), seq.astype("<u2").tobytes()), strict=True):
                    out[name].append(value)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["w", "n"]))
            yield pa.RecordBatch.from_arrays([*(pa.array(out[f.name], f.type) for f in fields if f.name != "rare"), listed], names=[f.name for f in fields])

    read_as = "rid long, id long, held_out boolean, n_tokens long, n_local long, base double, inner double, seq binary, rare array<struct<w: binary, n: long>>"
    table = as_table(rows.withColumn("id", F.col("id").cast("long")).withColumn("rid", F.monotonically_increasing_id()).mapInArrow(read, read_as), "sequences")
    for _ in range(rounds if n else 0):
        model = _round(table.where("not held_out").select("seq"), model)

    final = spark.sparkContext.broadcast(model)

    def like(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(stream, "seq", 2 * TOKENS):
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(log_likelihoods(final.value, _unpacked(b)) / math.log(10))], names=["rid", "chain"])

    rare = table.select("rid", F.explode("rare").alias("r")).select("rid", "r.w", "r.n")
    more = rare.join(counts.where((F.col("c") < least) & ~own_of), "w")
    more = more.groupBy("rid").agg(F.sum(F.col("n") * (F.log10(F.col("c") + ADD) - math.log10(ADD))).alias("more"), F.sum("n").alias("n_more"))
    scored = table.drop("seq", "rare").join(table.select("rid", "seq").mapInArrow(like, "rid long, chain double"), "rid").join(more, "rid", "left")
    zero = F.lit(0)
    base = F.col("base") + F.coalesce("more", zero) - F.col("n_tokens") * math.log10(n + ADD * (v + 1))
    return scored.select(
        "id", "held_out", "n_tokens", (F.col("n_local") + F.coalesce("n_more", zero)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("chain") + F.col("inner") + F.coalesce("more", zero)).alias("score"),
    )


def _round(seqs: DataFrame, model: Model) -> Model:
    """One round of Baum-Welch; counts come back as (place, value) and are summed by place."""
    given = seqs.sparkSession.sparkContext.broadcast(model)
    k, width = model.emit.shape

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + k * width)
        for b in _slices(stream, "seq", 2 * TOKENS):
            start, move, emit, _ = expected_counts(given.value, _unpacked(b))
            total += np.concatenate([start, move.ravel(), emit.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "value"])

    found = seqs.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(k + k * k + k * width)
    total[found["place"].to_numpy(np.int64)] = found["value"].to_numpy(float)
    return next_model(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, width))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
