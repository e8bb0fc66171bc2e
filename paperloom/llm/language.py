"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a whole text in lower case, words and what stands
between them alike, in both directions, and labels every position with the
probability of each language; a document's probability is the mean over all its
positions. Both directions start from the state zero at the ends of the text. A
text of over WINDOW bytes is read in stretches of WINDOW, and each direction
carries its state into a stretch over the CONTEXT bytes before it, so that
stretches of one text, and of many, are read side by side.

It is trained on the driver, in numpy, by backpropagation through time, on a
bounded sample of labelled rows: FIT_DOCS rows with the smallest hashes. Each
gives PLACES passages of SPAN code points, drawn evenly from its whole text;
each step trains on as many stretches of passages of every language.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so
are all texts if no row is labelled; ties go to the language first by code
point; rows without a label, and passages without a letter, are not learned
from; a null id counts as the empty string for the fold; long texts are read
whole; repeated rows get equal answers, and count as often as they occur in the
fit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, within_sample

#: Sampled rows, passages of each, and their code points.
FIT_DOCS, PLACES, SPAN = 4000, 8, 160
#: States of a direction, steps, stretches of a step and their bytes.
HIDDEN, STEPS, STRETCHES, BYTES, RATE, SEED = 16, 700, 96, 64, 0.01, 11
#: Bytes of a stretch that is labelled, and of its lead-in on either side; stretches read side by side; bytes of texts in a batch.
WINDOW, CONTEXT, BESIDE, BATCH = 256, 32, 1024, 1 << 20
#: The symbol beyond the ends of a text: it leaves the state at zero.
PAD = 256
UNKNOWN = "und"


@dataclass
class Net:
    """Weights by name; of a direction d: x{d} (byte to gates), u{d} (state to gates), b{d}, o{d} (state to languages); c is the languages' bias."""

    langs: list[str]
    w: dict[str, np.ndarray]


def new_net(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Net:
    r = np.random.default_rng(seed)
    w = {"c": np.zeros(len(langs), np.float32)}
    for d in "fb":
        w |= {f"x{d}": r.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)), f"b{d}": np.zeros(3 * hidden), f"o{d}": r.normal(0, 1 / np.sqrt(hidden), (hidden, len(langs)))}
    return Net(langs, {k: v.astype(np.float32) for k, v in w.items()})


def _padded(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes x[t, n] of sequences, longest first, and how many are active at each t."""
    lens = np.array([len(s) for s in seqs])
    x = np.zeros((len(seqs), lens[0]), dtype=np.uint8)
    x[np.arange(lens[0])[None, :] < lens[:, None]] = np.frombuffer(b"".join(seqs), dtype=np.uint8)
    return np.ascontiguousarray(x.T), _active(lens, int(lens[0]))


def _active(lens: np.ndarray, steps: int) -> np.ndarray:
    """How many of sequences, longest first, have a symbol at each step."""
    return np.searchsorted(-lens, -np.arange(1, steps + 1), side="right")


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _run(net: Net, d: str, x: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction at every position, and what backpropagation needs of each."""
    w, hidden = net.w, net.w[f"u{d}"].shape[0]
    table, u, n = w[f"x{d}"] + w[f"b{d}"], w[f"u{d}"], x.shape[1]
    h, out, kept = np.zeros((n, hidden), np.float32), np.zeros((len(x), n, hidden), np.float32), []
    for t in range(len(x)) if d == "f" else reversed(range(len(x))):
        a = active[t]
        gx, gu = table[x[t, :a]], h[:a] @ u
        zr = _sigmoid(gx[:, : 2 * hidden] + gu[:, : 2 * hidden])
        z, r, un = zr[:, :hidden], zr[:, hidden:], gu[:, 2 * hidden :]
        new = np.tanh(gx[:, 2 * hidden :] + r * un)
        kept.append((t, a, h[:a].copy(), z, r, un, new))
        h[:a] = new + z * (h[:a] - new)
        out[t, :a] = h[:a]
    return out, kept


def gradients(net: Net, x: np.ndarray, active: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions against language y[n], and its gradient by backpropagation through time."""
    w, hidden = net.w, net.w["uf"].shape[0]
    mask = np.arange(x.shape[1])[None, :] < active[:, None]
    runs = {d: _run(net, d, x, active) for d in "fb"}
    logits = runs["f"][0] @ w["of"] + runs["b"][0] @ w["ob"] + w["c"]
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    total = mask.sum()
    at = np.arange(x.shape[1])
    loss = float(-(np.log(p[:, at, y] + 1e-12) * mask).sum() / total)
    p[:, at, y] -= 1
    delta = p * (mask / total)[:, :, None].astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["c"] = delta.sum((0, 1))
    for d, (states, kept) in runs.items():
        flat = delta.reshape(-1, delta.shape[2])
        grad[f"o{d}"] = states.reshape(-1, hidden).T @ flat
        back = delta @ w[f"o{d}"].T
        dh = np.zeros((x.shape[1], hidden), np.float32)
        read, gates, gated, before = [], [], [], []
        for t, a, h, z, r, un, new in reversed(kept):
            g = dh[:a] + back[t, :a]
            dn = g * (1 - z) * (1 - new * new)
            dz, dr = g * (h - new) * z * (1 - z), dn * un * r * (1 - r)
            own = np.concatenate([dz, dr, dn * r], 1)
            dh[:a] = g * z + own @ w[f"u{d}"].T
            read.append(x[t, :a])
            gates.append(np.concatenate([dz, dr, dn], 1))
            gated.append(own)
            before.append(h)
        grad[f"u{d}"] = np.concatenate(before).T @ np.concatenate(gated)
        read, gates = np.concatenate(read), np.concatenate(gates)
        order = np.argsort(read, kind="stable")
        symbols, first = np.unique(read[order], return_index=True)
        grad[f"x{d}"][symbols] = np.add.reduceat(gates[order], first, axis=0)
        grad[f"b{d}"] = gates.sum(0)
    return loss, grad


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = SEED) -> Net:
    """Network for (lang, text) samples; each step has as many stretches of every language, from texts and places drawn evenly."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in samples:
        if any(map(str.isalpha, text)):
            texts.setdefault(lang, []).append(text.lower().encode())
    langs = sorted(texts)
    net, r = new_net(langs, seed=seed), np.random.default_rng(seed)
    if not langs:
        return net
    each = max(1, STRETCHES // len(langs))
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        batch = []
        for i, lang in enumerate(langs):
            for j, place in zip(r.integers(0, len(texts[lang]), each), r.random(each), strict=True):
                text = texts[lang][j]
                at = int(place * (max(0, len(text) - BYTES) + 1))
                batch.append((text[at : at + BYTES], i))
        batch.sort(key=lambda b: -len(b[0]))
        x, active = _padded([b for b, _ in batch])
        _, grad = gradients(net, x, active, np.array([i for _, i in batch]))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Reader:
    """Sums of position probabilities of texts.

    Gates are rows here and stretches columns, so that each step works on long rows. Sigmoids are
    taken as (1 + tanh(x / 2)) / 2, the halves of which are in the weights.
    """

    def __init__(self, net: Net):
        self.net = net
        self.w = {}
        for d in "fb":
            hidden = net.w[f"u{d}"].shape[0]
            halves = np.repeat(np.float32([0.5, 0.5, 1]), hidden)[:, None]
            # A symbol's gates with the bias; of the symbol beyond the ends none, which keeps the state zero at zero.
            symbols = np.concatenate([net.w[f"x{d}"] + net.w[f"b{d}"], np.zeros((1, 3 * hidden), np.float32)])
            self.w[d] = np.ascontiguousarray(symbols.T * halves), np.ascontiguousarray(net.w[f"u{d}"].T * np.float32(0.5)), np.ascontiguousarray(net.w[f"o{d}"].T)

    def scores(self, d: str, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """What one direction adds to each language at each position: out[t, language, n], for symbols x[t, n]."""
        symbols, u, o = self.w[d]
        hidden, n = u.shape[1], x.shape[1]
        states, read, own = np.zeros((hidden, n), np.float32), np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        out = np.zeros((len(x), len(self.net.langs), n), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            a = active[t]
            h, g, gu = states[:, :a], read[:, :a], own[:, :a]
            np.take(symbols, x[t, :a], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=gu)
            zr, z, r, new = g[: 2 * hidden], g[:hidden], g[hidden : 2 * hidden], gu[2 * hidden :]
            zr += gu[: 2 * hidden]
            np.tanh(zr, out=zr)
            zr += 1
            new *= r
            new += g[2 * hidden :]
            np.tanh(new, out=new)
            h -= new
            z *= 0.5
            h *= z
            h += new
            np.matmul(o, h, out=out[t, :, :a])
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Sums over all positions of each text's bytes, none empty, of the probability of each language: a row for each text."""
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        edge = np.full(CONTEXT, PAD, dtype=np.uint16)
        flat = np.concatenate([part for t in texts for part in (edge, np.frombuffer(t, np.uint8).astype(np.uint16))] + [edge])
        per = -(-lens // WINDOW)
        owner = np.repeat(np.arange(len(texts)), per)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = (np.cumsum(lens + CONTEXT) - lens)[owner] + step * WINDOW
        size = np.minimum(WINDOW, lens[owner] - step * WINDOW)
        out = np.zeros((len(texts), len(self.net.langs)))
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), BESIDE):
            some = order[i : i + BESIDE]
            most = int(size[some[0]])
            at = start[some][None, :] + np.arange(most + CONTEXT)[:, None]
            active = _active(size[some] + CONTEXT, most + CONTEXT)
            p = self.scores("f", flat[np.minimum(at - CONTEXT, len(flat) - 1)], active)[CONTEXT:]
            p += self.scores("b", flat[np.minimum(at, len(flat) - 1)], active)[:most]
            p += self.net.w["c"][None, :, None]
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(1, keepdims=True)
            p *= (np.arange(most)[:, None] < size[some][None, :])[:, None, :]
            np.add.at(out, owner[some], p.sum(0).T)
        return out

    def read(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and mean probability of each text."""
        out, at, some, total = [(UNKNOWN, 0.0)] * len(texts), [], [], 0

        def flush() -> None:
            for i, t, s in zip(at, some, self.sums(some), strict=True):
                best = int(np.argmax(s))
                out[i] = (self.net.langs[best], float(min(1.0, s[best] / len(t))))
            at.clear()
            some.clear()

        for i, t in enumerate(texts):
            if t and self.net.langs and any(map(str.isalpha, t)):
                at.append(i)
                some.append(t.lower().encode())
                total += len(some[-1])
                if total >= BATCH:
                    flush()
                    total = 0
        if some:
            flush()
        return out


def _fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % folds


def fit(docs: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net:
    """Network trained on labelled rows outside the held fold."""
    text = F.col(text_col)
    labelled = docs.where((_fold(F.col(id_col), folds) != held) & F.col(lang_col).isNotNull())
    order = F.xxhash64(F.lit(SEED), F.col(id_col), text)
    place = lambda k: F.pmod(F.xxhash64(F.lit(SEED), k, F.col(id_col), text), F.greatest(F.length(text) - SPAN, F.lit(0)) + 1)
    passages = F.array(*(F.substring(text, (place(F.lit(k)) + 1).cast("int"), F.lit(SPAN)) for k in range(PLACES)))
    rows = labelled.where(text.isNotNull()).select(order.alias("o"), F.col(lang_col).cast("string").alias("lang"), passages.alias("passages"))
    total = labelled.count()  # reads no text
    taken = lambda some: some.orderBy("o", "lang", "passages").limit(FIT_DOCS).collect()
    found = taken(rows.where(within_sample(F.col("o"), total, FIT_DOCS)))
    if len(found) < min(FIT_DOCS, total):  # many rows without a text, or alike, whose hashes are the same
        found = taken(rows)
    return train([(r["lang"], p) for r in found for p in r["passages"]])


def identify(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred, score."""
    given = docs.sparkSession.sparkContext.broadcast(net)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(given.value)
        for whole in stream:
            for b in slices(whole, text_col):
                found = reader.read(b.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*columns, "lang_pred", "score"])

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).schema.add("lang_pred", "string").add("score", "double"))


def op9_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
