"""Encoding with a SentencePiece BPE model, with seeded merge-dropout, and decoding.

Symbols are the code points of a text, with spaces as U+2581 and one before the
text. A candidate merge is a pair of neighbours whose union is a piece; the
agenda takes the best score first, the leftmost of equals. A candidate that
comes up is skipped for good if a hash keyed by seed, document, place and piece
falls below the dropout rate. What stays without a piece becomes bytes.

No piece holds a space after another character (checked when a model is read),
so words merge apart. Each round settles the first candidate of every word of a
batch of texts at once, over linked arrays; a word of over LONG symbols has an
agenda of its own.

Cases: null has no ids and decodes to null; an empty text has none and decodes
to ''; U+2581 in a text becomes bytes, so that every text decodes to itself;
long texts are encoded whole; equal rows get equal ids, a null document key
counts as one; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 23
SPACE = 0x2581
NONE = np.int32(1 << 30)
#: Code points that are encoded together; a longer text is encoded alone.
BATCH = 1 << 19
LONG = 200


class Pieces:
    """The tables of a model: pieces by code point, merges by pair, bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        text, score = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids = {text[i]: i for i in normal}
        if any("▁" in x.lstrip("▁") for x in ids):
            raise ValueError("a piece holds a space after other characters; words can't be merged apart")
        self.byte = np.full(256, -1, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(text[i][3:5], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("the model has no byte fallback")
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for x, i in ids.items():
            if len(x) == 1:
                self.char[ord(x)] = i
        self.out = [b""] * n
        for i in normal:
            self.out[i] = text[i].replace("▁", " ").encode()
        for b in range(256):
            self.out[self.byte[b]] = bytes([b])
        order = sorted((i for i in normal if len(text[i]) > 1), key=lambda i: (-score[i], i))
        self.rank_piece = np.array(order, dtype=np.int32)
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for i in order:
            x = text[i]
            for k in range(1, len(x)):
                a, b = ids.get(x[:k]), ids.get(x[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = rank[i]
        self._table(pairs)

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing: keys and ranks, and the most steps that a search takes."""
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks, self.probes = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int32), 1
        for k, r in pairs.items():
            at = int(self._slot(np.array([k], dtype=np.int64))[0])
            steps = 1
            while self.keys[at] >= 0:
                at, steps = (at + 1) % len(self.keys), steps + 1
            self.keys[at], self.ranks[at], self.probes = k, r, max(self.probes, steps)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of pieces; NONE if there is none."""
        k = a.astype(np.int64) * self.size + b
        k[(a < 0) | (b < 0)] = -2
        at = self._slot(k)
        found = self.keys[at]
        out = np.where(found == k, self.ranks[at], NONE)
        todo = np.flatnonzero((found != k) & (found != -1) & (k >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.keys)
            found = self.keys[at[todo]]
            hit = found == k[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


@lru_cache(maxsize=4)
def model(path: str) -> Pieces:
    return Pieces(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def candidate_hash(key: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """64-bit hash of a candidate: the document's key, the code point at which it starts, the piece it makes."""
    return _mixed(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (piece.astype(np.uint64) << np.uint64(40)))


def document_key(doc: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}/{'' if doc is None else doc}")


def encode_batch(p: Pieces, texts: list[str], keys: list[int], dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each text has."""
    raw = [("▁" + t).encode("utf-32-le") if t else b"" for t in texts]
    lens = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    cp = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
    n = len(cp)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    ends = np.cumsum(lens)
    first = (ends - lens)[lens > 0]
    sym = p.char[cp]
    sym[cp == 32] = p.char[SPACE]
    sym[cp == SPACE] = -1
    sym[first] = p.char[SPACE]
    space = sym == p.char[SPACE]
    follows = np.ones(n + 1, dtype=bool)  # whether a symbol belongs to the word of the one before
    follows[:-1][1:] = ~(space[1:] & ~space[:-1])
    follows[first] = False
    follows[n] = False
    at = np.arange(n + 1, dtype=np.int32)
    nxt = np.where(follows[1:], at[1:], n).astype(np.int32)
    nxt = np.append(nxt, np.int32(n))
    prv = np.where(follows, at - 1, n).astype(np.int32)
    prv[n] = n
    sym = np.append(sym, np.int32(-1))
    alive = np.ones(n, dtype=bool)
    place = np.arange(n, dtype=np.int64) - np.repeat(ends - lens, lens)
    doc = np.repeat(np.array(keys, dtype=np.uint64), lens)
    rank = np.full(n + 1, NONE, dtype=np.int32)
    rank[:n] = np.where(nxt[:n] < n, p.merge_ranks(sym[:n], sym[nxt[:n]]), NONE)
    limit = int(dropout * 2**64)
    starts = np.flatnonzero(~follows[:n])
    sizes = np.diff(np.append(starts, n))
    for w in np.flatnonzero(sizes > LONG):
        _agenda(p, int(starts[w]), int(starts[w] + sizes[w]), sym, nxt, prv, rank, alive, place, doc, limit)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    valid = rank[:n] < NONE
    while len(active := np.flatnonzero(valid)):
        of = word[active]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        now = np.minimum.reduceat(rank[active].astype(np.int64) << 32 | active, heads) & 0xFFFFFFFF
        piece = p.rank_piece[rank[now]]
        if limit:
            skip = candidate_hash(doc[now], place[now], piece) < np.uint64(limit)
            valid[now[skip]] = False
            now, piece = now[~skip], piece[~skip]
        gone = nxt[now]
        sym[now] = piece
        alive[gone] = valid[gone] = False
        nxt[now] = nxt[gone]
        prv[nxt[now]] = now
        before = prv[now]
        fresh = np.concatenate([now, before[before < n]])
        rank[fresh] = np.where(nxt[fresh] < n, p.merge_ranks(sym[fresh], sym[nxt[fresh]]), NONE)
        valid[fresh] = rank[fresh] < NONE
    left = np.flatnonzero(alive)
    ids = sym[left]
    counts = np.add.reduceat(np.append(alive, False).astype(np.int64), (ends - lens)) * (lens > 0)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        spelled = [chr(c).encode() for c in cp[left[odd]].tolist()]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[odd] = [len(b) for b in spelled]
        owner = np.repeat(np.arange(len(lens)), counts)
        out = np.repeat(ids, sizes)
        out[out < 0] = p.byte[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        ids, counts = out, np.bincount(owner, weights=sizes, minlength=len(lens)).astype(np.int64)
    return ids.astype(np.int32), counts


def _agenda(p: Pieces, begin: int, end: int, sym, nxt, prv, rank, alive, place, doc, limit: int) -> None:  # noqa: ANN001
    """Settle the symbols begin to end, one long word, in place, from a heap."""
    heap = [(int(rank[i]), i, int(nxt[i])) for i in range(begin, end) if rank[i] < NONE]
    heapq.heapify(heap)
    key, n = doc[begin : begin + 1], len(alive)
    while heap:
        r, i, j = heapq.heappop(heap)
        if not alive[i] or nxt[i] != j or rank[i] != r:
            continue
        piece = p.rank_piece[r]
        if limit and int(candidate_hash(key, place[i : i + 1], np.array([piece]))[0]) < limit:
            rank[i] = NONE
            continue
        sym[i], nxt[i], alive[j], rank[j] = piece, nxt[j], False, NONE
        if nxt[j] < n:
            prv[nxt[j]] = i
        for k in (i, int(prv[i])):
            if k < n:
                rank[k] = p.merge_ranks(sym[k : k + 1], sym[nxt[k] : nxt[k] + 1])[0] if nxt[k] < n else NONE
                if rank[k] < NONE:
                    heapq.heappush(heap, (int(rank[k]), k, int(nxt[k])))
    rank[begin:end] = NONE


def decode(p: Pieces, ids: np.ndarray) -> str:
    out = p.out
    return b"".join([out[i] for i in ids.tolist()]).decode()[1:]


def _grouped(texts: list[str | None], keys: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    held, names, size = [], [], 0
    for t, k in zip(texts, keys, strict=True):
        if held and size + len(t or "") > BATCH:
            yield held, names
            held, names, size = [], [], 0
        held.append(t or "")
        names.append(k)
        size += len(t or "")
    if held:
        yield held, names


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """docs with columns token_ids (array of int) and lossless (whether they decode to the text; null unless check)."""

    def of(batch: pa.RecordBatch, p: Pieces) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        keys = [document_key(x, seed) for x in batch.column(id_col).to_pylist()]
        all_ids, all_counts, lossless = [], [], []
        for some, names in _grouped(texts, keys):
            ids, counts = encode_batch(p, some, names, dropout)
            all_ids.append(ids)
            all_counts.append(counts)
            if check:
                lossless += [decode(p, x) == t for x, t in zip(np.split(ids, np.cumsum(counts)[:-1]), some, strict=True)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(all_counts))]) if all_counts else np.zeros(1)
        missing = [t is None for t in texts]
        offsets = pa.array(offsets.astype(np.int32), mask=np.array([*missing, False])) if any(missing) else pa.array(offsets.astype(np.int32))
        values = pa.array(np.concatenate(all_ids) if all_ids else np.empty(0, np.int32))
        flags = pa.array([None if m else x for m, x in zip(missing, lossless, strict=True)] if check else [None] * len(texts), pa.bool_())
        kept = [batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, values), flags], names=[*columns, "token_ids", "lossless"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model(SparkFiles.get(os.path.basename(path)))
        for b in stream:
            for some in slices(b, text_col):
                yield of(some, p)

    docs.sparkSession.sparkContext.addFile(path)  # once an application; executors need not have it
    columns = [c for c in docs.columns if c not in ("token_ids", "lossless")]
    schema = docs.select(*columns).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("lossless", "boolean")
    return docs.select(*columns).mapInArrow(batches, schema)


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.array_join("token_ids", " "), 256)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("tokens_sha256"), "lossless")
