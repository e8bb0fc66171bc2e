"""Near-duplicates by SimHash, searched with vantage-point trees.

Every word shingle gives a 64-bit hash, and the majority of each bit gives the
fingerprint of a text. Fingerprints within ``radius`` bits are linked. Equal
fingerprints collapse first. A vantage-point tree over a bounded sample routes
the rest to shards: a fingerprint lives in one leaf and visits, as a query,
each leaf that the triangle inequality does not rule out. A shard of more than
UNIT rows, visitors included, gets a tree of its own from a sample of its own;
a leaf of that which is still over UNIT is compared block with block, so no
task holds more than UNIT rows, about, however many there are. A shard searches
its own vantage-point tree exactly and reports groups, not pairs. Groups bear
the fingerprint of a member as their name, so equal names mean linked groups.

Cases: null and empty texts have fingerprint zero and link like any other;
texts of any length are read whole; a null id still links, but never names a
component while a component has another id; rows that repeat an id and text
fall into one component; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, documents, drop_tables, within_sample
from .components import connected_components

SEED = 42
#: Fingerprints that fit the routing tree, and those that a shard should hold as its own.
SAMPLE, LEAF, MOST_SHARDS = 8192, 2048, 4096
#: Most rows of a task's search, and fingerprints that fit the tree of a larger shard: such trees, one a leaf of the first, travel to every task.
UNIT, FEW = 1 << 20, 1024
#: Rows for each partition of the search, and most partitions.
PART, MOST_PARTS = 40_000, 100_000
#: Fingerprints that a shard's search compares directly, and members that share a component's key.
DIRECT, MEMBERS = 96, 1000


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, in order; of all words if they are fewer than size."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def bits_of(h: np.ndarray) -> int:
    """Fingerprint whose bits are set where over half the hashes have them set; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text."""
    return bits_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp (signed long) of each row."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


@dataclass
class Tree:
    """Nodes of a vantage-point tree by number, the root first: distance to vantage at most cut goes to near, else to far. A leaf's near is -1, its far the leaf's number."""

    vantage: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int


def _choose(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and cut that split points most evenly for the overlap; None if no cut tells them apart."""
    best, found = 1.9, None
    for v in points[np.linspace(0, len(points) - 1, min(12, len(points)), dtype=int)]:
        d = np.bincount(np.bitwise_count(points ^ v), minlength=66)
        below = np.cumsum(d)
        for cut in range(64):
            near, n = below[cut], len(points)
            if min(near, n - near) * 5 < n:
                continue
            both = below[min(65, cut + radius)] - (below[cut - radius] if cut >= radius else 0)
            cost = (n + both) / n + abs(2 * near - n) / n * 0.3
            if cost < best:
                best, found = cost, (v, cut)
    return found


def routing_tree(sample: np.ndarray, total: int, radius: int, leaf: float | None = None) -> Tree:
    """Tree over a sample whose leaves hold about leaf (LEAF, or more where total is large) of the total."""
    nodes: list[list[int]] = []
    leaves = 0
    share = (leaf or max(LEAF, total / MOST_SHARDS)) * len(sample) / max(total, 1)

    def build(points: np.ndarray) -> int:
        nonlocal leaves
        nodes.append([0, 0, -1, -1])
        at = len(nodes) - 1
        if len(points) > max(share, 8) and (found := _choose(points, radius)):
            v, cut = found
            near = np.bitwise_count(points ^ v) <= cut
            nodes[at] = [int(v), cut, build(points[near]), build(points[~near])]
        else:
            nodes[at][3] = leaves
            leaves += 1
        return at

    build(sample)
    v, cut, near, far = zip(*nodes, strict=True)
    return Tree(np.array(v, np.uint64), np.array(cut, np.int8), np.array(near, np.int32), np.array(far, np.int32), leaves)


def route(tree: Tree, fps: np.ndarray, radius: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, index into fps and whether the leaf is its own, for each leaf that a fingerprint lives in or visits.

    Of two linked fingerprints on both sides of a cut, the near one visits the far side. Without own all live in a leaf; the others only visit.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def walk(node: int, own: np.ndarray, guests: np.ndarray) -> None:
        if not len(own) and not len(guests):
            return
        if tree.near[node] < 0:
            at = np.concatenate([own, guests])
            out.append((np.full(len(at), tree.far[node]), at, np.arange(len(at)) < len(own)))
            return
        v, cut = tree.vantage[node], int(tree.cut[node])
        d, g = np.bitwise_count(fps[own] ^ v).astype(int), np.bitwise_count(fps[guests] ^ v).astype(int)
        near = d <= cut
        visit = near & (d > cut - radius)
        walk(int(tree.near[node]), own[near], guests[g <= cut + radius])
        walk(int(tree.far[node]), own[~near], np.concatenate([own[visit], guests[g > cut - radius]]))

    at = np.arange(len(fps))
    walk(0, at if own is None else at[own], at[:0] if own is None else at[~own])
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Groups:
    """Disjoint sets over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def flat(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        roots = self.flat()
        a, b = roots[a], roots[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        for x, y in pairs:
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def search(fps: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """Root of each fingerprint under all links that have an own one at either end; exact."""
    groups = Groups(len(fps))

    def direct(mine: np.ndarray, others: np.ndarray) -> None:
        for i in range(0, len(mine), DIRECT):
            for j in range(0, len(others), 1 << 15):
                m, o = mine[i : i + DIRECT], others[j : j + (1 << 15)]
                a, b = np.nonzero(np.bitwise_count(fps[m][:, None] ^ fps[o][None, :]) <= radius)
                groups.join(m[a], o[b])

    def walk(mine: np.ndarray, guests: np.ndarray) -> None:
        if not len(mine):
            return
        found = _choose(fps[mine], radius) if len(mine) > DIRECT else None
        if found is None:
            direct(mine, np.concatenate([mine, guests]))
            return
        v, cut = found
        d, g = np.bitwise_count(fps[mine] ^ v).astype(int), np.bitwise_count(fps[guests] ^ v).astype(int)
        near = d <= cut
        walk(mine[near], guests[g <= cut + radius])
        walk(mine[~near], np.concatenate([mine[near & (d > cut - radius)], guests[g > cut - radius]]))

    walk(np.flatnonzero(own), np.flatnonzero(~own))
    return groups.flat()


def _members(part: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Rows fp, comp, head for each member of a unit's groups of two or more.

    A comp has MEMBERS members at most and is named by its first, head names the group's first comp. Names of
    different units that are equal are of groups that share this member, so they may well be one.
    """
    part = part.sort_values(["own", "fp"], ascending=[False, True], ignore_index=True)
    fps = part["fp"].to_numpy(np.int64).view(np.uint64)
    roots = search(fps, part["own"].to_numpy(bool), radius)
    order = np.argsort(roots, kind="stable")
    ranked, named = roots[order], fps[order].view(np.int64)
    start = np.searchsorted(ranked, ranked)
    size = np.searchsorted(ranked, ranked, side="right") - start
    comp = start + (np.arange(len(ranked)) - start) // MEMBERS * MEMBERS
    kept = size > 1
    return pd.DataFrame({"fp": named[kept], "comp": named[comp][kept], "head": named[start][kept]})


def shards(distinct: DataFrame, total: int, radius: int) -> DataFrame:
    """Columns shard, sub, fp, own: each fingerprint (column fp) in the leaf where it lives and in those that it visits."""
    spark = distinct.sparkSession
    sample = distinct.select("fp", F.xxhash64("fp", F.lit(7)).alias("o")).where(within_sample(F.col("o"), total, SAMPLE))
    sample = sample.orderBy("o").limit(SAMPLE).toPandas()
    tree = routing_tree(sample["fp"].to_numpy(np.int64).view(np.uint64), total, radius)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b["fp"].to_numpy(np.int64)
            leaf, at, own = route(tree, raw.view(np.uint64), radius)
            yield pd.DataFrame({"shard": leaf, "fp": raw[at], "own": own})

    placed = as_table(distinct.select("fp").mapInPandas(first, "shard long, fp long, own boolean"), "shards")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("own").alias("mine")).where(F.col("n") > UNIT)
    large = {r["shard"]: (r["n"], r["mine"]) for r in sizes.collect()}  # of the leaves of a tree over SAMPLE points
    if not large:
        return placed.select("shard", F.lit(0).cast("long").alias("sub"), "fp", "own")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        n, mine = large[shard]
        points = np.sort(part["fp"].to_numpy(np.int64)).view(np.uint64)
        # Half a unit of rows for each leaf; guests are of this share, too.
        t = routing_tree(points, mine, radius, leaf=UNIT / 2 * mine / n)
        return pd.DataFrame({"shard": [shard], "tree": [pickle.dumps(t)]})

    few = F.broadcast(spark.createDataFrame([(k, max(1, min(1 << 30, (FEW << 30) // max(mine, 1)))) for k, (_, mine) in large.items()], "shard long, bar long"))
    low = F.pmod(F.shiftrightunsigned(F.xxhash64("fp", F.lit(8)), 34), F.lit(1 << 30)) < F.col("bar")
    grown = placed.where("own").join(few, "shard").where(low).groupBy("shard").applyInPandas(grow, "shard long, tree binary").collect()
    trees = spark.sparkContext.broadcast({r["shard"]: pickle.loads(bytes(r["tree"])) for r in grown})

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, rows in b.groupby("shard", sort=False):
                raw, own = rows["fp"].to_numpy(np.int64), rows["own"].to_numpy(bool)
                sub, at = np.zeros(len(raw), int), np.arange(len(raw))
                if shard in trees.value:
                    sub, at, own = route(trees.value[shard], raw.view(np.uint64), radius, own)
                yield pd.DataFrame({"shard": shard, "sub": sub, "fp": raw[at], "own": own})

    out = as_table(placed.mapInPandas(second, "shard long, sub long, fp long, own boolean"), "shards")
    drop_tables(placed)
    return out


def units(placed: DataFrame) -> DataFrame:
    """Columns shard, sub, job, fp, own: the rows of shards, those of over UNIT rows once for each pair of their blocks that the row is in."""
    sizes = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"), F.count_if("own").alias("mine")).where("mine > 0 and n > 1")
    blocks = F.when(F.col("n") > UNIT, F.ceil(F.col("n") * 2 / UNIT)).otherwise(1).cast("long")
    sized = placed.join(sizes.select("shard", "sub", blocks.alias("blocks")), ["shard", "sub"])
    own = F.pmod(F.xxhash64("fp", F.lit(9)), F.col("blocks"))
    pair = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: (other != own) | (F.col("blocks") == 1))
    return sized.select("shard", "sub", F.explode(F.transform(others, pair)).alias("job"), "fp", "own")


def fingerprint_classes(fps: DataFrame, radius: int = 2, rows: int | None = None) -> DataFrame:
    """Columns fp, component_id for rows (id, fp), so many if known: the smallest id reachable over links of at most radius bits."""
    distinct = as_table(fps.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints", rows)
    total = distinct.count()
    placed = shards(distinct, total, radius)
    parts = max(1, min(MOST_PARTS, placed.count() // PART))
    searched = units(placed).repartition(parts, "shard", "sub", "job").groupBy("shard", "sub", "job")
    members = as_table(searched.applyInPandas(lambda p: _members(p, radius), "fp long, comp long, head long"), "members")
    many = members.count()

    hops = members.groupBy("fp").agg(F.min("comp").alias("a"), F.collect_set("comp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    edges = hops.union(members.select("head", "comp")).where("a <> b")
    roots = connected_components(edges, rows=many)
    comps = members.join(distinct, "fp").groupBy("comp").agg(F.min("first").alias("first"))
    comps = comps.join(roots, comps["comp"] == roots["node"], "left").select("comp", F.coalesce("root", "comp").alias("root"), "first")
    comps = as_table(comps, "comps", many)
    names = comps.groupBy("root").agg(F.min("first").alias("name"))
    named = comps.join(names, "root").select("comp", "name")
    best = members.join(named, "comp").groupBy("fp").agg(F.min("name").alias("name"))
    classes = as_table(distinct.join(best, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id")), "classes", total)
    drop_tables(distinct, members, comps)
    return classes


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, fp, component_id: one row for each row of docs."""
    fps = as_table(fingerprints(docs, size, id_col, text_col), "simhash")
    classes = fingerprint_classes(fps, radius, fps.count())
    return fps.join(classes, "fp", "left").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, radius: int = 2, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the smallest id of each component; rows that repeat an id and text count once.

    Components link fingerprints within radius bits and, unless similarity is None, texts whose shingles are at least so similar.
    """
    from .similar import similar_classes

    found = near_duplicates(docs, size, radius, id_col, text_col) if similarity is None else similar_classes(docs, size, radius, similarity, id_col, text_col)
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__keep")).distinct()
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
