"""Near-duplicates by shingle similarity, beyond the reach of fingerprints.

Texts whose word shingles have a Jaccard similarity of 0.8 differ in about ten
of 64 fingerprint bits; at such a radius the triangle inequality rules out no
branch of a vantage-point tree, since unrelated fingerprints differ in 32 bits
with a deviation of 4. So classes within a few bits come from the trees, and
texts are compared with each other: BANDS bands of ROWS minhashes propose
pairs, the exact similarity of the whole texts decides, and links join classes.
A pair of similarity 0.8 is proposed with probability 0.9993.

A node is a set of shingles: only texts with the same set are taken together,
whatever their ids, and each set is compared, not one for a class. Pairs that
the trees have joined already are left out.

A bucket of up to PAIRED nodes proposes all its pairs. In a larger one each
node is compared with CENTRES of them first, chosen by hash anew in each band.
What that joins need not be compared again. The nodes of larger buckets that
are not all joined by then are searched for similar sets exactly, not bucket by
bucket: each set is listed under the shingles of its prefix, the rarest of the
set, of which similar sets share one, and pairs of a list are compared if their
lengths and places there leave enough in common. Texts on a common template
whose own parts keep them apart so never meet under the template's shingles.
A list of over LIST entries is dealt to blocks, and a task compares two blocks.

Cases: as in simhash; texts without a word are one class; rows with a null id
are compared like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, drop_tables, slices
from .components import connected_components
from .simhash import Groups, bits_of, fingerprint_classes, shingle_hashes

BANDS, ROWS = 24, 6
PAIRED, CENTRES, LIST, BLOCK = 32, 3, 1024, 512
#: Sets with a shingle beyond which it counts as frequent, most frequent shingles that travel to every task, and classes of length for each octave.
COMMON, FREQUENT, STEPS = 32, 1 << 18, 32
#: Narrow rows that a row of bands, and one of a set of shingles, counts for.
WIDE, WEIGHT = 8, 50
#: Shingles of a block, unless one set has more, and those that a comparison of two blocks holds as columns at once.
ELEMENTS, COLUMNS = 1 << 20, 8192
SEED = 29


def node_of(h: np.ndarray) -> int:
    """Signed hash of a set of shingle hashes, sorted."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def bands_of(h: np.ndarray) -> list[int]:
    """Signed hash of each band of minhashes of shingle hashes; none without shingles."""
    if not len(h):
        return []
    a, b = _factors()
    folded = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(folded), 1024):
        least = np.minimum(least, (folded[i : i + 1024, None] * a[None, :] + b[None, :]).min(0))
    return [int(np.uint64(xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i)).astype(np.int64)) for i in range(0, len(least), ROWS)]


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets of shingle hashes, arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.lit(1), F.size(a) + F.size(b) - common)


def fitting(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of a and b elements can be so similar at all."""
    return F.least(a, b) >= similarity * (1 - 1e-9) * F.greatest(a, b)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Columns id, said (hash of the text), fp, node, len (shingles in its set), bands of each row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in slices(whole, "text"):
                fps, nodes, lens, bands = [], [], [], []
                for t in b.column("text").to_pylist():
                    h = shingle_hashes(t, size)
                    known = np.unique(h)
                    fps.append(bits_of(h))
                    nodes.append(node_of(known))
                    lens.append(len(known))
                    bands.append(bands_of(known))
                columns = [b.column("id"), b.column("said"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(lens, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "said", "fp", "node", "len", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("said"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, said long, fp long, node long, len int, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Columns node, class, shingles (array of distinct hashes) for wanted (node, class, row), where row (id, said) has a text of the node."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for b in slices(whole, "text"):
                sets = [np.unique(shingle_hashes(t, size)) for t in b.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("class"), pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))], names=["node", "class", "shingles"])

    w = wanted.select("node", "class", F.col("row.id").alias("w_id"), F.col("row.said").alias("w_said"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("said"), F.col(text_col).alias("text"))
    texts = texts.join(w, (texts["said"] == w["w_said"]) & texts["id"].eqNullSafe(w["w_id"])).groupBy("node", "class").agg(F.max("text").alias("text"))
    return texts.mapInArrow(run, "node long, class long, shingles array<long>")


def bucketed(nodes: DataFrame, rows: int) -> DataFrame:
    """Columns bucket, n (its nodes), node, class, len of nodes (node, class, len, bands) in buckets of more than one class."""
    met = nodes.select("node", "class", "len", F.posexplode("bands").alias("band", "value")).select("node", "class", "len", F.xxhash64("band", "value").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket", "n")
    return as_table(met.join(buckets, "bucket"), "buckets", rows * BANDS)


def candidate_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Columns a < b of nodes of different classes that share a bucket and may be so similar; in a large one, of each with the centres."""
    few = met.where(F.col("n") <= PAIRED).select("bucket", "node", "class", "len")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.class") != F.col("y.class")) & fitting(F.col("x.len"), F.col("y.len"), similarity)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & apart).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = met.where(F.col("n") > PAIRED).select("bucket", "node", "class", "len")
    chosen = [F.min_by(F.struct("node", "class", "len"), F.xxhash64("node", "bucket", F.lit(i))) for i in range(CENTRES)]
    centres = many.groupBy("bucket").agg(F.array(*chosen).alias("centres")).select("bucket", F.explode("centres").alias("c"))
    other = many.join(centres, "bucket").where((F.col("class") != F.col("c.class")) & fitting(F.col("len"), F.col("c.len"), similarity))
    return pairs.union(other.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))).distinct()


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than COMMON sets have, sorted, and how many: all, or as many of the commonest as FREQUENT allows. They order shingles, and decide nothing."""
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > COMMON)
    counts = as_table(counts, "frequent")
    least, total = 1 << 62, 0
    for r in counts.groupBy(F.floor(F.log2("c") * 16).alias("place")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("place")).collect():
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["least"]
    found = counts.where(F.col("c") >= least).toPandas()
    drop_tables(counts)
    order = np.argsort(found["s"].to_numpy(np.int64))
    return found["s"].to_numpy(np.int64)[order], found["c"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, int]:
    """The shingles that a set must be found by, rare ones first, and how many of them suffice where it is the smaller of two sets.

    Of two sets so similar the first so many of the smaller and all of the larger have one in common, whatever the order of shingles.
    """
    known, counts = common
    seen = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        seen = np.where(known[at] == shingles, counts[at], 0)
    n = len(shingles)
    keep = n - math.ceil(similarity * n * (1 - 1e-9)) + 1
    first = n - math.ceil(2 * similarity / (1 + similarity) * n * (1 - 1e-9)) + 1
    return shingles[np.lexsort((shingles, seen))][:keep], min(first, keep)


def entries(sets: DataFrame, similarity: float) -> DataFrame:
    """Columns s, node, root, len, pos, open for sets (node, class as root, shingles): a row for each shingle of a set's prefix, open where it is the smaller's."""
    spark = sets.sparkSession
    common = spark.sparkContext.broadcast(frequent(sets))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for i in range(0, b.num_rows, 1000):
                some = b.slice(i, 1000)
                found = [prefix(x.values.to_numpy(zero_copy_only=False), common.value, similarity) for x in some.column("shingles")]
                ends = np.cumsum([0, *(len(x) for x, _ in found)], dtype=np.int32)
                columns = [some.column("node"), some.column("class"), pa.array([len(x) for x in some.column("shingles")], pa.int32()), pa.array([n for _, n in found], pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate([x for x, _ in found]))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "len", "first", "tokens"])

    found = sets.select("node", "class", "shingles").mapInArrow(run, "node long, root long, len int, first int, tokens array<long>")
    rows = found.select("node", "root", "len", "first", F.posexplode("tokens").alias("pos", "s"))
    return rows.select("s", "node", "root", "len", (F.col("pos") + 1).alias("pos"), (F.col("pos") < F.col("first")).alias("open"))


def meeting(x: str, y: str, similarity: float) -> Column:
    """Whether two entries of a list may be of similar sets that have no earlier shingle in common: x the smaller and open, and enough left in both."""
    c = lambda side, name: F.col(f"{side}.{name}")
    left = F.least(c(x, "len") - c(x, "pos"), c(y, "len") - c(y, "pos")) + 1
    enough = left >= similarity / (1 + similarity) * (1 - 1e-9) * (c(x, "len") + c(y, "len"))
    return c(x, "open") & (c(x, "len") <= c(y, "len")) & fitting(c(x, "len"), c(y, "len"), similarity) & (c(x, "root") != c(y, "root")) & enough


def list_pairs(listed: DataFrame, similarity: float) -> DataFrame:
    """Columns a < b of nodes that meet in a list of at most LIST entries, from entries with their list's size n."""
    some = listed.where(F.col("n") <= LIST)
    met = some.alias("x").join(some.alias("y"), (F.col("x.s") == F.col("y.s")) & meeting("x", "y", similarity))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def block_jobs(listed: DataFrame, similarity: float) -> DataFrame:
    """Columns job, side, node, root for entries of longer lists: all that may meet in a list are in a job, on side 0 or on both.

    A list is dealt to blocks of about BLOCK entries, and ELEMENTS shingles, of like length, open ones apart from the others, and roots of over BLOCK apart from all. Blocks of one such root don't meet, nor
    blocks none of which is open, nor those whose lengths and places rule it out.
    """
    long = listed.where(F.col("n") > LIST)
    kind = long.withColumn("step", F.floor(F.log2("len") * STEPS)).withColumn("cap", (F.col("len") - F.col("pos") + 1) * ((1 + similarity) / similarity * (1 + 1e-9)) - F.col("len"))
    sizes = kind.groupBy("s", "root").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("s", "root", F.col("root").alias("own"))
    kind = kind.join(sizes, ["s", "root"], "left")
    keys = ["s", "own", "open", "step"]
    counts = kind.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("len").alias("total")).select(*(F.col(k).alias(f"__{k}") for k in keys), F.ceil(F.greatest(F.col("c") / BLOCK, F.col("total") / ELEMENTS)).alias("parts"))
    same = (F.col("s") == F.col("__s")) & F.col("own").eqNullSafe(F.col("__own")) & (F.col("open") == F.col("__open")) & (F.col("step") == F.col("__step"))
    placed = kind.join(counts, same).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
    placed = placed.withColumn("block", F.xxhash64("s", F.coalesce("own", F.lit(0)), F.col("own").isNull(), "open", "step", "part"))
    placed = as_table(placed.select("block", "s", "own", "open", "node", "root", "len", "cap"), "blocks")
    blocks = placed.groupBy("s", "own", "open", "block").agg(F.min("len").alias("lo"), F.max("len").alias("hi"), F.max("cap").alias("cap"))
    x, y = blocks.where("open").alias("x"), blocks.alias("y")
    may = (F.col("x.s") == F.col("y.s")) & (~F.col("y.open") | (F.col("x.block") <= F.col("y.block"))) & (F.col("x.own").isNull() | F.col("y.own").isNull() | (F.col("x.own") != F.col("y.own")))
    reach = lambda p, q: (F.col(f"{p}.lo") <= F.col(f"{q}.hi")) & (F.col(f"{p}.lo") <= F.col(f"{q}.cap")) & (F.col(f"{p}.hi") >= similarity * (1 - 1e-9) * F.col(f"{q}.lo"))
    jobs = x.join(y, may & (reach("x", "y") | (F.col("y.open") & reach("y", "x")))).select(F.col("x.block").alias("a"), F.col("y.block").alias("b")).withColumn("job", F.xxhash64("a", "b"))
    sides = jobs.select("job", F.lit(0).alias("side"), F.col("a").alias("block")).union(jobs.where("a <> b").select("job", F.lit(1), "b"))
    return sides.join(placed.select("block", "node", "root"), "block").select("job", "side", "node", "root")


def linked_roots(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Rows a, b of roots that the similar pairs of a job join; exact, a row at most for each node."""
    n = len(part)
    sets = [np.asarray(x, np.int64) for x in part["shingles"]]
    lens = np.array([len(x) for x in sets])
    roots, root = np.unique(part["root"].to_numpy(np.int64), return_inverse=True)
    one = np.flatnonzero(part["side"].to_numpy() == 0)
    two = np.flatnonzero(part["side"].to_numpy() == 1)
    two = two if len(two) else one
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1  # what one set has alone is in no intersection
    owner, column = np.repeat(np.arange(n), lens)[shared], (np.cumsum(count > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(one), len(two)))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[i:j], column[i:j] - c] = 1
        common += has[one] @ has[two].T
    alike = common / np.maximum(1, lens[one][:, None] + lens[two][None, :] - common) >= similarity
    a, b = np.nonzero(alike & (root[one][:, None] != root[two][None, :]))
    groups = Groups(len(roots))
    groups.join(root[one][a], root[two][b])
    up = groups.flat()
    moved = np.flatnonzero(up != np.arange(len(up)))
    return pd.DataFrame({"a": roots[up[moved]], "b": roots[moved]})


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Columns a, b of classes: those of the pairs (a, b) of nodes whose sets (node, class, shingles) are so similar."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("class").alias("class_a"), F.col("shingles").alias("shingles_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("class").alias("class_b"), F.col("shingles").alias("shingles_b")), "b")
    return both.where(jaccard(F.col("shingles_a"), F.col("shingles_b")) >= similarity).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def exact_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Columns a, b that join the classes of all similar sets (node, class, shingles); exact."""
    rows = as_table(entries(sets, similarity), "entries")
    lists = rows.groupBy("s").agg(F.count("*").alias("n"), F.bool_or("open").alias("any"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("any and lo <> hi").select("s", "n")
    listed = as_table(rows.join(lists, "s"), "listed")
    links = verified(list_pairs(listed, similarity), sets, similarity)
    if not listed.where(F.col("n") > LIST).isEmpty():
        tasks = as_table(block_jobs(listed, similarity), "tasks")
        jobs = tasks.join(sets.select("node", "shingles"), "node").groupBy("job")
        links = links.union(jobs.applyInPandas(lambda p: linked_roots(p, similarity), "a long, b long"))
    return links


def similar_classes(docs: DataFrame, size: int, radius: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Columns id, fp, component_id: one row for each row of docs."""
    rows = as_table(signatures(docs, size, id_col, text_col), "signatures")
    n = rows.count()
    near = fingerprint_classes(rows.select(F.col("node").alias("id"), "fp"), radius, n)
    seen = rows.groupBy("node", "fp").agg(F.min(F.struct("id", "said")).alias("row"), F.max("len").alias("len"), F.max("bands").alias("bands")).join(near.withColumnRenamed("component_id", "class"), "fp")
    seen = as_table(seen, "seen", n * WIDE)
    nodes = as_table(seen.groupBy("node").agg(F.min("class").alias("class"), F.min("row").alias("row"), F.max("len").alias("len"), F.max("bands").alias("bands")), "nodes", n * WIDE)
    same = seen.select("node", F.col("class").alias("b")).join(nodes.select("node", F.col("class").alias("a")), "node").where("a <> b").select("a", "b")

    met = bucketed(nodes, n)
    many = met.count()
    pairs = as_table(candidate_pairs(met, similarity), "pairs", many * CENTRES)
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = as_table(shingle_sets(docs, nodes.join(needed, "node", "left_semi"), size, id_col, text_col), "sets", n * WEIGHT)
    links = verified(pairs, sets, similarity)
    roots = connected_components(links.union(same), rows=many).select(F.col("node").alias("class"), "root")
    named = nodes.select("node", "class").join(roots, "class", "left").select("node", F.coalesce("root", "class").alias("root"))
    named = as_table(named, "named", n)

    large = met.where(F.col("n") > PAIRED).select("bucket", "node").join(named, "node")
    mixed = large.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    rest = as_table(large.join(mixed, "bucket").select("node", F.col("root").alias("class")).distinct(), "rest", n)
    if not rest.isEmpty():
        drop_tables(sets)
        again = nodes.select("node", "row").join(rest, "node")
        sets = as_table(shingle_sets(docs, again, size, id_col, text_col), "sets", n * WEIGHT)
        found = as_table(exact_links(sets, similarity), "links", many)
        joined = connected_components(found, rows=many).select(F.col("node").alias("root"), F.col("root").alias("top"))
        final = as_table(named.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "named", n)
        drop_tables(named, found)
        named = final

    least = rows.groupBy("node").agg(F.min("id").alias("first")).join(named, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    names = as_table(named.join(least, "root").select("node", "component_id"), "names", n)
    drop_tables(near, seen, nodes, met, pairs, sets, rest, named)
    return rows.select("id", "fp", "node").join(names, "node", "left").select("id", "fp", "component_id")
