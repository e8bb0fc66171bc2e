"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met by whole passes over it and a remainder. For the
remainder documents are counted by exact length: each length gives its
proportional share, and bounded-knapsack dynamic programming over the counts
left fills what is missing, exactly where lengths allow. Within a source and
length the documents with the smallest seeded hashes are taken.

Documents of one source and length spread over BUCKETS by hash, so that ranks
need no task to hold more than one bucket of them.

Cases: a null text has size 0, and such documents take no words; null is a
source, the last; rows that repeat an id and text are documents of their own;
an empty table gives an empty result; other columns are not read. Targets are
set on the driver, for at most MAX_SOURCES sources: more are an error. They go
to the tasks by a join. A source's distinct lengths meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_table, documents, words

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3, 17
BUCKETS = 512
#: Words that the dynamic programme fits, at least; the shares by length leave it about so many.
WINDOW = 50_000
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], cap: float = CAP, share: float = 1.0) -> list[float]:
    """Share of the sum of sizes by weight; what exceeds cap times a size goes to the others by weight, until none exceeds it."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length sum to budget, or else to the largest sum below it; counts bound them.

    The reachable sums are the bits of an integer; each length joins in blocks of 1, 2, 4, ... documents.
    """
    full = (1 << (budget + 1)) - 1
    bits, steps = 1, []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, block = min(count, budget // length), 1
        while left and not bits >> budget & 1:
            n = min(block, left)
            more = (bits | bits << (length * n)) & full
            if more != bits:
                steps.append((i, n, bits))
                bits = more
            left -= n
            block *= 2
        if bits >> budget & 1:
            break
    taken, at = [0] * len(lengths), bits.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= lengths[i] * n
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Whole passes, and of how many documents of each length one more copy is taken."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), dtype=np.int64)
    if not total:
        return 0, extra
    passes = min(int(target // total), int(target))
    rest = round(target - passes * total)
    if rest >= total:
        return passes + 1, extra
    ideal = counts * (rest / total)
    extra = np.where(lengths > 0, np.floor(ideal).astype(np.int64), 0)
    order = np.random.default_rng(seed).permutation(len(lengths))
    order = order[(lengths[order] > 0) & (extra[order] < counts[order])]
    by_part = order[np.argsort(-(ideal - extra)[order], kind="stable")]
    missing = rest - int((extra * lengths).sum())
    most = WINDOW + int(np.median(lengths[lengths > 0]))
    extra[by_part[np.cumsum(lengths[by_part]) <= missing - most]] += 1
    missing = rest - int((extra * lengths).sum())
    order = order[extra[order] < counts[order]]
    extra[order] += np.array(knapsack(lengths[order].tolist(), (counts - extra)[order].tolist(), missing), dtype=np.int64) if len(order) and missing > 0 else 0
    return passes, extra


@dataclass
class Mix:
    """docs: columns id, key, has, src, size, copies, in this mix; sources: columns has, src, source_size, target."""

    docs: DataFrame
    sources: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Sources in order of code points, null last, have the weights, repeated; copies is how often a document is taken."""
    src = F.col(source_col).cast("string")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(F.col(id_col).alias("id"), key.alias("key"), src.isNotNull().alias("has"), F.coalesce(src, F.lit("")).alias("src"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    sized = as_table(sized.withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(BUCKETS))), "sized")
    found = sized.groupBy("has", "src").agg(F.sum("size").alias("total")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (not r["has"], r["src"]))
    aims = targets([r["total"] for r in found], [weights[i % len(weights)] for i in range(len(found))], cap, share)
    rows = [(r["has"], r["src"], r["total"], t) for r, t in zip(found, aims, strict=True)]
    sources = as_table(docs.sparkSession.createDataFrame(rows, "has boolean, src string, source_size long, target double"), "sources")
    counted = as_table(sized.groupBy("has", "src", "size", "bucket").count(), "counted")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        passes, extra = fit(part["size"].to_numpy(), part["n"].to_numpy(), float(part["target"].iloc[0]), seed)
        return part.drop(columns="target").assign(passes=passes, extra=extra)

    by_length = counted.groupBy("has", "src", "size").agg(F.sum("count").alias("n")).join(sources.drop("source_size"), ["has", "src"])
    picks = by_length.groupBy("has", "src").applyInPandas(fitted, "has boolean, src string, size long, n long, passes long, extra long")
    below = Window.partitionBy("has", "src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("before", F.coalesce(F.sum("count").over(below), F.lit(0)))
    keys = ["has", "src", "size"]
    quota = ranked.join(picks, keys).select(*keys, "bucket", "passes", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), "count").alias("quota"))
    quota = as_table(quota, "quota")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("key", "id"))
    out = sized.withColumn("rank", rank).join(quota, [*keys, "bucket"])
    return Mix(out.select("id", "key", *keys, (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("long")).alias("copies")), sources)


def mixed_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as mixed: a row for each copy taken. Copies of rows that repeat an id and text are dealt evenly among them."""
    lowest = F.lit(-(1 << 63))
    mixed = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **options).docs
    counted = mixed.groupBy(F.col("key").alias("__key"), F.coalesce("id", lowest).alias("__id")).agg(F.sum("copies").alias("__n"), F.count("*").alias("__m")).where("__n > 0")
    keyed = docs.withColumn("__key", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), lowest))
    both = keyed.join(counted, ["__key", "__id"])
    rank = F.row_number().over(Window.partitionBy("__key", "__id").orderBy("__key"))
    times = F.expr("__n div __m") + (rank <= F.col("__n") % F.col("__m")).cast("long")
    both = both.withColumn("__times", times).where("__times > 0")
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    out = mixed.docs.join(mixed.sources, ["has", "src"])
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
