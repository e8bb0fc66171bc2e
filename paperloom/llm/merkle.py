"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text splits into paragraphs at each newline, and a paragraph into pieces: a
sentence each, of at most PIECE code points. A section ends after a paragraph
whose hash begins with 0 or 1, so an edit moves no later border. A piece's hash
is of its text, every other hash is of the whole hashes below, so equal roots
mean equal texts as surely as SHA-256 does. The fingerprint holds the whole
tree, the root in full and DIGITS digits of every other hash:

    root;section=paragraph:piece,piece|paragraph:piece;section=...

Branches that differ locate edits; likeness is the Dice share of the pieces.
DataFrame functions only.

Cases: a null text counts as empty, and empty texts have one fingerprint; texts
of any length are read whole; an empty table gives an empty result; other
columns are not read. In the order of documents rows that repeat an id stand
together: each has the same next document, whose text is the greatest of those
with that id; a null id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_table, documents

#: Most code points of a piece; hex digits of a node's hash.
PIECE, DIGITS = 100, 12
#: A sentence, or what ends the paragraph, or as much as fits.
SPLIT = r"(?s).{1,%d}?(?:[.!?](?=\s|\z)|\z)|.{1,%d}" % (PIECE - 1, PIECE)
#: Ids that a task puts in order.
IDS = 50_000


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _short(digest: Column) -> Column:
    return F.left(digest, F.lit(DIGITS))


def add_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the fingerprint of a text column. The steps are columns of their own, so that none is computed twice."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(SPLIT), F.lit(0)), _hash))
    hashed = F.transform(cut, lambda x: F.struct(_hash(F.array_join(x, ",")).alias("h"), F.array_join(F.transform(x, _short), ",").alias("pieces")))
    out = df.withColumn("__p", hashed)
    p = F.col("__p")
    out = out.withColumn("__e", F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == F.size(p)) | (p[i - 1]["h"] < "2")))
    e = F.col("__e")

    def section(end: Column, k: Column) -> Column:
        before = F.when(k > 0, e[F.greatest(k - 1, F.lit(0))]).otherwise(0)
        inside = F.slice(p, before + 1, end - before)
        joined = F.array_join(F.transform(inside, lambda x: F.concat(_short(x["h"]), F.lit(":"), x["pieces"])), "|")
        return F.struct(_hash(F.array_join(F.transform(inside, lambda x: x["h"]), "|")).alias("h"), joined.alias("below"))

    out = out.withColumn("__s", F.transform(e, section))
    root = _hash(F.array_join(F.transform("__s", lambda s: s["h"]), ";"))
    told = F.array_join(F.transform("__s", lambda s: F.concat(_short(s["h"]), F.lit("="), s["below"])), ";")
    return out.withColumn(name, F.concat_ws(";", root, told)).drop("__p", "__e", "__s")


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ";", 1)


def pieces(fingerprint: Column) -> Column:
    """Distinct hashes of the pieces of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit("(?<=[:,])[0-9a-f]{%d}" % DIGITS), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of two fingerprints' pieces, 0 to 1; 1 for equal fingerprints."""
    x, y = pieces(a), pieces(b)
    shared = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
    return F.when(a == b, 1.0).otherwise(shared)


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of b that a lacks: where an edit lies, as (position from 0, section)."""
    sections = lambda c: F.slice(F.split(c, ";", -1), F.lit(2), F.size(F.split(c, ";", -1)))
    mine = F.transform(sections(a), lambda s: F.left(s, F.lit(DIGITS)))
    placed = F.transform(sections(b), lambda s, i: F.struct(i.alias("position"), s.alias("section")))
    return F.filter(placed, lambda s: ~F.array_contains(mine, F.left(s["section"], F.lit(DIGITS))))


def _links(docs: DataFrame) -> DataFrame:
    """Columns k, home, take for each id k: the id whose next document it is, descending, and how much that one takes of it.

    Ids are dealt by range; within a range the id before is the window's, across ranges it is the last of the range before.
    """
    ids = docs.groupBy("k").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    ids = as_table(ids, "ids")
    parts = max(1, ids.count() // IDS)
    dealt = as_table(ids.repartitionByRange(parts, F.desc("k")).withColumn("part", F.spark_partition_id()), "dealt")
    w = Window.partitionBy("part").orderBy(F.desc("k"))
    inside = dealt.select("part", "k", F.lag("k").over(w).alias("home"), F.lag("n").over(w).alias("home_n"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = dealt.groupBy("part").agg(F.min("k").alias("tk"), F.min_by("n", "k").alias("tn"))
    tails = tails.select("part", *(F.coalesce(F.lag(c).over(order), F.last(c).over(whole)).alias(c) for c in ("tk", "tn")))
    take = F.floor(F.coalesce("home_n", "tn") / 2).cast("int")
    return as_table(inside.join(tails, "part").select("k", F.coalesce("home", "tk").alias("home"), take.alias("take")), "links")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document: columns id, n_chars, edited, next_fingerprint, fingerprint, edited_fingerprint."""
    lowest = -(1 << 63)
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(lowest)).alias("k"), F.coalesce(text_col, F.lit("")).alias("text"))
    told = add_fingerprint(keyed, F.col("text"), "fingerprint")
    # Both joins deal texts and fingerprints by k, and so share one exchange: each text is fingerprinted once.
    given = told.join(_links(keyed).hint("merge"), "k").groupBy("home").agg(F.max(F.struct(F.left("text", F.col("take")).alias("part"), F.col("fingerprint").alias("f"))).alias("g"))
    both = told.join(given.hint("merge"), told["k"] == given["home"])
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.left("g.part", F.floor(n / 2).cast("int")))
    both = both.select(F.when(F.col("k") != lowest, F.col("k")).alias("id"), n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("g.f").alias("next_fingerprint"), "fingerprint")
    return add_fingerprint(both, F.col("edited"), "edited_fingerprint")


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_next(documents(spark, sf_dir))
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
