"""The corpus pipeline: language, lines, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. run applies them to
documents, with the result of each stage but the last written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import language, line_dedup, mixture, pieces, simhash
from paperloom.llm.common import as_table

#: A document whose best language has less than this mean probability is rejected.
MIN_SCORE = 0.35


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and how to name them again."""
    back = {f"__own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network learned from those labelled; the others, und and texts without a clear one, go.

    Without a labelled document nothing can be told, and all stay.
    """
    net = language.fit(docs)
    if not net.langs:
        return docs
    own, back = _apart(docs, "lang_pred", "score")
    found = language.identify(own, net).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that too many sources share; n_chars follows the text."""
    own, back = _apart(docs, "removed_lines")
    out = line_dedup.remove_boilerplate(own).drop("removed_lines").withColumnsRenamed(back).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, fingerprints within 2 bits or a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, size=5, radius=2, similarity=0.8)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mixture takes."""
    return mixture.mixed_documents(docs)


def merge_dropout(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, and lossless: whether they decode to the text; columns of these names are replaced."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("line_spread", line_spread),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("merge_dropout", merge_dropout),
]

#: A trained network, hashes and seeded choices decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
