"""The corpus pipeline: five stages over ``documents``.

Each stage gets what the one before kept and returns the columns of
``documents``, the last one the token counts and digests. Extra columns, also
with names that the operators use, travel along untouched. Every stage takes an
empty table and gives an empty one, handles a very long text whole and by itself,
and takes nulls in any column; what it does with null texts, ids and repeated rows
is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutworks.llm import decontamination, quality_rules, sentencepiece_bpe, simhash, substring_dedup
from boutworks.llm.queries import PIECE_MODEL
from boutworks.runtime import read_table, work_path


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all columns but the text as one."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(*[F.col(text).alias("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go; a null or empty text has too few words. Repeated rows are judged alike."""
    forest = quality_rules.fit_forest(docs, read_table(spark, sf_dir, "labels"))
    return _unpacked(quality_rules.apply_rules(_packed(docs), forest).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, a null id before all others.

    Texts without words, null ones too, are one group; of repeated rows one stays; of other rows with one id a hash of the row decides.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a null text stays null. Repeated rows lose what they share, each."""
    cut = substring_dedup.remove_repeats(_packed(docs))
    return _unpacked(cut.withColumn("kept", F.when(F.col("text").isNotNull(), F.col("kept_text"))), docs, "kept")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; a null text has none. Without benchmark items all stay."""
    kept = decontamination.remove_contaminated(_packed(docs), read_table(spark, sf_dir, "benchmark"))
    return _unpacked(kept, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left; a null text is empty, repeated rows stay."""
    return sentencepiece_bpe.digests(docs, PIECE_MODEL)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece", tokens),
]

#: Fingerprints, trees and token ids are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
