"""A cleaning pipeline over ``documents``: each stage works on all that the one before it kept.

A stage of an empty table gives an empty one; columns beside those of documents aren't read and don't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import linededup, packing, simhash, suffixdedup, toxicity
from evigraph.llm.util import table, temporary, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go (score of 0.7 or more).

    Null and empty texts match nothing and stay; repeated rows and ids are judged row by row; other columns than those of documents are dropped.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("tox_predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines one stays; every row stays, null ids too, with the lines that are left.

    A null or empty text becomes or stays without lines; a repeated row loses what the first one keeps; ``n_chars`` is counted anew.
    """
    return _documents(linededup.dedup_lines(docs, columns=("lang", "source")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id, then the first by its columns; null ids come last."""
    return simhash.first_of_each(docs, COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur twice go; a character of which a byte went goes as a whole, others, U+FFFD too, stay.

    Every row stays; a null text becomes an empty one; of repeated rows of 200 bytes or more all bytes go, as they occur twice.
    """
    kept = suffixdedup.remove_repeats(docs, text=True, columns=("lang", "source"))
    return _documents(kept.withColumnRenamed("kept_text", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of 2048-token sequences; null and empty texts have their end token only, repeated rows their own pieces, a very long text many."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]
#: SQL can't say what a learned lexicon, MinHash or a merge table give; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:  # what a stage writes for itself goes with it
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
