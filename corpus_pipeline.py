"""A corpus pipeline of five stages over documents; each stage's rows are written and read again for the next.

Each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs, extra
ones and those with names that operators use themselves included. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm import minhash, mixing, packing, quality, secrets
from plexgraph.llm.common import stash, table, unused
from plexgraph.session import ship

#: Documents that score less are rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the classifier rejects. It is trained on the labels of sf_dir, of which null ids and other values
    than 0 and 1 are passed over. Every row is scored by its own text, a null text as an empty one, so rows that are
    repeated go or stay together; without labels every row scores 0.5 and stays."""
    ship(spark)
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "__score")
    return quality.score(docs, trees, keep=name).filter(F.col(name) >= QUALITY).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, as all stages on word shingles take where nothing else
    is stated; similarity 0.8): the one with the least id. Rows are told by id and text, so different texts that share
    an id, or have none, are decided one by one; rows equal in both stay once; rows without words all stay."""
    ship(spark)
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by a mark; n_chars follows the new text. No row goes: null and empty texts, null ids
    and repeated rows come out as they went in, apart from the secrets in their texts."""
    ship(spark)
    return secrets.redact(docs, secrets.weights_of(spark))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row up to three times, as its source's weight asks for: repeated rows, or none. Null sources are one
    source, weighed last; texts without words have size 0 and go with their hash; rows without an id are told apart by
    their text, and equal rows by their place in the file."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all rows into sequences of at most 1024 tokens: a row for each piece (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset). A null or empty text is the end id alone; null ids and repeated rows are packed like any."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("source mixing", mix_stage),
    ("packing", pack_stage),
]

#: Tokenizing, boosting and packing have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
