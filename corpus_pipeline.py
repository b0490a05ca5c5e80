"""Five stages over documents: toxicity, SimHash near-dedup, substring dedup, benchmark decontamination, BPE round trip.

Each stage is one of the operators in rackwise.llm, applied to all that the stage before it kept; the first four return the columns
of documents. Rows are judged one by one, whatever their doc_id: a null or repeated doc_id neither saves nor drops a row. Near-dedup keeps
the row with the least doc_id (nulls last) of a group. Near copies are those of the SimHash operator's contract (4-word shingles, 4 bits).
Null texts are empty; empty texts are one group of copies; empty tables give empty results; other columns of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.llm.bpe import round_trip
from rackwise.llm.common import stored, table
from rackwise.llm.decontaminate import without_contaminated
from rackwise.llm.queries import ship
from rackwise.llm.simhash import one_of_each_group
from rackwise.llm.substring import substring_dedup
from rackwise.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text that has none stays as it is."""
    found = substring_dedup(docs, others=("lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return found.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("benchmark_decontamination", drop_contaminated), ("bpe_round_trip", encode)]

#: No stage but the last could be put into SQL; tests/llm/test_pipeline.py holds run() and its stages against planted cases and plain recounts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
