"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read back as the next stage's ``docs``. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cityflux.llm.exact_dedup import drop_exact_duplicates
from cityflux.llm.packing import TOKENIZER, added_tokens, pack_documents
from cityflux.llm.simhash import drop_near_duplicates
from cityflux.llm.suffix_dedup import drop_repeats
from cityflux.llm.tables import stored
from cityflux.llm.toxicity import drop_toxic
from cityflux.sources.testdata import table


#: bytes of a repeated passage that goes. Passages of over 50 words count as repeats; 51 words of
#: the given documents have 314 bytes in the median, 238 at the 1 % quantile and 152 at the
#: 0.1 % quantile (junk of very short words). The operator's own default is 400.
PASSAGE = 200


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the labels of the same folder train the network."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints."""
    return drop_near_duplicates(docs, words=4, radius=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE`` bytes or more that occur elsewhere.

    Texts that become equal or empty by the cuts stay: the row keeps its id.
    """
    return drop_repeats(docs, window=PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, in pieces with their places in sequences of 2048."""
    return pack_documents(docs, added=added_tokens(TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: SQL cannot train a network or pack; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
