"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.

For every stage: null, empty and very long texts are rows like any other and are read whole; further
columns are kept up to the last stage, whatever their names; an empty table gives an empty table. A
null doc_id, lang or source is a value of its own. What ties and repeated rows give stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recfold.llm.common import table, written
from recfold.llm.decontaminate import decontaminate
from recfold.llm.packing import pack
from recfold.llm.quality import quality_filter
from recfold.llm.queries import tokenizer_path
from recfold.llm.simhash import drop_near_copies
from recfold.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive cutoffs reject go, null and empty texts among them. Repeated rows share their verdict."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact or near copies the least doc_id stays; of equal ones the first read, a null last. Texts without words are one group."""
    return drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start in two places or more are cut out, every one of them; what is left stays, unless it is blank. Null and empty texts stay."""
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows that share a doc_id, or have none, are judged together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of at most 1024 tokens. A null text is empty, repeated rows are packed once each, and pieces of equal length are told apart by rank."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))[0]


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising, fingerprints and suffix sorting are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
