"""The corpus pipeline: documents to token ids in five stages, each an operator of polyglint.llm on all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import quality
from polyglint.llm.common import give_back, written
from polyglint.llm.line_dedup import drop_recurring_lines
from polyglint.llm.mixing import mixed
from polyglint.llm.near_copies import first_of_each_group
from polyglint.llm.pieces import encode_decode
from polyglint.llm.queries import tokenizer_path
from polyglint.runtime import ready, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; it learns from the labels of those given."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(quality.keeps(F.col("quality.score"))).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across documents; n_chars counts the characters that are left."""
    return drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that pairs of 5-word Jaccard similarity 0.8 or more connect; rows without an id take part."""
    return first_of_each_group(docs).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixed(docs).where("mix.copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the text that the ids decode to."""
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), digest=False).select("doc_id", "lang", "source", "pieces.*")


def _relieved(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on executors that have given back what earlier ones left of their heaps."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("quality classifier", _relieved(keep_quality)),
    ("line dedup", _relieved(drop_lines)),
    ("simhash near-dedup", _relieved(drop_near_copies)),
    ("mixing", _relieved(mix_sources)),
    ("sentencepiece", _relieved(encode)),
]

#: No SQL has the classifier, SimHash or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
