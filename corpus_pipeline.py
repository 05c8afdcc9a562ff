"""A corpus pipeline of five operators: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaline.llm.common import stored
from tessaline.llm.decontaminate import clean_of_benchmark
from tessaline.llm.exact_dedup import keep_exact
from tessaline.llm.jaccard_join import keep_one_near
from tessaline.llm.language_id import identified
from tessaline.llm.packing import packed

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", identified),
    ("exact_dedup", keep_exact),
    ("ngram_jaccard_join", keep_one_near),
    ("decontamination", clean_of_benchmark),
    ("best_fit_packing", packed),
]

#: The language model and the packing are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
