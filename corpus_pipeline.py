"""A corpus pipeline over `documents`: STAGES in order, each over all that the one before kept, written as Parquet between.

Language identification drops documents without a language, line deduplication takes repeated lines out, near-duplicate detection keeps one document of each
group, mixing repeats documents so that sources meet their target weights, and encoding replaces texts by token ids. All but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm.bpe import stage_bpe
from timberline.llm.common import read, stored
from timberline.llm.language import stage_language
from timberline.llm.lines import stage_lines
from timberline.llm.minhash import stage_minhash
from timberline.llm.mixing import stage_mixing

STAGES = [
    ("language", stage_language),
    ("lines", stage_lines),
    ("near_duplicates", stage_minhash),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: None: language identification learns a model, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
