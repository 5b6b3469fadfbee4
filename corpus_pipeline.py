"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.bpe import stage_bpe
from strandline.llm.common import Scratch, table
from strandline.llm.mixing import stage_mixing
from strandline.llm.neardup import stage_neardup
from strandline.llm.quality import stage_quality
from strandline.llm.secrets import stage_secrets

#: (name, function): each function takes (spark, docs, sf_dir) and returns a DataFrame. Near duplicates: five words, 0.8.
STAGES = [
    ("quality", stage_quality),
    ("neardup", partial(stage_neardup, shingle=5)),
    ("secrets", stage_secrets),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: SQL can express neither the compression scores nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    kept: DataFrame | None = None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if kept is not None:
            scratch.drop(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)
