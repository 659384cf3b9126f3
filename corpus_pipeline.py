"""The corpus pipeline: five stages, each a DataFrame in and a DataFrame out.

Toxic documents go, repeated lines go, of each group of near copies one document stays,
documents with benchmark passages go, and sources are mixed to their target weights.
`run` writes each stage to the shared folder and reads it back as the next one's input, so a lost
executor costs part of one stage, and a stage's table is dropped when its successor is written.

Handling of odd rows follows from the stages: a null or empty text isn't toxic, has no lines to cut, links
with nothing and matches nothing, so its row reaches the mix; a null doc_id is never learned from, cut or
taken for a copy, but is judged for toxicity and benchmark passages like others; a null source is a source
of its own. Rows that share a doc_id stay or go together as near copies, and are judged by their own texts
elsewhere. Rows equal in all are repeated by equal counts. Empty tables give an empty result. Extra
columns are carried along, whatever their names; the mix adds `copy` and `shuffle_key`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from helixframe.llm.common import Scratch, read_table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard", ngram_join.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: The learned scores, the similarity join and the tiling can't be written in SQL; tests/llm/test_pipeline.py compares all stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
