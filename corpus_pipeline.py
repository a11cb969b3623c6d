"""Corpus pipeline: documents through toxicity, line dedup, near duplicates, decontamination and packing.

Every stage works on all rows that the stage before it kept, which are written and read again in between; all but the
last return the columns of ``documents``. Documents found toxic go; repeated lines go, and with them documents that have
nothing else; of each group of near duplicates the document with the least id stays, and of rows with one id and text one
row; documents that hold a benchmark item go; what is left is packed. Null and empty texts pass all stages and pack as one
end mark each; an empty table gives no rows; other columns go along up to the last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common, decontaminate, line_dedup, ngram_join, packing, toxicity



def stage(f):
    """A stage that leaves no more working tables than its result reads."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded(spark)
        return common.tidied(f)(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, common.table(spark, sf_dir, "labels"))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can express neither the fitted model nor the tokens; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents. Each run has its own tables; those of a stage go when the next stage's rows are written."""
    docs, held = common.table(spark, sf_dir, "documents"), None
    for _, f in STAGES[:-1]:
        found = f(spark, docs, sf_dir)
        docs = common.save(found)
        common.release(found)
        held = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if held is not None and not common.read_by(out, [x.rpartition("/")[0] for x in held.inputFiles()]):
        common.release(held)
    return out
