"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

Quality classifier, near-duplicates, benchmark decontamination, secret scan, mixing. The first four
return the columns of `documents`; the last adds `copies`, how often the mix takes a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeweft.llm import decontaminate, jaccard, mixing, quality, secrets
from codeweft.llm.common import cut, release, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for toxic or of low quality go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links first, then all links at 0.8."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secrets.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights of their sources; `copies` says how often."""
    return mixing.mixed(docs)


#: What Spark hands a Python worker at once: texts come in batches of some MB, not of 10 000 rows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304"


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with small Arrow batches; the setting stays with the session, for the stage's rows are only made later."""

    def bound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bound


STAGES = [
    ("quality classifier", bounded(classify)),
    ("SimHash near-dedup", bounded(deduplicate)),
    ("benchmark decontamination", bounded(decontaminated)),
    ("secret scan", bounded(redact)),
    ("mixing", bounded(mix)),
]

#: A trained classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what the stages wrote on the way is deleted as soon as the next table stands."""
    docs, since = table(spark, sf_dir, "documents"), written()
    before = spark.conf.get(BATCH, None)
    try:
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
            release(spark, since, keep=1)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    return docs
