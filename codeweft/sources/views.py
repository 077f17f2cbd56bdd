"""The domain relations as lazy views over the provided tables. Columns prune down to the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.sources.tables import table


def references(spark: SparkSession, root: str) -> DataFrame:
    """Edges from a place in a file to a binding."""
    file = F.col("l_orderkey") % 200
    return table(spark, root, "lineitem").select(
        (file % 2).cast("int").alias("realm"),
        F.col("l_suppkey").alias("source_artifact_id"),
        file.alias("source_file_id"),
        F.col("l_partkey").alias("target"),
        (F.ascii("l_returnflag") - 64 + F.when(F.col("l_linestatus") == "O", 20).otherwise(0)).alias("type"),
        F.col("l_quantity").cast("int").alias("line"),
        F.col("l_linenumber").alias("ref_id"),
        (F.col("l_discount") == 0).alias("duplicate"),
    )


def bindings(spark: SparkSession, root: str) -> DataFrame:
    """Declared program elements; a null file is a package without one."""
    file = F.col("p_partkey") % 200
    camel = F.regexp_replace(F.initcap("p_name"), " ", "")
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("binding_id"),
        (file % 2).cast("int").alias("realm"),
        (file % 10).alias("artifact_id"),
        F.when(F.col("p_size") % 10 != 0, file).alias("source_file_id"),
        (F.col("p_size") > 25).alias("include_in_type_search"),
        F.concat(F.lit("com."), F.lower("p_type"), F.lit("."), camel, (F.col("p_partkey") % 40).cast("string")).alias("binding"),
        F.col("p_size").alias("modifiers"),
        F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).alias("parent"),
    )


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Versioned libraries, coordinate and version apart."""
    key = F.col("s_suppkey")
    version = F.concat_ws(".", (key % 12).cast("string"), (key % 7).cast("string"), key.cast("string"))
    return (
        table(spark, root, "supplier")
        .join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("artifact_id"),
            F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("coordinate"),
            F.concat(version, F.when(key % 5 == 0, "-rc").otherwise("")).alias("version"),
        )
    )


def files(spark: SparkSession, root: str) -> DataFrame:
    """Source files by realm, artifact and id, with a content hash."""
    return table(spark, root, "pages").select(
        (F.col("page_id") % 2).cast("int").alias("realm"),
        (F.col("page_id") % 10).alias("artifact_id"),
        F.col("page_id").alias("source_file_id"),
        F.regexp_replace("url", "^[a-z]+://", "").alias("path"),
        ((F.col("page_id") * 7919) % 1000003).alias("hash"),
    )
