"""Writers: relations as Parquet, appended, replaced or merged; exports as JSON, CSV and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without the keys of the new ones, and the new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> None:
    """Rewrites a relation with the new rows merged in: written beside it first, then put in its place."""
    side = f"{path}.{uuid.uuid4().hex}"
    upserted(spark.read.parquet(path), new, key).write.parquet(side)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(side), fs_path(path))


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def ingested(tables: DataFrame, test: DataFrame) -> DataFrame:
    """Catalog entries with their split: test if a test query has the table as an answer."""
    wanted = test.select(F.explode("answer_tables").alias("table_id")).distinct().withColumn("_t", F.lit(True))
    rows = tables.join(wanted, "table_id", "left")
    return rows.select("table_id", F.col("title").alias("document_title"), "section_title", F.to_json("columns").alias("columns"), "column_count", "row_count", F.to_json(F.slice("rows", 1, 3)).alias("sample_rows"), F.when(F.col("_t"), "test").otherwise("train").alias("split"))


def query_relation(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.col("question").alias("query_text"), "answer", F.get("answer_tables", F.lit(0)).alias("ground_truth_table_id"), F.to_json("answer_tables").alias("ground_truth_table_ids"), F.to_json("metadata").alias("metadata"))


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def csv_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def single_csv(df: DataFrame, path: str) -> None:
    """One CSV file of that name: written by one task beside it, then put in its place."""
    spark = df.sparkSession
    side = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(side)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at(side)) if f.getPath().getName().startswith("part-"))
    fs.delete(at(path), False)
    fs.rename(part, at(path))
    fs.delete(at(side), True)


def catalog_info(spark: SparkSession, database: str = "default") -> list[tuple[str, int]]:
    """Tables of a database and their numbers of columns."""
    return [(t.name, len(spark.table(f"{database}.{t.name}").columns)) for t in spark.catalog.listTables(database)]


def isolated(spark: SparkSession, name: str, shared: list[str], source: str = "default") -> None:
    """A database of its own with views on shared relations."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    for t in shared:
        spark.sql(f"CREATE OR REPLACE VIEW {name}.{t} AS SELECT * FROM {source}.{t}")


def merged_cache(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Existing keys win."""
    return old.select(key, F.col(value).alias("a")).join(new.select(key, F.col(value).alias("b")), key, "full_outer").select(key, F.coalesce("a", "b").alias(value))


def manchester(classes: DataFrame) -> DataFrame:
    """Class frames as text: one row a class."""
    parent = F.when(F.col("parent").isNotNull(), F.concat(F.lit("\n    SubClassOf: "), F.col("parent"))).otherwise("")
    return classes.select("class", F.concat(F.lit("Class: "), F.col("class"), parent).alias("frame"))


def passages(rows: DataFrame) -> DataFrame:
    """Answers exploded, one row a (query, table), for baselines that know one answer."""
    return rows.select("query_id", "question", F.explode("answer_tables").alias("table_id"))
