"""Readers of a lake: CSV, JSON and JSONL tables, queries, relations. Nothing is inferred; all cells are strings."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.sources import storage

UNIFIED = "id string, table_id string, title string, section_title string, source_file string, columns array<string>, column_count int, row_count int, rows array<array<string>>, metadata map<string,string>, _corrupt_record string"
QUERY = "query_id string, question string, answer_tables array<string>, metadata map<string,string>, split string, answer string"
NESTED = "tableId string, documentTitle string, documentUrl string, columns array<struct<text:string>>, rows array<struct<cells:array<struct<text:string>>>>"
CELLS = "table_id string, title string, row_index int, column_index int, value string"


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file: header first, quotes doubled, line ends in cells, all strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all CSV files of a folder, whatever their headers; row -1 is the header. Bad UTF-8 is replaced. A file is
    read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select(X.file_identity(F.element_at(F.split("path", "/"), -1)).alias("f"), "content").select("f.table_id", "f.title", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for table, title, content in batch.itertuples(index=False):
                held = []
                for i, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""))):
                    held += [(table, title, i - 1, j, v) for j, v in enumerate(row)]
                    if len(held) > 50_000:
                        yield pd.DataFrame(held, columns=["table_id", "title", "row_index", "column_index", "value"])
                        held = []
                yield pd.DataFrame(held, columns=["table_id", "title", "row_index", "column_index", "value"])

    return files.mapInPandas(parse, CELLS)


def catalog_of(cells: DataFrame) -> DataFrame:
    """table_id, title, columns, column_count, row_count from cells with a header row."""
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("row_index") == -1, F.struct("column_index", "value")))), lambda s: s["value"])
    out = cells.groupBy("table_id").agg(F.first("title").alias("title"), head.alias("columns"), (F.max("row_index") + 1).alias("row_count"))
    return out.withColumn("column_count", F.size("columns"))


def unified_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Unified table JSON files; broken ones are left out (``broken_tables`` lists them)."""
    return _unified(spark, folder).where("table_id is not null and _corrupt_record is null").drop("_corrupt_record")


def broken_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _unified(spark, folder).where("table_id is null or _corrupt_record is not null").select("file")


def _unified(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(UNIFIED).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder).withColumn("file", F.input_file_name())


def unified_cells(tables: DataFrame) -> DataFrame:
    rows = tables.select("table_id", F.posexplode("rows").alias("row_index", "row"))
    return rows.select("table_id", "row_index", F.posexplode("row").alias("column_index", "value")).withColumn("value", F.coalesce("value", F.lit("")))


def nested_tables(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSONL tables in the unified form."""
    t = spark.read.schema(NESTED).json(path)
    rows = F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"]))
    columns = F.transform("columns", lambda c: c["text"])
    return t.select(F.col("tableId").alias("table_id"), F.col("documentTitle").alias("title"), F.lit("").alias("section_title"), columns.alias("columns"), F.size(columns).alias("column_count"), F.size("rows").alias("row_count"), rows.alias("rows"), F.create_map(F.lit("document_url"), F.col("documentUrl")).alias("metadata"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Unified query JSONL."""
    return spark.read.schema(QUERY).json(path)


def split_queries(raw: DataFrame, train: int, seed: int = 42) -> DataFrame:
    """The first ``train`` in hash order are train, the others test; one global rank of ids only."""
    order = F.md5(F.concat(F.col("query_id").cast("string"), F.lit(f":{seed}")))
    first = raw.select("query_id").orderBy(order, "query_id").limit(train).withColumn("_t", F.lit(True))
    return raw.join(first, "query_id", "left").withColumn("split", F.when(F.col("_t"), "train").otherwise("test")).drop("_t")


def united_splits(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn("original_split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def answers(ids: Column, single: Column) -> Column:
    """Answer tables from a JSON list, or the single one."""
    return F.coalesce(F.from_json(ids, "array<string>"), F.array(single))


def scan(df: DataFrame, where: str | None = None, limit: int | None = None) -> DataFrame:
    df = df.where(where) if where else df
    return df.limit(limit) if limit is not None else df


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def sql(spark: SparkSession, statement: str, table: DataFrame) -> DataFrame:
    """A SELECT over the relation named ``table``, or a WHERE condition."""
    if statement.lstrip().upper().startswith("SELECT"):
        return spark.sql(re.sub(r"(?i)\bFROM\s+table\b", "FROM {table}", statement), table=table)
    return table.where(statement.lstrip().removeprefix("WHERE ").removeprefix("where "))


def batch_of(catalog: DataFrame, done: DataFrame, key: str, size: int) -> DataFrame:
    """The next ``size`` rows in key order that aren't done."""
    return catalog.join(done.select(key), key, "left_anti").orderBy(key).limit(size)


def batches(catalog: DataFrame, key: str, size: int) -> DataFrame:
    """Every row with its batch number in key order: ranges of keys are numbered apart and shifted by the rows before."""
    ranged = storage.checkpointed(catalog.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_p").count().select("_p", before.alias("_s"))  # one row a partition
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    return numbered.join(F.broadcast(starts), "_p").withColumn("batch", F.floor((F.col("_s") + F.col("_r")) / size).cast("int")).drop("_p", "_r", "_s")


def analyses(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The first of several candidate files of a folder that exists, as JSON records."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.option("multiLine", True).json(f"{folder}/{name}")
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def table_rows(cells: DataFrame, table_id: str) -> DataFrame:
    """Rows of one table as arrays in column order."""
    mine = cells.where(F.col("table_id") == table_id)
    return mine.groupBy("row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "value"))), lambda s: s["value"]).alias("row"))


def parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(folder)


def ontology(classes: DataFrame, dataset: str, iteration: int = -1) -> DataFrame:
    """Classes of a dataset's ontology of an iteration (-1: the latest); ids end in iter_n."""
    n = F.regexp_extract("ontology_id", r"iter_(\d+)$", 1).cast("int")
    rows = classes.where(F.col("dataset") == dataset).withColumn("iteration", n)
    if iteration >= 0:
        return rows.where(F.col("iteration") == iteration)
    return rows.join(F.broadcast(rows.agg(F.max("iteration").alias("iteration"))), "iteration")


def embeddings_or(df: DataFrame, fallback: DataFrame, key: str, vec: str) -> DataFrame:
    """Vectors, with those of the fallback for missing keys."""
    return df.select(key, vec).unionByName(fallback.join(df.select(key), key, "left_anti").select(key, vec))
