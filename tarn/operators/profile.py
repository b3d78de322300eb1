"""Column profiles and their serialisation to text.

Tables are rows of (table_id, columns array); cells are (table_id, row_index,
column_index, value), so a lake of any number of tables of any width is two
relations, and a column is a group, never a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import stats
from tarn.functions import text as X

#: Values shown of a column, characters of a shown value, rows of a flattened table.
SAMPLES, SHOWN, FLAT_ROWS = 5, 100, 500


def headers(tables: DataFrame) -> DataFrame:
    """table_id, column_index, header; a header that occurred before in its table becomes name:index."""
    rows = tables.select("table_id", F.posexplode("columns").alias("column_index", "name"))
    again = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("column_index")) > 1
    return rows.select("table_id", "column_index", F.when(again, F.concat_ws(":", "name", F.col("column_index").cast("string"))).otherwise(F.col("name")).alias("header"))


def cells_of(df: DataFrame, table_id: str, columns: list[str], row: Column) -> DataFrame:
    """The cells of an ordinary table: one pass, no shuffle."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_index"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.lit(table_id).alias("table_id"), row.alias("row_index"), F.explode(cells).alias("c")).select("table_id", "row_index", "c.column_index", F.coalesce("c.value", F.lit("")).alias("value"))


def with_virtual(cells: DataFrame, virtual: DataFrame, index: DataFrame) -> DataFrame:
    """Cells with virtual columns appended: virtual (table_id, row_index, value) at the table's column_index of ``index``;
    rows without a value get an empty cell."""
    rows = cells.select("table_id", "row_index").distinct().join(index, "table_id")
    new = rows.join(virtual, ["table_id", "row_index"], "left").select("table_id", "row_index", "column_index", F.coalesce("value", F.lit("")).alias("value"))
    return cells.select("table_id", "row_index", "column_index", "value").unionByName(new)


def column_counts(cells: DataFrame) -> DataFrame:
    return stats.counts(cells, ["table_id", "column_index"], "value")


def samples(cells: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n different values of each column that aren't blank, in row order, shortened."""
    seen = cells.where(~X.blank(F.col("value"))).groupBy("table_id", "column_index", "value").agg(F.min("row_index").alias("p"))
    order = Window.partitionBy("table_id", "column_index").orderBy("p", "value")
    top = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("r", F.substring("value", 1, SHOWN).alias("v"))))
    return top.groupBy("table_id", "column_index").agg(F.transform(listed, lambda s: s["v"]).alias("sample_values"))


def summaries(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Header, counts and samples of every column of every table."""
    key = ["table_id", "column_index"]
    return headers(tables).join(column_counts(cells), key, "left").join(samples(cells), key, "left")


def serialised_table(title: Column, section: Column, columns: Column) -> Column:
    """Title, section and column names as one text."""
    head = F.concat_ws(" - ", F.nullif(F.btrim(title), F.lit("")), F.nullif(F.btrim(section), F.lit("")))
    return F.concat(head, F.lit("\nColumns: "), F.concat_ws(", ", F.filter(columns, lambda c: c != "")))


def flattened(cells: DataFrame, rows: int = FLAT_ROWS) -> DataFrame:
    """table_id, text: "Row i: a, b" of the first rows; blank cells and empty rows are left out."""
    filled = cells.where((F.col("row_index") < rows) & ~X.blank(F.col("value")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "value"))), lambda s: s["value"]), ", ")
    lines = filled.groupBy("table_id", "row_index").agg(F.concat(F.lit("Row "), F.col("row_index").cast("string"), F.lit(": "), line).alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda s: s["line"]), "\n").alias("text"))


def stats_text(unique: Column, low: Column, high: Column, mean: Column, top: Column) -> Column:
    """"N unique, range a to b, mean m, top: x, y" with what there is."""
    return F.concat_ws(", ", F.concat(X.short_number(unique), F.lit(" unique")), F.concat(F.lit("range "), X.short_number(low), F.lit(" to "), X.short_number(high)), F.concat(F.lit("mean "), X.short_number(mean)), F.when(F.size(top) > 0, F.concat(F.lit("top: "), F.array_join(F.slice(top, 1, 3), ", "))))


def column_text(name: Column, class_name: Column, description: Column, stats_: Column, level: int) -> Column:
    """Level 1: class and name; 2: with the description; 3: with the statistics too."""
    head = F.concat(F.lit("["), class_name, F.lit("] "), name)
    if level == 1:
        return head
    described = F.concat_ws(": ", head, F.nullif(description, F.lit("")))
    return described if level == 2 else F.concat(described, F.when(stats_ != "", F.concat(F.lit(" ("), stats_, F.lit(")"))).otherwise(""))


def joined_views(columns: DataFrame, text: str, separator: str = " || ") -> DataFrame:
    """table_id, text: a table's column texts in column order."""
    listed = F.array_sort(F.collect_list(F.struct("column_index", F.col(text).alias("t"))))
    return columns.groupBy("table_id").agg(F.array_join(F.transform(listed, lambda s: s["t"]), separator).alias("text"))


def merged_descriptions(descriptions: Column, statistics: Column) -> Column:
    """"name: description" and "name: statistics" lists (separated by " || ") merged by name."""
    pairs = lambda c: F.transform(F.filter(F.split(c, r" \|\| "), lambda s: F.instr(s, ": ") > 0), lambda s: F.struct(F.substring_index(s, ": ", 1).alias("k"), F.substr(s, F.instr(s, ": ") + 2).alias("v")))
    known = F.map_from_entries(F.array_distinct(pairs(statistics)))
    return F.array_join(F.transform(pairs(descriptions), lambda p: F.concat(p["k"], F.lit(": "), p["v"], F.coalesce(F.concat(F.lit(" ("), F.element_at(known, p["k"]), F.lit(")")), F.lit("")))), " || ")


def index_document(description: Column, columns: Column, statistics: Column, fields: str) -> Column:
    """Text of a table for the index: td, td_cd or td_cd_cs."""
    if fields not in ("td", "td_cd", "td_cd_cs"):
        raise ValueError(fields)
    parts = [F.nullif(description, F.lit(""))]
    if "cd" in fields:
        merged = merged_descriptions(columns, statistics) if fields.endswith("cs") else columns
        parts.append(F.nullif(merged, F.lit("")))
    return F.concat_ws("\n", *parts)


def column_types(classes: Column) -> Column:
    """Different class names in order, without prefixes."""
    return F.array_distinct(F.transform(classes, X.strip_prefix))


def fallback_only(types: Column) -> Column:
    return F.forall(types, lambda t: t == "Column")


def retrieval_record(rows: DataFrame) -> DataFrame:
    """Export row from (table_id, title, description, column_descriptions, column_stats, classes)."""
    types = column_types(F.col("classes"))
    return rows.select("table_id", F.coalesce(F.nullif("description", F.lit("")), F.col("title")).alias("table_description"), X.drop_header_suffix(F.col("column_descriptions")).alias("column_descriptions"), X.drop_header_suffix(F.col("column_stats")).alias("column_stats"), types.alias("column_types"), fallback_only(types).alias("has_fallback_only"), F.size("classes").alias("num_cols"))


def markdown(columns: Column, rows: Column, most_tokens: int | None = None) -> Column:
    """A table as markdown; with a budget (four characters a token) only as many rows as fit."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.concat(line(columns), F.lit("\n"), line(F.transform(columns, lambda c: F.lit("---"))))
    body = F.transform(rows, line)
    if most_tokens is not None:
        start = F.struct(F.length(head).alias("n"), F.array().cast("array<string>").alias("kept"))
        fits = F.aggregate(body, start, lambda acc, r: F.when((acc["n"] + F.length(r) + 1) / 4 <= most_tokens, F.struct((acc["n"] + F.length(r) + 1).alias("n"), F.concat(acc["kept"], F.array(r)).alias("kept"))).otherwise(acc))
        body = fits["kept"]
    return F.concat_ws("\n", head, F.nullif(F.array_join(body, "\n"), F.lit("")))


def packed(rows: DataFrame, by: list[str], order: str, text: str, budget: int = 512, separator: str = " | ") -> DataFrame:
    """Neighbouring texts of a group joined while their words stay within the budget: block, text. One sequential fold a
    group, in its row order; a group must fit a task, as its blocks depend on one another."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = words(x["t"])
        fits = (acc["n"] == 0) | (acc["n"] + n <= budget)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"), F.when(acc["n"] == 0, x["t"]).when(fits, F.concat(acc["cur"], F.lit(separator), x["t"])).otherwise(x["t"]).alias("cur"), F.when(fits, acc["n"] + n).otherwise(n).alias("n"))

    folded = rows.groupBy(*by).agg(F.aggregate(seq, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])).alias("blocks"))
    return folded.select(*by, F.posexplode("blocks").alias("block", "text"))


def parsed_names(text: Column) -> Column:
    """Column names from a JSON list of names or of objects with a name."""
    plain = F.from_json(text, "array<string>")
    objects = F.transform(F.from_json(text, "array<struct<name:string>>"), lambda s: s["name"])
    return F.coalesce(F.when(F.exists(objects, lambda n: n.isNotNull()), objects), plain)


def value_list(text: Column) -> Column:
    """A comma list without blanks and "null"."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.btrim(s)), lambda s: (s != "") & (F.lower(s) != "null"))
