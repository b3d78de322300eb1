"""Typed column statistics as aggregates over (group, value) rows.

Every family is a function from a DataFrame of values to one row a group. Where
first-seen order decides (modes, top values) the rows need a position column.
Counting by value comes first, so a value that fills a third of a column is one
row before any shuffle of groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words left out of keyword statistics.
KEYWORD_STOPS = "the and for with that this from are was were has have had not but they you all can her his she him its who how what when where which".split()

#: A column is categorical if its share of different values is below the first and their number at most the second.
CATEGORICAL_RATIO, CATEGORICAL_MOST = 0.2, 50


def quartile(sorted_values: Column, i: int) -> Column:
    """The i-th exclusive quartile of a sorted array of at least two values."""
    n = F.size(sorted_values)
    j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4).cast("int"), n - 1))
    d = i * (n + 1) - 4 * j
    return F.when(n > 1, (F.element_at(sorted_values, j) * (4 - d) + F.element_at(sorted_values, j + 1) * d) / 4)


def _quartiles(counted: DataFrame, by: list[str]) -> DataFrame:
    """p25 and p75 per group without collecting a group: values with their cumulative counts, looked up at the two ranks."""
    order = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    placed = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(whole))
    exprs = []
    for i, name in ((1, "p25"), (3, "p75")):
        n = F.col("n")
        j = F.greatest(F.lit(1), F.least(F.floor(i * (n + 1) / 4), n - 1))
        d = i * (n + 1) - 4 * j
        at = lambda r: F.min(F.when(F.col("upto") >= r, F.col("v")))
        exprs.append(F.when(F.first("n") > 1, (at(j) * (4 - F.first(d)) + at(j + 1) * F.first(d)) / 4).alias(name))
    return placed.groupBy(*by).agg(*exprs)


def _counted(rows: DataFrame, by: list[str], value: str, pos: str | None) -> DataFrame:
    first = F.min(pos) if pos else F.lit(0)
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"), first.alias("p"))


def integer_stats(rows: DataFrame, by: list[str], value: str, pos: str | None = None) -> DataFrame:
    """count, min, max, sum, mean, median, std (null for one value), exclusive quartiles, mode (first seen on ties)."""
    return _numeric(rows, by, value, pos, True)


def decimal_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """As integers, without sum and mode."""
    return _numeric(rows, by, value, None, False)


def _numeric(rows: DataFrame, by: list[str], value: str, pos: str | None, whole: bool) -> DataFrame:
    counted = _counted(rows, by, value, pos)
    v, c = F.col("v"), F.col("c")
    n, total = F.sum(c), F.sum(v.cast("double") * c)
    exprs = [n.alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), (total / n).alias("mean"), F.percentile(v.cast("double"), F.lit(0.5), c).alias("median")]
    if whole:
        exprs += [F.sum(v * c).alias("sum"), F.max_by(v, F.struct(c, -F.col("p"), -v)).alias("mode")]
    base = counted.groupBy(*by).agg(*exprs)
    spread = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.when(F.count(value) > 1, F.stddev_samp(value)).alias("std"))
    return base.join(spread, by).join(_quartiles(counted.withColumn("v", v.cast("double")), by), by)


def nonnegative_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, mean of the values that aren't negative."""
    x = F.when(F.col(value) >= 0, F.col(value))
    return rows.groupBy(*by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))


def datetime_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Extremes in ISO form and the whole days between them (the time between, floored)."""
    low, high = F.min(value), F.max(value)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.groupBy(*by).agg(iso(low).alias("min"), iso(high).alias("max"), F.floor((micros(high) - micros(low)) / 86_400_000_000).cast("long").alias("range_days"))


def year_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range_years"))


def string_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, distinct, unique_ratio, lengths, words, categorical flag, entropy in bits, share of the most frequent value."""
    counted = _counted(rows, by, value, None)
    v, c = F.col("v"), F.col("c")
    words = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
    n = F.sum(c)
    ratio = F.count("*") / n
    out = counted.groupBy(*by).agg(
        n.alias("count"), F.count("*").alias("distinct"), F.bround(ratio, 3).alias("unique_ratio"), (F.sum(F.length(v) * c) / n).alias("avg_length"), F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"),
        (F.sum(words * c) / n).alias("word_count_avg"), F.bround(F.log2(n) - F.sum(c * F.log2(c.cast("double"))) / n, 3).alias("entropy"), F.bround(F.max(c) / n, 3).alias("dominant_ratio"),
    )
    return out.withColumn("is_categorical", (F.col("distinct") / F.col("count") < CATEGORICAL_RATIO) & (F.col("distinct") <= CATEGORICAL_MOST))


def top_values(rows: DataFrame, by: list[str], value: str, pos: str, k: int = 10) -> DataFrame:
    """value, n, rank of the k most frequent values of each group; ties in first-seen order."""
    counted = _counted(rows, by, value, pos)
    order = Window.partitionBy(*by).orderBy(F.desc("c"), "p", "v")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, F.col("v").alias("value"), F.col("c").alias("n"), "rank")


def common_affixes(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Longest common prefix and suffix of at least two characters that aren't blank; of one value, itself. The prefix of
    a set is that of its smallest and largest member."""
    r = F.reverse(F.col(value))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.reverse(F.min(r)).alias("c"), F.reverse(F.max(r)).alias("d"), F.count("*").alias("n"))
    prefix = _common(F.col("a"), F.col("b"))
    suffix = F.reverse(_common(F.reverse(F.col("c")), F.reverse(F.col("d"))))
    shown = lambda x: F.when(F.col("n") == 1, F.col("a")).when((F.length(x) >= 2) & (F.trim(x) != ""), x)
    return ends.select(*by, shown(prefix).alias("prefix"), shown(suffix).alias("suffix"))


def _common(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(acc))
    return F.substr(a, F.lit(1), same)


def keywords(rows: DataFrame, by: list[str], value: str, k: int = 5) -> DataFrame:
    """The k words of the highest sum of tf (ln(N / (df + 1)) + 1) over a group's N values. Each value sends one row
    without a word, whose count is N, so that the texts are read once."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(value)), F.lit("[a-zA-Z]{3,}"), F.lit(0)), lambda w: ~w.isin(KEYWORD_STOPS))
    marked = rows.where(F.col(value).isNotNull()).select(*by, value, F.monotonically_increasing_id().alias("_id"))
    each = marked.select(*by, "_id", F.explode(F.concat(F.array(F.lit("")), words)).alias("word"))
    terms = each.groupBy(*by, "_id", "word").agg(F.count("*").alias("n")).groupBy(*by, "word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    n = F.max(F.when(F.col("word") == "", F.col("df"))).over(Window.partitionBy(*by))
    scored = terms.withColumn("N", n).where("word <> ''").withColumn("score", F.col("tf") * (F.log(F.col("N") / (F.col("df") + 1)) + 1))
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "word", "score", "rank")


def boolean_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("count"), F.count_if(x).alias("true_count"), F.count_if(~x).alias("false_count"), F.avg(x.cast("double")).alias("true_ratio"))


def uri_stats(rows: DataFrame, by: list[str], value: str, k: int = 10) -> DataFrame:
    """The k most frequent hosts, with the number of different URIs."""
    v = rows.where(F.col(value).isNotNull())
    distinct = v.groupBy(*by).agg(F.count_distinct(value).alias("distinct"))
    hosts = v.withColumn("host", F.try_parse_url(F.col(value), F.lit("AUTHORITY"))).where("host is not null").groupBy(*by, "host").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "host")
    return hosts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(distinct, by)


def percentage_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, mean, median."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.median(x).alias("median"))


def currency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, sum, mean, median, std (null for one value)."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"))


def counts(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """total, null (blank or missing), unique, and both ratios."""
    filled = F.when(F.btrim(F.col(value)) != "", F.col(value))
    n = F.count("*")
    return cells.groupBy(*by).agg(n.alias("total_count"), (n - F.count(filled)).alias("null_count"), F.count_distinct(filled).alias("unique_count"), ((n - F.count(filled)) / n).alias("null_ratio"), (F.count_distinct(filled) / n).alias("unique_ratio"))


Family = Callable[[DataFrame, list[str], str], DataFrame]
#: Statistics by the range of a property; other ranges count as strings.
REGISTRY: dict[str, Family] = {}


def register(family: Family, *ranges: str) -> None:
    for r in ranges:
        REGISTRY[r] = family


register(integer_stats, "xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte")
register(nonnegative_stats, "xsd:nonNegativeInteger", "xsd:positiveInteger")
register(decimal_stats, "xsd:decimal", "xsd:float", "xsd:double")
register(datetime_stats, "xsd:dateTime", "xsd:dateTimeStamp", "xsd:date")
register(year_stats, "xsd:gYear")
register(boolean_stats, "xsd:boolean")
register(uri_stats, "xsd:anyURI")
register(percentage_stats, "percentage")
register(currency_stats, "currency")
register(string_stats, "xsd:string", "xsd:normalizedString", "xsd:token")


def statistics(range_type: str) -> Family:
    return REGISTRY.get(range_type, string_stats)
