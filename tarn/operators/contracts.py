"""Transform contracts: pattern and expression of a property, tried on a column's values.

All candidates of all columns are tried in one plan: candidate contracts join the
sampled values by class, each candidate's own pattern and expression is compiled
into one CASE over the contract id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import expressions, regex
from tarn.functions import text as X

#: Share of values that a contract must fit, budget of trials, fewest per contract, halving factor, contracts of a key.
ACCEPT, BUDGET, LEAST, ETA, PER_KEY = 0.85, 1000, 5, 2, 20


@dataclass(frozen=True)
class Contract:
    primitive_class: str
    data_property: str
    pattern: str
    expression: str
    target: str = "str"
    hits: int = 0

    @property
    def key(self) -> str:
        return "::".join((self.primitive_class, self.data_property, self.pattern))


def table(spark: SparkSession, contracts: list[Contract]) -> DataFrame:
    """The repository relation, with ids from the keys."""
    rows = [(c.primitive_class, c.data_property, c.pattern, c.expression, c.target, c.hits) for c in contracts]
    df = spark.createDataFrame(rows, "primitive_class string, data_property string, pattern string, expression string, target string, hits int")
    return df.withColumn("contract_id", X.short_md5(12, F.col("primitive_class"), F.col("data_property"), F.col("pattern")))


def outcome(value: Column, c: Contract) -> Column:
    """matched, ok and the result as a string, for one contract. A pattern that isn't RE2's matches nothing; an expression
    outside the vocabulary fails on every value."""
    hit = regex.matches(value, c.pattern)
    try:
        result = expressions.compile_expression(c.expression, value)
    except expressions.Refused:
        result = F.lit(None).cast("string")
    return F.struct(hit.alias("matched"), (hit & result.isNotNull()).alias("ok"), F.when(hit, result.cast("string")).alias("result"))


def systematic(cells: DataFrame, by: list[str], pos: str, most: Column | int) -> DataFrame:
    """Every step-th row of a group, at most ``most``."""
    w = Window.partitionBy(*by)
    rows = cells.withColumn("_i", F.row_number().over(w.orderBy(pos)) - 1).withColumn("_n", F.count("*").over(w))
    most = F.lit(most) if isinstance(most, int) else most
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most)).cast("int")
    return rows.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most)).drop("_i", "_n")


def success_rates(cells: DataFrame, by: list[str], value: str, contracts: list[Contract], pos: str | None = None, most: int | None = None) -> DataFrame:
    """tested, ok and rate of each contract on each group's values that aren't blank (or a systematic sample of them)."""
    rows = cells.where(~X.blank(F.col(value)))
    if most is not None and pos is not None:
        rows = systematic(rows, by, pos, most)
    tries = F.array(*[F.struct(F.lit(i).alias("contract"), outcome(F.col(value), c)["ok"].alias("ok")) for i, c in enumerate(contracts)])
    return rows.select(*by, F.explode(tries).alias("t")).groupBy(*by, F.col("t.contract").alias("contract")).agg(F.count("*").alias("tested"), F.count_if(F.col("t.ok")).alias("ok")).withColumn("rate", F.col("ok") / F.col("tested"))


def halving_plan(n: int, values: int, budget: int = BUDGET, eta: int = ETA) -> list[tuple[int, int]]:
    """Rounds of successive halving: samples of each and contracts that survive it."""
    if n < 2:
        return []
    rounds = floor(log(n, eta) + 1e-9)
    first = max(LEAST, budget // (n * rounds))
    out = []
    for s in range(rounds):
        n = max(1, n // eta)
        out.append((min(values, first * eta**s), n))
    return out


def best_contract(cells: DataFrame, value: str, pos: str, contracts: list[Contract], budget: int = BUDGET, eta: int = ETA, accept: float = ACCEPT) -> tuple[Contract | None, float]:
    """The contract left by successive halving, if it fits enough of the whole column; ties keep the earlier one. Each
    round is one aggregate; only the rates of the contracts come back."""
    rows = cells.where(~X.blank(F.col(value)))
    values = rows.count()
    alive = list(range(len(contracts)))
    if not alive or not values:
        return None, 0.0
    for sample, survivors in halving_plan(len(alive), values, budget, eta):
        got = {r["contract"]: r["rate"] for r in success_rates(rows, [], value, [contracts[i] for i in alive], pos, sample).collect()}
        alive = [alive[j] for j in sorted(got, key=lambda j: (-got[j], j))[:survivors]]
    best = contracts[alive[0]]
    rate = success_rates(rows, [], value, [best]).first()["rate"]
    return (best, rate) if rate >= accept else (None, rate)


def gate(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates (class, property, pattern, rate) to store: strictly better than the best one of their key, and new."""
    key = ["primitive_class", "data_property"]
    best = stored.groupBy(*key).agg(F.max("rate").alias("best"))
    fresh = candidates.join(stored.select(*key, "pattern"), [*key, "pattern"], "left_anti")
    return fresh.join(best, key, "left").where(F.col("best").isNull() | (F.col("rate") > F.col("best"))).drop("best")


def evict(contracts: DataFrame, most: int = PER_KEY) -> DataFrame:
    """The most used contracts of each key."""
    order = Window.partitionBy("primitive_class", "data_property").orderBy(F.desc("hits"), "contract_id")
    return contracts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def applied(cells: DataFrame, by: list[str], value: str, c: Contract) -> DataFrame:
    """The rows with result and state: ok, null (blank) or error (unmatched, or failed to convert)."""
    o = outcome(F.col(value), c)
    return cells.withColumn("_o", o).withColumn("state", F.when(X.blank(F.col(value)), "null").when(F.col("_o.ok"), "ok").otherwise("error")).withColumn("result", F.when(F.col("state") == "ok", F.col("_o.result"))).drop("_o")


def apply_counts(cells: DataFrame, by: list[str], value: str, c: Contract) -> DataFrame:
    s = F.col("state")
    return applied(cells, by, value, c).groupBy(*by).agg(F.count_if(s == "ok").alias("ok_count"), F.count_if(s == "null").alias("null_count"), F.count_if(s == "error").alias("error_count"))


def unmatched(cells: DataFrame, value: str, pos: str, c: Contract, most: int = 15) -> DataFrame:
    """The first values that aren't blank and don't match, as feedback."""
    return cells.where(~X.blank(F.col(value)) & ~regex.matches(F.col(value), c.pattern)).orderBy(pos, value).limit(most).select(value)


def error_samples(cells: DataFrame, value: str, pos: str, c: Contract, most: int = 5) -> DataFrame:
    """Values that fail, with the reason; unmatched ones first."""
    o = outcome(F.col(value), c)
    rows = cells.where(~X.blank(F.col(value))).withColumn("_o", o).where(~F.col("_o.ok"))
    reason = F.when(~F.col("_o.matched"), "pattern not matched").otherwise("transform failed")
    return rows.select(F.col(value).alias("value"), reason.alias("reason"), F.col("_o.matched").alias("_m"), F.col(pos).alias("_p")).orderBy("_m", "_p").limit(most).select("value", "reason")


def fallback(primitive_class: str, data_property: str, target: str) -> Contract:
    expression, pattern = expressions.FALLBACKS.get(target, expressions.FALLBACKS["str"])
    return Contract(primitive_class, data_property, pattern, expression, target)


# Template of a readout and its statistics by the range of the property; other ranges have the last.
TEMPLATES = [
    (("xsd:integer", "xsd:decimal", "xsd:nonNegativeInteger"), "{name}: {min}-{max} (avg {mean})", ["min", "max", "mean"]),
    (("xsd:dateTime", "xsd:dateTimeStamp"), "{name}: {min} to {max}", ["min", "max"]),
    (("xsd:anyURI",), "{name}: {distinct_count} unique URLs", ["distinct_count"]),
    (("xsd:string",), "{name}: {distinct_count} unique values", ["distinct_count"]),
    ((), "{name}: {count} values", ["count"]),
]
# How a readout shows a statistic.
FORMATS = {
    "value": ["min", "max", "percentile_25", "percentile_75", "mode"],
    "two": ["mean", "median", "std"],
    "number": ["sum", "count", "distinct_count", "max_length"],
    "percent": ["null_ratio"],
    "days": ["range_days"],
    "one": ["avg_length"],
    "words": ["word_count_avg"],
    "first": ["top_values", "sample_values", "tfidf_keywords", "domain_distribution"],
}


def template_of(range_type: str, name: str) -> tuple[str, list[str]]:
    """The template of a property by its range, with its name in place, and the statistics that it needs."""
    for ranges, template, needs in TEMPLATES:
        if range_type in ranges or not ranges:
            return template.replace("{name}", name), needs
    raise AssertionError("the last template is for all ranges")


def shown(statistic: str, c: Column, kind: str) -> Column:
    """A statistic as a readout shows it; ``kind`` is the column's type (``double``, ``bigint``, ``string``, ``array<string>``)."""
    how = next((h for h, names in FORMATS.items() if statistic in names), None)
    whole = F.format_number(c.cast("long"), 0) if kind in ("double", "bigint", "int") else c.cast("string")
    grouped = F.when(c == F.floor(c), whole).otherwise(F.format_number(c, 2)) if kind == "double" else whole
    if how in ("value", "number"):
        return grouped
    if how == "days" and kind in ("double", "bigint", "int"):
        return F.concat(whole, F.lit(" days"))
    if how == "percent":
        return F.concat(X.fixed(c * 100, 1), F.lit("%"))
    if how in ("two", "one", "words") and kind == "double":
        return F.concat(X.fixed(c, 2 if how == "two" else 1), F.lit(" words" if how == "words" else ""))
    if how == "first" and kind.startswith("array"):
        return F.when(F.size(c) == 0, "(none)").otherwise(F.array_join(F.slice(c, 1, 5), ", "))
    return c.cast("string")


def readout(template: str, values: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """A template with its statistics filled in (by ``shown`` where their type is given); missing ones as N/A."""
    out = F.lit(template)
    for name, c in values.items():
        text = shown(name, c, kinds[name]) if kinds and name in kinds else c.cast("string")
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(text, F.lit("N/A")))
    return F.regexp_replace(out, r"\{[A-Za-z_0-9]+\}", "N/A")


def missing_statistics(template: str, known: list[str]) -> list[str]:
    """Placeholders that no statistic fills."""
    import re

    return sorted(set(re.findall(r"\{([a-z_0-9]+)\}", template)) - set(known) - {"name"})


def property_name(primitive_class: str) -> str:
    return f"has{primitive_class.removesuffix('Column')}Value"


def reused(cells: DataFrame, by: list[str], value: str, stored: list[Contract], accept: float = ACCEPT) -> DataFrame:
    """by, contract (index of the stored one), rate: of each column the stored contract that fits it best, where one fits
    enough of it; the more used and then the earlier on ties. One pass over the cells for all columns and contracts."""
    rates = success_rates(cells, by, value, stored).where(F.col("rate") >= accept)
    hits = F.element_at(F.array(*[F.lit(c.hits) for c in stored]), F.col("contract") + 1)
    order = Window.partitionBy(*by).orderBy(F.desc("rate"), hits.desc(), "contract")
    return rates.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*by, "contract", "rate")


def improved(cells: DataFrame, value: str, pos: str, propose: Callable[[list[str]], list[Contract]], tries: int = 3, accept: float = ACCEPT) -> tuple[Contract | None, float]:
    """The best contract of a column after at most so many proposals: each is given values that the last best one doesn't fit
    (the first ones of the column at the start). The best so far is kept; it stops once one fits enough."""
    best, rate = None, 0.0
    feedback = [r[0] for r in cells.where(~X.blank(F.col(value))).orderBy(pos, value).limit(15).select(value).collect()]
    for _ in range(tries):
        candidates = propose(feedback)
        if not candidates:
            break
        got = {r["contract"]: r["rate"] for r in success_rates(cells, [], value, candidates).collect()}
        at = max(got, key=lambda j: (got[j], -j), default=None)
        if at is not None and got[at] > rate:
            best, rate = candidates[at], got[at]
        if rate >= accept or best is None:
            break
        feedback = [r["value"] for r in error_samples(cells, value, pos, best, 15).collect()]
    return (best, rate) if best is not None and rate >= accept else (None, rate)
