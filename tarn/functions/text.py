"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the BM25 index.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

#: Two or more letters, digits or underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased words without stop words, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    stop = STOP_WORDS if stop is None else stop
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def strip_markers(text: Column) -> Column:
    """Without [Type] or [A > B] markers and the space behind them."""
    return F.regexp_replace(text, r"\[[^\]]+\]\s*", "")


def placeholder_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[^\]]+\]", "[Type]")


def only_markers(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), " ")


def camel_words(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def class_tokens(text: Column) -> Column:
    """Lower-cased words of the class names in [A > B] chains."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda m: F.split(m, r"\s*>\s*")))
    return F.array_distinct(F.filter(F.flatten(F.transform(names, lambda n: F.split(F.lower(camel_words(n)), r"\s+"))), lambda w: w != ""))


def drop_header_suffix(text: Column) -> Column:
    """``name:7:`` becomes ``name:``."""
    return F.regexp_replace(text, r"(\w+):(\d+):", "$1:")


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


# Hints by the range of a character.
SCRIPTS = [
    ("th", r"\x{0E00}-\x{0E7F}"),
    ("ru", r"\x{0400}-\x{04FF}"),
    ("zh", r"\x{4E00}-\x{9FFF}"),
    ("extended_latin", r"\x{0100}-\x{017F}"),
]


def language_hint(text: Column) -> Column:
    """The hint of the first character in a listed range; "non_ascii" if there are only others beyond ASCII, "en" if there
    are none (or no text)."""
    first = F.regexp_extract(text, "([" + "".join(r for _, r in SCRIPTS) + "])", 1)
    out = F.when(has_non_ascii(text), F.lit("non_ascii")).otherwise(F.lit("en"))
    for name, r in reversed(SCRIPTS):
        out = F.when(first.rlike(f"[{r}]"), F.lit(name)).otherwise(out)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fixed(x: Column, digits: int) -> Column:
    """A double with one or two digits behind the point, rounded by its binary value, exact halves to the even digit (as C
    and Python print it). Twice the scaled value is compared with an odd number: the products with powers of two are
    exact, and the errors of their sums are kept."""
    scale = 10**digits

    def twice(a: Column) -> Column:
        if digits == 1:
            return F.struct((16 * a + 4 * a).alias("s"), (4 * a - ((16 * a + 4 * a) - 16 * a)).alias("e"))
        big = 128 * a + 64 * a
        return F.struct((big + 8 * a).alias("s"), ((64 * a - (big - 128 * a)) + (8 * a - ((big + 8 * a) - big))).alias("e"))

    def rounded(a: Column) -> Column:
        k = F.floor(a * scale).cast("long")
        return let(F.struct(k.alias("k"), twice(a).alias("t")), lambda v: let(F.struct(v["k"].alias("k"), ((v["t"]["s"] - (2 * v["k"] + 1)) + v["t"]["e"]).alias("d")), lambda w: F.when((w["d"] > 0) | (w["d"] == 0) & (w["k"] % 2 == 1), w["k"] + 1).otherwise(w["k"])))

    text = lambda k: F.concat(F.floor(k / scale).cast("string"), F.lit("."), F.lpad((k % scale).cast("string"), digits, "0"))
    return let(x.cast("double"), lambda v: F.concat(F.when(v < 0, "-").otherwise(""), let(let(F.abs(v), rounded), text)))


def short_number(x: Column) -> Column:
    """1234567 as 1.2M, 1500 as 1.5K, 2.5 as 2.50, 3 as 3, null as a question mark."""
    a = F.abs(x)
    scale = F.when(a >= 1e9, F.lit(1e9)).when(a >= 1e6, F.lit(1e6)).otherwise(F.lit(1e3))
    mark = F.when(a >= 1e9, "B").when(a >= 1e6, "M").otherwise("K")
    return F.when(x.isNull(), "?").when(a >= 1e3, F.concat(fixed(x / scale, 1), mark)).when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(fixed(x, 2))


def truncated(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))).otherwise(text)


def file_identity(name: Column) -> Column:
    """Table id and title from a file name of one of four patterns."""
    base = F.regexp_replace(name, r"\.csv$", "")
    both = F.substring_index(base, "_SEP_", -1)
    has, mark = F.instr(base, "_SEP_") > 0, F.instr(base, "-#-") > 0
    dashed = F.regexp_replace(both, "-#-", " - ")
    head = F.regexp_replace(F.substring_index(base, "_SEP_", 1), "_", " ")
    return (
        F.when(has & mark, F.struct(both.alias("table_id"), dashed.alias("title")))
        .when(mark, F.struct(base.alias("table_id"), F.regexp_replace(base, "-#-", " - ").alias("title")))
        .when(has, F.struct(both.alias("table_id"), head.alias("title")))
        .otherwise(F.struct(base.alias("table_id"), F.regexp_replace(base, "_", " ").alias("title")))
    )


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-]", "_")


def short_md5(n: int, *parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("::", *parts)), 1, n)


def netloc(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("AUTHORITY"))


def strip_prefix(name: Column) -> Column:
    """A class name without its ``upo:`` or ``ont:`` prefix."""
    return F.regexp_replace(name, "^(?:upo|ont):", "")
