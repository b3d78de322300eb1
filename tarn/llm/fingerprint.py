"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the sorted array of the k smallest different 64-bit hashes of a
text's word shingles (lower case, five words; a text of fewer words, but not
none, is one shingle). Sketches of parts merge into the sketch of the whole
(``merged``), which is also how a text beyond ``PART`` characters is taken, part
after part within its row. From sketches come estimates of resemblance,
containment and the number of different shingles; all are exact while the sets
have no more than k shingles.

Defined cases: a null text counts as empty; no words make an empty sketch, alike
to another empty one (1.0) and to no other (0.0); null ids sort last in
descending order and come back null; equal ids follow each other in any order of
equal rows; other columns are ignored; an empty table gives no rows; a table of
one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import scan

K, SHINGLE, PART = 128, 5, 1_000_000
#: Documents of a bucket of neighbours, and buckets at most.
NEIGHBOURS, BUCKETS = 256, 1 << 16


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return bottom(F.concat(a, b), k)


def _whole_shingles(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(_empty())


def _any_shingles(w: Column, size: int) -> Column:
    return F.when((F.size(w) > 0) & (F.size(w) < size), F.array(F.xxhash64(w))).otherwise(_whole_shingles(w, size))


def _part(text: Column, i: Column, part: int, size: int) -> Column:
    """The words that begin in the i-th part and the size - 1 words behind them. A few more shingles of the next part may
    come with them; as the sketch is of a set, they don't matter."""
    tail = F.regexp_extract(F.substr(text, (i + 1) * part + 1), rf"^\S*(?:\s+\S+){{0,{size - 1}}}", 0)
    both = F.concat(F.substr(text, i * part + 1, F.lit(part)), tail)
    cut = (i > 0) & F.substr(text, i * part, F.lit(1)).rlike(r"^\S")
    return F.when(cut, F.regexp_replace(both, r"^\S+", "")).otherwise(both)


def sketch(text: Column, k: int = K, size: int = SHINGLE, part: int = PART) -> Column:
    """The bottom-k sketch of a text that is not null: array<bigint>."""
    whole = F.transform(F.array(words(text)), lambda w: bottom(_any_shingles(w, size), k))[0]
    count = F.ceil(F.length(text) / part).cast("int")
    pieces = F.aggregate(F.sequence(F.lit(0), count - 1), _empty(), lambda acc, i: merged(acc, F.transform(F.array(words(_part(text, i, part, size))), lambda w: _whole_shingles(w, size))[0], k))
    return F.when(F.length(text) <= part, whole).otherwise(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, p).otherwise(whole))[0])


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: of the k smallest of the union, the share that both have."""
    return F.transform(
        F.array(F.struct(a.alias("a"), b.alias("b"), F.slice(F.sort_array(F.array_union(a, b)), 1, k).alias("u"))),
        lambda s: F.when(F.size(s["u"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s["u"], F.array_intersect(s["a"], s["b"]))) / F.size(s["u"])),
    )[0]


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles: (k - 1) over the share of the hash range below the k-th."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, from the resemblance and both counts; 0 to 1."""
    r = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (distinct(a, k) + distinct(b, k)) / distinct(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as a string: its hashes, 8 bytes each, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _bounds(ids: DataFrame, buckets: int) -> list[int]:
    """At most buckets - 1 values that cut the ids into ranges of about equal counts."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    got = ids.agg(F.percentile_approx("k", shares, min(1_000_000, 20 * buckets)).alias("b")).first()["b"]
    return sorted(set(got or []))


def _bucket(k: Column, bounds: list[int]) -> Column:
    """How many bounds are at most k: first among every m-th, then among the m behind it."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    every = F.lit(bounds)
    some = F.lit(bounds[m - 1 :: m])
    coarse = F.size(F.filter(some, lambda b: b <= k)) if len(bounds) >= m else F.lit(0)
    return F.transform(F.array(coarse), lambda c: c * m + F.size(F.filter(F.slice(every, c * m + 1, m), lambda b: b <= k)))[0]


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, t, nxt: each document with the text of the next in descending key (after the last: of the first), and the
    columns bucket and kind by which the rows are dealt and ordered. Rows of kind 1 are copies that stand behind the
    last of a bucket; drop them. Texts are shuffled once; the buckets are ranges of keys."""
    plain = scan.keyed(docs, key, text)
    ids = plain.select("k")
    total = ids.count()
    bounds = _bounds(ids, max(1, min(BUCKETS, -(-total // NEIGHBOURS))))
    tops = sorted((r["b"], r["m"]) for r in ids.groupBy(_bucket(F.col("k"), bounds).alias("b")).agg(F.max("k").alias("m")).collect())
    behind = {m: tops[i + 1 if i + 1 < len(tops) else 0][0] for i, (_, m) in enumerate(tops)}  # the largest of a bucket follows the bucket above
    own = plain.select(_bucket(F.col("k"), bounds).alias("bucket"), F.lit(0).alias("kind"), "k", "t")
    if not behind:
        return own.withColumn("nxt", F.lit(""))
    heads = docs.sparkSession.createDataFrame(sorted((m, b) for m, b in behind.items()), "k long, bucket int")
    # keys that recur give a copy each; one is kept
    copies = plain.join(F.broadcast(heads), "k").groupBy("bucket", "k").agg(F.max("t").alias("t")).select("bucket", F.lit(1).alias("kind"), "k", "t")
    order = Window.partitionBy("bucket").orderBy("kind", F.desc("k"), F.desc("t"))
    return own.unionByName(copies).withColumn("nxt", F.lead("t").over(order))


def op2(spark, sf_dir: str) -> DataFrame:
    rows = beside_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - third), F.substr(F.coalesce("nxt", F.lit("")), F.lit(1), third))
    rows = rows.select("bucket", "kind", "k", "t", n.cast("long").alias("n_chars"), F.when(F.col("kind") == 0, edited).otherwise("").alias("e"))
    rows = rows.select("bucket", "kind", "k", "t", "n_chars", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("t")).alias("a"), sketch(F.col("e")).alias("b"))
    order = Window.partitionBy("bucket").orderBy("kind", F.desc("k"), F.desc("t"))
    rows = rows.withColumn("c", F.lead("a").over(order)).where("kind = 0")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select(
        scan.unkeyed().alias("doc_id"), "n_chars", "edited_sha256", text_of(a).alias("fingerprint"), text_of(b).alias("edited_fingerprint"), resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
        distinct(a).alias("n_shingles"), containment(a, b).alias("contained_in_edited"),
    )
