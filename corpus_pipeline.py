"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of documents. Null or repeated rows, empty texts and an empty
table pass through every stage as its operator defines; see the modules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontam, langid, pieces, scan, simhash, substring

#: Texts whose best language has a lower mean posterior are rejected, as those without a letter are.
LEAST_SCORE = 0.35
#: Repeated ids that are broadcast; more of them are joined by a shuffle.
BROADCAST = 1_000_000


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _as_before(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns that an operator carried along, in their order, with the text (a null one comes back empty)."""
    return rows.select(*[new.get(c, F.col("t") if c == "text" else F.col("more")[c]).alias(c) for c in names])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts without a letter and those that no language explains."""
    rows = langid.predicted(docs, langid.fitted(docs), more=[docs[c] for c in _others(docs)])
    return _as_before(rows.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over five words: of each component of texts alike by 0.8 or more (as wide fingerprints tell) the
    document with the smallest id stays (one of equal rows). Null or repeated ids with different texts are documents
    of their own; all empty texts are alike."""
    kept = simhash.keepers(docs)
    names = [f"_{n}" for n in simhash.identity()]
    rows = docs.select("*", *[c.alias(f"_{n}") for n, c in simhash.identity().items()])
    same = [rows[n] == kept[n[1:]] for n in names]
    return rows.join(kept, same, "left_semi").dropDuplicates(names).drop(*names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated windows of words go; texts of which nothing is left go too. Rows whose id
    is null or repeated go by a hash of id and text (also in the order of occurrences): substring joins by id."""
    often = scan.cut(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_i"), F.lit(True).alias("_often")))
    often = F.broadcast(often) if often.count() <= BROADCAST else often
    mixed = F.xxhash64(F.coalesce("doc_id", F.lit(scan.NO_KEY)), F.coalesce("text", F.lit("")))
    keyed = docs.join(often, docs["doc_id"].eqNullSafe(often["_i"]), "left").withColumn("_id", F.when(F.col("_often"), mixed).otherwise(F.col("doc_id")))
    rows = substring.remove_repeats(keyed, "_id", more=_others(docs))
    less = F.col("n_removed") > 0
    text = F.when(less, F.col("kept_text")).otherwise(F.col("t"))
    chars = F.when(less, F.length("kept_text").cast("long")).otherwise(F.col("more")["n_chars"])
    return _as_before(rows.where(~less | (F.col("n_removed") < F.col("n_words"))), docs.columns, text=text, n_chars=chars)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with any benchmark window go."""
    rows = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), more=_others(docs))
    return _as_before(rows.where("n_hit = 0"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: piece numbers of every text, decoded again to see that nothing is lost."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = pieces.encoded(docs, more=[docs[c] for c in rest])
    back = pieces.decoded(rows.select("k", "ids", F.xxhash64("t").alias("h"), "more"))
    return back.select(scan.unkeyed().alias("doc_id"), *[F.col("more")[c].alias(c) for c in rest], "ids", F.size("ids").cast("long").alias("n_pieces"), (F.xxhash64("decoded") == F.col("h")).alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Forward-backward, XXH64 and piece merging have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again as the next one's
    input, which is removed once the next one is written. What the last one wrote stays."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scan.shared_dir(rows)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        if before is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return rows
