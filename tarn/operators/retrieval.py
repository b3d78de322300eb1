"""Text and vector retrieval: BM25, exact vector search, rank and score fusion.

Everything takes all queries of a workload in one plan. Rankings are total:
score descending, then id ascending. BM25 joins on terms; a term that stands in
a third of the documents makes long posting lists, which AQE splits, and partial
sums by (query, document) happen before the shuffle. Vectors are scored by
blocked matrix products; only each block's best k leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarn.functions import stems
from tarn.functions import text as X
from tarn.sources import storage

K1, B, RRF_K, OVERFETCH = 1.5, 0.75, 60, 2
#: Query vectors held by a task at once.
QUERY_BLOCK = 4096


# -- BM25 ------------------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """doc_id, term, tf, dl (tokens of the document)."""
    words = docs.select(F.col(key).alias("doc_id"), X.tokens(F.col(text), stop).alias("words"))
    return words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text: str, stop: list[str] | None = None) -> DataFrame:
    """One row: n documents, avgdl."""
    return docs.select(F.size(X.tokens(F.col(text), stop)).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def weights_for(docs: DataFrame, key: str, text: str, terms: DataFrame, stop: list[str] | None = None, variant: str = "index") -> DataFrame:
    """doc_id, term, tf, idf, tf_part, weight of the documents' terms that are in ``terms``. ``index``: tf / (tf + norm);
    ``terms``: tf (k1 + 1) / (tf + norm).

    Documents are tokenised once: other terms go before the shuffle, each document keeps one row without a term, and
    postings, document frequencies and corpus statistics all read the same shuffle. (The test for that row is on an
    aggregate, as one on the key would be pushed below the shuffle and give each reader a scan of its own.)"""
    wanted = terms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    words = docs.select(F.col(key).alias("doc_id"), X.tokens(F.col(text), stop).alias("words"))
    rows = words.select("doc_id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    posts = rows.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"), F.max(F.col("term") == "").alias("whole"))
    stats = posts.where("whole").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    posts = posts.where("not whole")
    scaled = posts.join(term_stats(posts), "term").join(F.broadcast(stats))  # stats is one row
    norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("avgdl"))
    tf = F.col("tf") / (F.col("tf") + norm) if variant == "index" else F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return scaled.select("doc_id", "term", "tf", bm25_idf(F.col("n"), F.col("df")).alias("idf"), tf.alias("tf_part")).withColumn("weight", F.col("idf") * F.col("tf_part"))


def build_index(docs: DataFrame, key: str, text: str, folder: str, stop: list[str] | None = None, stemmer: str | None = None) -> None:
    """Writes the index of a corpus: postings (term, doc_id, tf, dl, idf, weight) and one row of statistics. Postings are
    dealt by document, so that a frequent term fills no file, and sorted by term in each file, so that a search reads the
    row groups of its terms. The texts are read once; counts are written before they are weighted."""
    spark = docs.sparkSession
    words = docs.select(F.col(key).alias("doc_id"), X.tokens(F.col(text), stop).alias("words"))
    rows = words.select("doc_id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).write.mode("overwrite").parquet(f"{folder}/counts")
    posts = spark.read.parquet(f"{folder}/counts")
    if stemmer:  # each different term once
        roots = stems.stemmed(posts.select("term").distinct().withColumn("root", F.col("term")), "root", stemmer)
        posts = posts.join(roots, "term").groupBy("doc_id", F.col("root").alias("term")).agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    stats = posts.where("term = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    posts = posts.where("term <> ''")
    norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("avgdl"))
    idf = bm25_idf(F.col("n"), F.col("df"))
    weighted = posts.join(term_stats(posts), "term").join(F.broadcast(stats)).select("term", "doc_id", "tf", "dl", idf.alias("idf"), (idf * F.col("tf") / (F.col("tf") + norm)).alias("weight"))  # stats is one row
    weighted.repartition(F.col("doc_id")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    stats.withColumn("stemmer", F.lit(stemmer)).write.mode("overwrite").parquet(f"{folder}/stats")
    counts = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts")
    counts.getFileSystem(spark._jsc.hadoopConfiguration()).delete(counts, True)


def index_scores(spark: SparkSession, folder: str, queries: DataFrame, query_key: str, query_text: str, stop: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, score of every pair that shares a term, from a stored index alone."""
    terms = query_terms(queries, query_key, query_text, stop)
    stemmer = spark.read.parquet(f"{folder}/stats").first()["stemmer"]
    if stemmer:
        terms = stems.stemmed(terms, "term", stemmer).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    posts = spark.read.parquet(f"{folder}/postings").select("term", "doc_id", "weight")
    return posts.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


def index_pair_scores(spark: SparkSession, folder: str, pairs: DataFrame, queries: DataFrame, query_key: str, query_text: str, stop: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, score of stated pairs that share a term."""
    terms = query_terms(queries, query_key, query_text, stop).join(pairs.select("query_id", "doc_id").distinct(), "query_id")
    posts = spark.read.parquet(f"{folder}/postings").select("term", "doc_id", "weight")
    return terms.join(posts, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


#: Cells of the matrix of documents and queries, and pairs of postings and queries, that a task holds at once.
CELLS, PAIRS = 1 << 22, 1 << 21


def _best(rows: np.ndarray, terms: np.ndarray, weight: np.ndarray, begin: np.ndarray, query: np.ndarray, often: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (from 0), query and score of the best k of each query, and those tied with the k-th, over postings (document,
    term, weight); a term's queries stand from begin[term] to begin[term + 1]."""
    docs = int(rows[-1]) + 1 if len(rows) else 0
    score = np.zeros(docs * queries)
    size = begin[terms + 1] - begin[terms]
    upto = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        n = size[at:to]
        place = np.arange(n.sum()) + np.repeat(begin[terms[at:to]] - (upto[at:to] - upto[at]), n)
        score += np.bincount(np.repeat(rows[at:to], n) * queries + query[place], np.repeat(weight[at:to], n) * often[place], docs * queries)
        at = to
    score = score.reshape(docs, queries)
    key = np.round(score, 9)  # sums in any order tie alike
    least = np.partition(key, docs - k, axis=0)[docs - k] if docs > k else np.zeros(queries)
    d, q = np.nonzero((key >= least) & (score > 0))
    return d, q, score[d, q]


def index_search(spark: SparkSession, folder: str, queries: DataFrame, query_key: str, query_text: str, k: int | None, keep_all: bool = False, stop: list[str] | None = None) -> DataFrame:
    """The best k of each query from a stored index; with ``keep_all`` or without k every scored pair. The queries go
    through the driver a block at a time. Postings of a block's terms are dealt by document; a task adds up its documents'
    scores as arrays and passes on the best k of each query, so no pair of query and document is shuffled."""
    if keep_all or k is None:
        scores = index_scores(spark, folder, queries, query_key, query_text, stop)
        return ranked(scores if keep_all else scores.where("score > 0"), k)
    terms = query_terms(queries, query_key, query_text, stop)
    stemmer = spark.read.parquet(f"{folder}/stats").first()["stemmer"]
    if stemmer:
        terms = stems.stemmed(terms, "term", stemmer).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    posts = spark.read.parquet(f"{folder}/postings").select("term", "doc_id", "weight")
    kinds = terms.schema["query_id"].dataType.simpleString(), posts.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    id_type = to_arrow_type(terms.schema["query_id"].dataType)

    def search(ids: list, begin: np.ndarray, query: np.ndarray, often: np.ndarray):
        most = max(1, CELLS // len(ids))

        def some(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            names = t.column("doc_id").combine_chunks().dictionary_encode()
            rows, term, weight = names.indices.to_numpy(), t.column("t").to_numpy(), t.column("weight").to_numpy()
            for at in range(0, len(names.dictionary), most):  # rows are sorted by document
                i, j = np.searchsorted(rows, [at, at + most])
                d, q, score = _best(rows[i:j] - at, term[i:j], weight[i:j], begin, query, often, len(ids), k)
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q], id_type), names.dictionary.take(pa.array(d + at)), pa.array(score)], ["query_id", "doc_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                last = batch.column("doc_id")[batch.num_rows - 1]
                cut = pc.index(batch.column("doc_id"), last).as_py()  # the last document may go on
                if sum(b.num_rows for b in held) + cut > PAIRS // 2 and (cut or held and held[-1].column("doc_id")[held[-1].num_rows - 1] != last):
                    yield from some([*held, batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                else:
                    held.append(batch)
            if held:
                yield from some(held)

        return run

    out, left = None, terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "qtf")).alias("terms")).toLocalIterator()
    block = list(islice(left, QUERY_BLOCK))
    while block:
        rows = sorted((t["term"], q, t["qtf"]) for q, r in enumerate(block) for t in r["terms"])
        different = sorted({t for t, _, _ in rows})
        number = {t: i for i, t in enumerate(different)}
        begin = np.searchsorted(np.array([number[t] for t, _, _ in rows]), np.arange(len(different) + 1))
        known = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": different, "t": np.arange(len(different))}), "term string, t long"))  # the terms of one block of queries
        mine = posts.join(known, "term").select("doc_id", "t", "weight").repartition(F.col("doc_id")).sortWithinPartitions("doc_id")
        part = mine.mapInArrow(search([r["query_id"] for r in block], begin, np.array([q for _, q, _ in rows]), np.array([n for _, _, n in rows], np.float64)), schema)
        block = list(islice(left, QUERY_BLOCK)) if len(block) == QUERY_BLOCK else []
        part = storage.checkpointed(part) if block or out is not None else part
        out = part if out is None else out.unionByName(part)
    return ranked(spark.createDataFrame([], schema) if out is None else out, k)


def query_terms(queries: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select(F.col(key).alias("query_id"), F.explode(X.tokens(F.col(text), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_key: str, doc_text: str, query_key: str, query_text: str, stop: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, score of every pair that shares a term."""
    terms = query_terms(queries, query_key, query_text, stop)
    weights = weights_for(docs, doc_key, doc_text, terms, stop)
    return weights.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


def ranked(scores: DataFrame, k: int | None = None, digits: int | None = 9, by: str = "score") -> DataFrame:
    """With rank: by score (rounded, so that sums in any order tie alike), then doc_id."""
    s = F.round(F.col(by), digits) if digits is not None else F.col(by)
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(s.desc(), F.col("doc_id"))))
    return out.where(F.col("rank") <= k) if k else out


def bm25_search(docs: DataFrame, queries: DataFrame, doc_key: str, doc_text: str, query_key: str, query_text: str, k: int, keep_all: bool = False, stop: list[str] | None = None) -> DataFrame:
    scores = bm25_scores(docs, queries, doc_key, doc_text, query_key, query_text, stop)
    return ranked(scores if keep_all else scores.where("score > 0"), k)


def bm25_terms(docs: DataFrame, queries: DataFrame, doc_key: str, doc_text: str, query_key: str, query_text: str, classes: Column | None = None) -> DataFrame:
    """Score of each (query, document, term), with whether the term is one of a class name."""
    terms = query_terms(queries, query_key, query_text)
    weights = weights_for(docs, doc_key, doc_text, terms, variant="terms")
    out = weights.join(terms, "term").select("query_id", "doc_id", "term", "tf", "qtf", "idf", "tf_part", (F.col("weight") * F.col("qtf")).alias("score"))
    return out.withColumn("is_class", classes if classes is not None else F.lit(False))


def contributions(terms: DataFrame) -> DataFrame:
    """By (query, document): score of class terms, of others, and the class terms' share."""
    own = F.sum(F.when(F.col("is_class"), F.col("score")).otherwise(0.0))
    out = terms.groupBy("query_id", "doc_id").agg(own.alias("class_score"), F.sum("score").alias("total"))
    return out.withColumn("other_score", F.col("total") - F.col("class_score")).withColumn("class_ratio", F.when(F.col("total") > 0, F.col("class_score") / F.col("total")).otherwise(0.0))


def ratio_summary(c: DataFrame, column: str = "class_ratio") -> DataFrame:
    """Mean, median, extremes and population deviation."""
    x = F.col(column)
    return c.agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"))


# -- vectors ---------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column, eps: float = 1e-8) -> Column:
    n = F.sqrt(dot(v, v)) + eps
    return F.transform(v, lambda x: x.cast("double") / n)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def vector_search(items: DataFrame, queries: DataFrame, item_key: str, item_vec: str, query_key: str, query_vec: str, k: int, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score, rank: exact inner products, in blocks of queries. The driver holds one block at a time;
    each task returns its best k of each query, and with several blocks these are written before the next begins."""
    wanted = queries.select(F.col(query_key).alias("q"), F.col(query_vec).alias("v")).where("v is not null")
    rows = items.select(F.col(item_key).alias("i"), F.col(item_vec).alias("v")).where("v is not null")
    kinds = wanted.schema["q"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"
    id_type = to_arrow_type(wanted.schema["q"].dataType)

    def search(ids: list, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                score = np.round(matrix @ _matrix(batch, "v").T, digits)
                names = np.array(batch.column("i").to_pylist())
                order = np.lexsort((np.broadcast_to(names, score.shape), -score))[:, :k]
                q = np.repeat(np.arange(len(ids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], id_type), batch.column("i").take(pa.array(order.ravel())), pa.array(np.take_along_axis(score, order, 1).ravel())], ["query_id", "doc_id", "score"])

        return run

    out, left = None, wanted.toLocalIterator()
    block = list(islice(left, QUERY_BLOCK))
    while block:
        part = rows.mapInArrow(search([r["q"] for r in block], np.array([list(r["v"]) for r in block], np.float64)), schema)
        block = list(islice(left, QUERY_BLOCK)) if len(block) == QUERY_BLOCK else []
        part = storage.checkpointed(ranked(part, k, None).drop("rank")) if block or out is not None else part
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.sparkSession.createDataFrame([], schema)
    return ranked(out, k, None)


def pair_scores(pairs: DataFrame, items: DataFrame, queries: DataFrame, item_key: str, item_vec: str, query_key: str, query_vec: str, digits: int = 9) -> DataFrame:
    """query_id, doc_id, score (inner product) of stated pairs, by joins."""
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).alias("_q"))
    d = items.select(F.col(item_key).alias("doc_id"), F.col(item_vec).alias("_d"))
    return pairs.select("query_id", "doc_id").distinct().join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", F.round(dot(F.col("_q"), F.col("_d")), digits).alias("score"))


def cosine_search(items: DataFrame, queries: DataFrame, overrides: DataFrame, item_key: str, item_vec: str, query_key: str, query_vec: str, k: int) -> DataFrame:
    """Cosine search where a document's vector may be replaced (overrides: item_key, vector)."""
    own = items.select(F.col(item_key).alias("i"), F.col(item_vec).alias("v")).join(overrides.select(F.col(item_key).alias("i"), F.col(item_vec).alias("o")), "i", "left")
    return vector_search(own.select("i", normalised(F.coalesce("o", "v")).alias("v")), queries.select(F.col(query_key).alias("q"), normalised(F.col(query_vec)).alias("v")), "i", "v", "q", "v", k)


# -- fusion ----------------------------------------------------------------------------------------------------------


def rrf(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.5, 0.5), k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, doc_id, rank); a full outer join."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("r1"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("r2"))
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", "r1", "r2", (part("r1", weights[0]) + part("r2", weights[1])).alias("score"))


def min_max(x: Column, over: Window) -> Column:
    """To 0..1 within a query; equal values become 1."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))


def score_fusion(first: DataFrame, second: DataFrame, all_first: DataFrame, all_second: DataFrame, weights: tuple[float, float] = (0.5, 0.5), scale: tuple[bool, bool] = (False, True)) -> DataFrame:
    """Weighted sum of two scores over the union of both candidate lists; scores that a list lacks are taken from the
    whole score tables (0 if there is none)."""
    names = ["query_id", "doc_id"]
    candidates = first.select(*names).union(second.select(*names)).distinct()
    both = candidates.join(all_first.select(*names, F.col("score").alias("s1")), names, "left").join(all_second.select(*names, F.col("score").alias("s2")), names, "left")
    both = both.fillna(0.0, ["s1", "s2"])
    w = Window.partitionBy("query_id")
    a = min_max(F.col("s1"), w) if scale[0] else F.col("s1")
    b = min_max(F.col("s2"), w) if scale[1] else F.col("s2")
    return both.select(*names, "s1", "s2", (weights[0] * a + weights[1] * b).alias("score"))


def unified_search(mode: str, k: int, text: DataFrame | None = None, vector: DataFrame | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """bm25, vector, hybrid (RRF) or hybrid-sum over score tables of all pairs; each path over-fetches 2k. With only one
    path there is nothing to fuse and it is returned."""
    if mode == "bm25" or vector is None:
        return ranked(text, k).select("query_id", "doc_id", "score", "rank")
    if mode == "vector" or text is None:
        return ranked(vector, k).select("query_id", "doc_id", "score", "rank")
    a, b = ranked(vector, OVERFETCH * k), ranked(text, OVERFETCH * k)
    fused = rrf(a, b, weights) if mode == "hybrid" else score_fusion(a, b, vector, text, weights)
    return ranked(fused.select("query_id", "doc_id", "score"), k)


def hard_negatives(results: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """The best n of each query that are no answers of it; results should be over-fetched by the answers' number."""
    wrong = results.join(truth.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return wrong.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("n") <= n)


def stable_partition(results: DataFrame, relevant: Column) -> DataFrame:
    """Relevant ones first, each part in its old order."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce(relevant, F.lit(False)).desc(), "rank", "doc_id")))


def dual_path(semantic: DataFrame, structural: DataFrame, k: int) -> DataFrame:
    """RRF of both paths (weight 1 each) with the source of each result."""
    fused = rrf(semantic, structural, (1.0, 1.0))
    source = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "hybrid").when(F.col("r1").isNotNull(), "semantic").otherwise("structural")
    return ranked(fused.withColumn("source", source), k).select("query_id", "doc_id", "score", "rank", "source")
