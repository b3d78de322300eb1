"""Queries over the driver's tables, one per operator, with the same results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import expressions, stats
from tarn.functions import text as X
from tarn.operators import contracts as C
from tarn.operators import evaluation as E
from tarn.operators import ontology as O
from tarn.operators import profile as P
from tarn.operators import retrieval as R
from tarn.operators import similarity as S
from tarn.plans import discovery as D
from tarn.plans import provider as V
from tarn.sources import lake, sinks, storage
from tarn.streaming import events as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long, so that both engines' values compare."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# -- text retrieval --------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
BM25_SQL = f"""
tok AS (SELECT doc_id, {_TOK} AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0)
"""
TRUTH_SQL = "truth AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


_INDEXES: dict[tuple[str, str, bool], str] = {}


def bm25_index(spark: SparkSession, sf: str, paired: bool = False) -> str:
    """The folder of the documents' text index (``paired``: of those that have a vector), built once a session in the
    shared folder and searched from there."""
    key = (spark.sparkContext.applicationId, sf, paired)
    if key not in _INDEXES:
        folder = f"{storage.shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
        R.build_index(paired_documents(spark, sf) if paired else table(spark, sf, "documents"), "doc_id", "text", folder)
        _INDEXES[key] = folder
    return _INDEXES[key]


def bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return R.index_search(spark, bm25_index(spark, sf), table(spark, sf, "benchmark"), "item_id", "text", k)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set against all documents."""
    return D.contained(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bm25(spark, sf, 10))


@query(f"WITH {BM25_SQL} SELECT term, doc_id, tf, dl, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS weight FROM post JOIN dfs USING (term), st")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored index has."""
    folder = f"{storage.shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    R.build_index(table(spark, sf, "documents"), "doc_id", "text", folder)
    return rounded(spark.read.parquet(f"{folder}/postings"))


@query(f"WITH {BM25_SQL}, every AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM every WHERE query_id % 100 = 0")
def bm25_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every scored document of the stated queries, whatever its score."""
    q = table(spark, sf, "benchmark").where("item_id % 100 = 0")
    return rounded(R.index_search(spark, bm25_index(spark, sf), q, "item_id", "text", None, keep_all=True))


@query(f"""WITH {BM25_SQL} SELECT query_id, doc_id, term, tf, qtf, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS tf_part, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) AS score, regexp_matches(term, 'tion') AS is_class
FROM q JOIN post USING (term) JOIN dfs USING (term), st WHERE query_id % 100 = 0""")
def bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").where("item_id % 100 = 0")
    return rounded(R.bm25_terms(table(spark, sf, "documents"), b, "doc_id", "text", "item_id", "text", F.col("term").rlike("tion")))


@query(f"""WITH {BM25_SQL}, t AS (SELECT query_id, doc_id, qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS s, regexp_matches(term, 'tion') AS c FROM q JOIN post USING (term) JOIN dfs USING (term), st),
r AS (SELECT query_id, doc_id, coalesce(sum(s) FILTER (c), 0) / sum(s) AS x FROM t GROUP BY 1, 2)
SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std FROM r""")
def bm25_contributions(spark: SparkSession, sf: str) -> DataFrame:
    terms = R.bm25_terms(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", F.col("term").rlike("tion"))
    return rounded(R.ratio_summary(R.contributions(terms)))


@query(f"""WITH {BM25_SQL}, {TRUTH_SQL}, r AS (SELECT query_id, min(rank) AS rank FROM truth LEFT JOIN (SELECT * FROM bm WHERE rank <= 100) USING (query_id, doc_id) GROUP BY 1)
SELECT count(*) AS queries, count(rank) AS found, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}' for k in E.KS)}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r""")
def bm25_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.metrics(E.best_ranks(bm25(spark, sf, 100), truth(spark, sf))))


@query(f"""WITH {BM25_SQL}, {TRUTH_SQL}, r AS (SELECT query_id, coalesce(min(rank), 101) AS rank FROM truth LEFT JOIN (SELECT * FROM bm WHERE rank <= 100) USING (query_id, doc_id) GROUP BY 1)
SELECT round(avg(1.0 / rank), 6) AS mean_reciprocal, round(median(rank), 6) AS median_rank, round(avg(rank), 6) AS mean_rank FROM r""")
def metrics_with_misses(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.metrics_with_misses(E.best_ranks(bm25(spark, sf, 100), truth(spark, sf)), 100))


@query(f"""WITH {BM25_SQL}, {TRUTH_SQL} SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS n FROM bm WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = bm.query_id AND t.doc_id = bm.doc_id)) WHERE n <= 5""")
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.hard_negatives(bm25(spark, sf, 20), truth(spark, sf), 5).select("query_id", "doc_id", "rank"))


@query(f"WITH {BM25_SQL} SELECT query_id, source, round(max(score), 6) AS score FROM bm JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY 1, 2")
def passage_max(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25(spark, sf, 50).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return rounded(E.passage_max(hits, "source"))


@query(f"WITH {BM25_SQL}, f AS (SELECT query_id, source, min(rank) AS first FROM bm JOIN documents USING (doc_id) WHERE rank <= 50 GROUP BY 1, 2) SELECT query_id, source, first, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank FROM f")
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25(spark, sf, 50).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return rounded(E.first_occurrence(hits, "source"))


@query(f"WITH {BM25_SQL}, {TRUTH_SQL} SELECT bm.query_id, round(sum(CASE WHEN t.doc_id IS NOT NULL THEN 1 ELSE 0 END) / 10.0, 6) AS precision FROM bm LEFT JOIN truth t ON t.query_id = bm.query_id AND t.doc_id = bm.doc_id WHERE rank <= 10 GROUP BY 1")
def precision_at_10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.precision_at(bm25(spark, sf, 50), truth(spark, sf), 10))


# -- vectors and fusion: vec_id stands for doc_id, vectors with an id divisible by 50 are queries ------------------------

VEC_SQL = "vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), vs AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(a, embedding::DOUBLE[]), 9) AS score FROM vq, embeddings), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"
#: Text scores of the same queries: documents stand for the queries' texts.
HYB_SQL = VEC_SQL + f""",
ht AS (SELECT doc_id, {_TOK} AS ws FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
hst AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM ht),
hp AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM ht) GROUP BY 1, 2),
hdf AS (SELECT term, count(*) AS df FROM hp GROUP BY 1),
hq AS (SELECT doc_id AS query_id, term, tf AS qtf FROM hp WHERE doc_id % 50 = 0),
ts AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hq JOIN hp USING (term) JOIN hdf USING (term), hst GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ts)"""


def vectors(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.vector_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", k)


def paired_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


def paired_queries(spark: SparkSession, sf: str) -> DataFrame:
    return paired_documents(spark, sf).where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def paired_text(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return R.index_search(spark, bm25_index(spark, sf, True), paired_queries(spark, sf), "query_id", "text", k)


def completed_text(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    """Text scores of stated pairs."""
    return R.index_pair_scores(spark, bm25_index(spark, sf, True), pairs, paired_queries(spark, sf), "query_id", "text")


@query(f"WITH {VEC_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM vr WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors(spark, sf, 10))


@query("""WITH o AS (SELECT vec_id, list_reverse(embedding)::DOUBLE[] AS e FROM embeddings WHERE label = 1), x AS (SELECT vec_id, coalesce(o.e, embedding::DOUBLE[]) AS v FROM embeddings LEFT JOIN o USING (vec_id)),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], v) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-8) / (sqrt(list_dot_product(v, v)) + 1e-8), 9) AS score FROM embeddings q, x WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def cosine_override(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    other = e.where("label = 1").select("vec_id", F.reverse("embedding").alias("embedding"))
    return rounded(R.cosine_search(e, e.where("vec_id % 100 = 0"), other, "vec_id", "embedding", "vec_id", "embedding", 5))


def _rrf_sql(w: float) -> str:
    return f"""WITH {HYB_SQL}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce({w} / (60 + a.rank), 0) + coalesce({w} / (60 + b.rank), 0) AS score FROM (SELECT * FROM vr WHERE rank <= 20) a FULL JOIN (SELECT * FROM tr WHERE rank <= 20) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10"""


@query(_rrf_sql(0.5))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.unified_search("hybrid", 10, paired_text(spark, sf, 20), vectors(spark, sf, 20)), 9)


@query(_rrf_sql(1.0))
def rrf_unweighted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = vectors(spark, sf, 20), paired_text(spark, sf, 20)
    return rounded(R.ranked(R.rrf(a, b, (1.0, 1.0)).select("query_id", "doc_id", "score"), 10), 9)


def _fusion_sql(scale_vector: bool) -> str:
    v = "CASE WHEN max(s1) OVER w = min(s1) OVER w THEN 1.0 ELSE (s1 - min(s1) OVER w) / (max(s1) OVER w - min(s1) OVER w) END" if scale_vector else "s1"
    return f"""WITH {HYB_SQL}, c AS (SELECT query_id, doc_id FROM vr WHERE rank <= 20 UNION SELECT query_id, doc_id FROM tr WHERE rank <= 20),
j AS (SELECT c.query_id, c.doc_id, coalesce(v.score, 0) AS s1, coalesce(t.score, 0) AS s2 FROM c LEFT JOIN vs v ON v.query_id = c.query_id AND v.doc_id = c.doc_id LEFT JOIN ts t ON t.query_id = c.query_id AND t.doc_id = c.doc_id),
f AS (SELECT query_id, doc_id, 0.5 * ({v}) + 0.5 * (CASE WHEN max(s2) OVER w = min(s2) OVER w THEN 1.0 ELSE (s2 - min(s2) OVER w) / (max(s2) OVER w - min(s2) OVER w) END) AS score FROM j WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def complete(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    """Vector scores of stated pairs."""
    e = table(spark, sf, "embeddings")
    return R.pair_scores(pairs, e, e, "vec_id", "embedding", "vec_id", "embedding")


def _fused(spark: SparkSession, sf: str, scale: tuple[bool, bool]) -> DataFrame:
    a, b = vectors(spark, sf, 20), paired_text(spark, sf, 20)
    pairs = storage.checkpointed(a.select("query_id", "doc_id").unionByName(b.select("query_id", "doc_id")).distinct())
    fused = R.score_fusion(a, b, complete(spark, sf, pairs), completed_text(spark, sf, pairs), scale=scale)
    return rounded(R.ranked(fused.select("query_id", "doc_id", "score"), 10))


@query(_fusion_sql(False))
def norm_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, (False, True))


@query(_fusion_sql(True))
def norm_fusion_both(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, (True, True))


@query(f"WITH {VEC_SQL} SELECT v.query_id, v.doc_id, row_number() OVER (PARTITION BY v.query_id ORDER BY (e.label = 1) DESC, v.rank, v.doc_id) AS rank FROM vr v JOIN embeddings e ON e.vec_id = v.doc_id WHERE v.rank <= 10")
def rerank_partition(spark: SparkSession, sf: str) -> DataFrame:
    hits = vectors(spark, sf, 10).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return rounded(R.stable_partition(hits, F.col("label") == 1).select("query_id", "doc_id", "rank"))


@query(f"""WITH {HYB_SQL}, a AS (SELECT query_id, min(rank) AS ra FROM vr WHERE rank <= 20 AND doc_id % 7 = 0 GROUP BY 1), b AS (SELECT query_id, min(rank) AS rb FROM tr WHERE rank <= 20 AND doc_id % 7 = 0 GROUP BY 1)
SELECT CASE WHEN ra IS NULL AND rb IS NULL THEN 'both_miss' WHEN coalesce(ra, 1073741824) < coalesce(rb, 1073741824) THEN 'first_wins' WHEN coalesce(ra, 1073741824) > coalesce(rb, 1073741824) THEN 'second_wins' ELSE 'tie' END AS outcome, count(*) AS n FROM a FULL JOIN b USING (query_id) GROUP BY 1""")
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    best = lambda r: r.where("doc_id % 7 = 0").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return rounded(E.comparison(best(vectors(spark, sf, 20)), best(paired_text(spark, sf, 20))))


# -- similarity and sampling -----------------------------------------------------------------------------------------

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round(({_COS} + 1) / 2, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def sim_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return S.pair_similarities(table(spark, sf, "embeddings"), "vec_id", "embedding", True, 6)


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round(0.25 * {_COS} + 0.75 * (CASE WHEN b.vec_id = a.vec_id + 1 THEN 1.0 ELSE 0.0 END), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def sim_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    ids = e.select(F.col("vec_id").alias("i")).distinct()
    b = ids.join(ids.select(F.expr("i - 1").alias("i")), "i", "left_semi").select("i", F.expr("i + 1").alias("j"), F.lit(1.0).alias("sim"))
    return S.pair_similarities(e, "vec_id", "embedding", digits=6, other=b, alpha=0.25)


@query("SELECT vec_id, label, pick FROM (SELECT vec_id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || ':42')) AS pick FROM embeddings) WHERE pick <= 3")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.stratified_sample(table(spark, sf, "embeddings"), "vec_id", "label", 3).select("vec_id", "label", "pick"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(v) AS m FROM x GROUP BY 1, 2),
f AS (SELECT vec_id, x.label, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN c ON c.label = x.label AND c.d = x.d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS pick FROM f)
SELECT vec_id, label::BIGINT AS label, round(distance, 6) AS distance, pick FROM r WHERE pick <= 3""")
def centroid_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.nearest_to_centroid(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 3).select("vec_id", "label", "distance", "pick"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':42') LIMIT 25")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.random_sample(table(spark, sf, "documents"), "doc_id", 25).select("doc_id")


@query()
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return S.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@query()
def stratified_dpp(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_dpp(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 40)


@query()
def spectral_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return S.spectral_items(table(spark, sf, "embeddings"), "vec_id", "embedding", 4)


@query()
def dpp_sample(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in S.dpp_items(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)], "vec_id long")


@query()
def cluster_codes(spark: SparkSession, sf: str) -> DataFrame:
    return S.cluster_levels(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, 120, 2)


# -- column statistics -----------------------------------------------------------------------------------------------

_P = "list_sort(list(v))"


def _quartile_sql(i: int) -> str:
    j = f"greatest(1, least(({i} * (len(s) + 1)) // 4, len(s) - 1))"
    d = f"({i} * (len(s) + 1) - 4 * {j})"
    return f"CASE WHEN len(s) > 1 THEN (s[{j}] * (4 - {d}) + s[{j} + 1] * {d}) / 4.0 END"


@query(f"""WITH x AS (SELECT l_returnflag AS g, l_quantity::BIGINT AS v, l_orderkey * 10 + l_linenumber AS p FROM lineitem), m AS (SELECT g, v, count(*) AS c, min(p) AS p FROM x GROUP BY 1, 2), a AS (SELECT g, count(*) AS count, min(v) AS min, max(v) AS max, sum(v)::BIGINT AS sum, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, list_sort(list(v)) AS s FROM x GROUP BY 1)
SELECT a.g, count, min, max, sum, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round({_quartile_sql(1)}, 6) AS p25, round({_quartile_sql(3)}, 6) AS p75, (SELECT v FROM m WHERE m.g = a.g ORDER BY c DESC, p, v LIMIT 1) AS mode FROM a""")
def int_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("long").alias("v0"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rounded(stats.integer_stats(x, ["g"], "v0", "pos"))


@query(f"""WITH a AS (SELECT o_orderstatus AS g, count(*) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, avg(o_totalprice) AS mean, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS std, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1)
SELECT g, count, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round({_quartile_sql(1)}, 4) AS p25, round({_quartile_sql(3)}, 4) AS p75 FROM a""")
def decimal_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.decimal_stats(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "g"), ["g"], "o_totalprice"), 4)


@query("SELECT c_mktsegment, count(*) FILTER (c_acctbal >= 0) AS count, round(min(c_acctbal) FILTER (c_acctbal >= 0), 4) AS min, round(max(c_acctbal) FILTER (c_acctbal >= 0), 4) AS max, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 4) AS mean FROM customer GROUP BY 1")
def nonneg_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.nonnegative_stats(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal"), 4)


@query("SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS min, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS max, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) // 86400000000 AS range_days FROM orders GROUP BY 1")
def datetime_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.datetime_stats(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate"))


@query("SELECT o_orderstatus, count(*) AS count, min(year(o_orderdate)) AS min, max(year(o_orderdate)) AS max, max(year(o_orderdate)) - min(year(o_orderdate)) AS range_years FROM orders GROUP BY 1")
def year_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.year_stats(table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")), ["o_orderstatus"], "y"))


@query("""WITH x AS (SELECT p_brand AS g, p_type AS v, count(*) AS c FROM part GROUP BY 1, 2), a AS (SELECT g, sum(c) AS n, count(*) AS d, sum(length(v) * c) AS l, min(length(v)) AS mn, max(length(v)) AS mx, sum(len(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> '')) * c) AS w, sum(c * log2(c)) AS e, max(c) AS t FROM x GROUP BY 1)
SELECT g, n::BIGINT AS count, d AS distinct, round_even(d / n, 3) AS unique_ratio, round(l / n, 6) AS avg_length, mn AS min_length, mx AS max_length, round(w / n, 6) AS word_count_avg, round_even(log2(n) - e / n, 3) AS entropy, round_even(t / n, 3) AS dominant_ratio, d / n < 0.2 AND d <= 50 AS is_categorical FROM a""")
def string_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.string_stats(table(spark, sf, "part").withColumnRenamed("p_brand", "g"), ["g"], "p_type"))


@query("WITH c AS (SELECT p_brand, p_type AS value, count(*) AS n, min(p_partkey) AS p FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p, value) AS rank FROM c) SELECT p_brand, value, n, rank FROM r WHERE rank <= 10")
def string_top_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.top_values(table(spark, sf, "part"), ["p_brand"], "p_type", "p_partkey"))


@query("""WITH a AS (SELECT p_brand AS g, min(p_name) AS a, max(p_name) AS b, min(reverse(p_name)) AS c, max(reverse(p_name)) AS d, count(*) AS n FROM part GROUP BY 1),
x AS (SELECT g, n, a, list_max(list_transform(list_filter(generate_series(0, least(length(a), length(b))), lambda i: a[1:i] = b[1:i]), lambda i: i)) AS k, c, list_max(list_filter(generate_series(0, least(length(c), length(d))), lambda i: c[1:i] = d[1:i])) AS m FROM a)
SELECT g, CASE WHEN n = 1 THEN a WHEN k >= 2 AND trim(a[1:k]) <> '' THEN a[1:k] END AS prefix, CASE WHEN n = 1 THEN a WHEN m >= 2 AND trim(reverse(c[1:m])) <> '' THEN reverse(c[1:m]) END AS suffix FROM x""")
def prefix_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.common_affixes(table(spark, sf, "part").withColumnRenamed("p_brand", "g"), ["g"], "p_name")


@query(f"""WITH v AS (SELECT lang, doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z]{{3,}}'), lambda w: w NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'were', 'has', 'have', 'had', 'not', 'but', 'they', 'you', 'all', 'can', 'her', 'his', 'she', 'him', 'its', 'who', 'how', 'what', 'when', 'where', 'which')) AS ws FROM documents WHERE text IS NOT NULL), n AS (SELECT lang, count(*) AS n FROM v GROUP BY 1),
t AS (SELECT lang, word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT lang, doc_id, unnest(ws) AS word FROM v) GROUP BY 1, 2), s AS (SELECT t.lang, word, tf * (ln(n / (df + 1)) + 1) AS score FROM t JOIN n ON n.lang = t.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, word) AS rank FROM s) SELECT lang, word, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def tfidf_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.keywords(table(spark, sf, "documents"), ["lang"], "text"))


@query("SELECT quality::BIGINT AS quality, count(*) AS count, count(*) FILTER (toxic = 1) AS true_count, count(*) FILTER (toxic <> 1) AS false_count, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS true_ratio FROM labels GROUP BY 1")
def boolean_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.boolean_stats(table(spark, sf, "labels").withColumn("t", F.col("toxic") == 1), ["quality"], "t"))


@query(r"WITH h AS (SELECT 1 AS g, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS rank FROM h) SELECT g::BIGINT AS g, host, n, rank, (SELECT count(DISTINCT url) FROM pages) AS distinct FROM r WHERE rank <= 10")
def uri_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.uri_stats(table(spark, sf, "pages").withColumn("g", F.lit(1)), ["g"], "url"))


@query("SELECT l_linestatus, count(*) AS count, min(l_discount * 100) AS min, max(l_discount * 100) AS max, round(avg(l_discount * 100), 6) AS mean, round(median(l_discount * 100), 6) AS median FROM lineitem GROUP BY 1")
def percentage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.percentage_stats(table(spark, sf, "lineitem").withColumn("p", F.col("l_discount") * 100), ["l_linestatus"], "p"))


@query("SELECT s_nationkey::BIGINT AS s_nationkey, count(*) AS count, round(min(s_acctbal), 4) AS min, round(max(s_acctbal), 4) AS max, round(sum(s_acctbal), 4) AS sum, round(avg(s_acctbal), 4) AS mean, round(median(s_acctbal), 4) AS median, round(stddev_samp(s_acctbal), 4) AS std FROM supplier GROUP BY 1")
def currency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.currency_stats(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal"), 4)


def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    return P.cells_of(table(spark, sf, "customer"), "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], F.col("c_custkey"))


_CELLS = " UNION ALL ".join(f"SELECT c_custkey AS row_index, {i} AS column_index, {c}::VARCHAR AS value FROM customer" for i, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))


@query(f"WITH c AS ({_CELLS}) SELECT 'customer' AS table_id, column_index::BIGINT AS column_index, count(*) AS total_count, count(*) FILTER (value IS NULL OR trim(value) = '') AS null_count, count(DISTINCT value) AS unique_count, round(count(*) FILTER (value IS NULL OR trim(value) = '') / count(*), 6) AS null_ratio, round(count(DISTINCT value) / count(*), 6) AS unique_ratio FROM c GROUP BY 2")
def column_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.column_counts(customer_cells(spark, sf)))


@query(f"WITH c AS ({_CELLS}), f AS (SELECT column_index, value, min(row_index) AS p FROM c WHERE trim(value) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_index ORDER BY p, value) AS r FROM f) SELECT 'customer' AS table_id, column_index::BIGINT AS column_index, list(value[1:100] ORDER BY r) AS sample_values FROM r WHERE r <= 5 GROUP BY 2")
def column_samples(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.samples(customer_cells(spark, sf)))


# -- contracts -------------------------------------------------------------------------------------------------------

CONTRACTS = [
    C.Contract("KeyColumn", "hasKey", r'\{"k": \d+\}', "int(re.sub('[^0-9]', '', x))", "int"),
    C.Contract("KeyColumn", "hasKey", r'\{"k": \d\}', "int(re.sub('[^0-9]', '', x))", "int"),
    C.Contract("KeyColumn", "hasText", r"\{", "x.strip().upper()"),
    C.Contract("KeyColumn", "hasNumber", r"\d+", "float(x)", "float"),
]
_OK = [r"""regexp_matches(props, '^\{"k": \d+\}')""", r"""regexp_matches(props, '^\{"k": \d\}')""", r"regexp_matches(props, '^\{')", "false"]


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT event_type, {i}::BIGINT AS contract, count(*) AS tested, count(*) FILTER ({c}) AS ok FROM events WHERE trim(props) <> '' GROUP BY 1" for i, c in enumerate(_OK)) + ") SELECT event_type, contract, tested, ok, round(ok / tested, 6) AS rate FROM x")
def contract_success(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.success_rates(table(spark, sf, "events"), ["event_type"], "props", CONTRACTS))


@query(r"""SELECT event_type, count(*) FILTER (regexp_matches(props, '^\{"k": \d\}')) AS ok_count, count(*) FILTER (props IS NULL OR trim(props) = '') AS null_count, count(*) FILTER (trim(props) <> '' AND NOT regexp_matches(props, '^\{"k": \d\}')) AS error_count FROM events GROUP BY 1""")
def contract_apply(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.apply_counts(table(spark, sf, "events"), ["event_type"], "props", CONTRACTS[1]))


@query(r"""SELECT props FROM events WHERE trim(props) <> '' AND NOT regexp_matches(props, '^\{"k": \d\}') ORDER BY event_id, props LIMIT 15""")
def contract_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return C.unmatched(table(spark, sf, "events"), "props", "event_id", CONTRACTS[1])


@query("WITH r(i, pattern, rate) AS (" + " UNION ALL ".join(f"SELECT {i}, '{c.pattern}', (count(*) FILTER ({ok}))::DOUBLE / count(*) FROM events WHERE trim(props) <> ''" for i, (c, ok) in enumerate(zip(CONTRACTS, _OK, strict=True))) + "), b AS (SELECT * FROM r ORDER BY rate DESC, i LIMIT 1) SELECT CASE WHEN rate >= 0.85 THEN pattern END AS pattern, rate FROM b")
def contract_halving(spark: SparkSession, sf: str) -> DataFrame:
    best, rate = C.best_contract(table(spark, sf, "events"), "props", "event_id", CONTRACTS)
    return spark.createDataFrame([(best.pattern if best else None, float(rate))], "pattern string, rate double")


@query("WITH s(c, p, pattern, rate) AS (VALUES ('A', 'x', '^1', 0.5), ('A', 'x', '^2', 0.8), ('B', 'y', '^1', 0.9)), n(c, p, pattern, rate) AS (VALUES ('A', 'x', '^3', 0.8), ('A', 'x', '^4', 0.81), ('B', 'y', '^1', 0.95), ('C', 'z', '^1', 0.1)) SELECT c AS primitive_class, p AS data_property, pattern, rate::DOUBLE AS rate FROM n WHERE rate > coalesce((SELECT max(rate) FROM s WHERE s.c = n.c AND s.p = n.p), -1) AND NOT EXISTS (SELECT 1 FROM s WHERE s.c = n.c AND s.p = n.p AND s.pattern = n.pattern)")
def contract_gate(spark: SparkSession, sf: str) -> DataFrame:
    schema = "primitive_class string, data_property string, pattern string, rate double"
    stored = spark.createDataFrame([("A", "x", "^1", 0.5), ("A", "x", "^2", 0.8), ("B", "y", "^1", 0.9)], schema)
    new = spark.createDataFrame([("A", "x", "^3", 0.8), ("A", "x", "^4", 0.81), ("B", "y", "^1", 0.95), ("C", "z", "^1", 0.1)], schema)
    return C.gate(new, stored)


@query("WITH x AS (SELECT p_brand AS primitive_class, p_type AS data_property, p_partkey AS id, p_size AS hits, substr(md5(p_partkey::VARCHAR), 1, 12) AS contract_id, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, substr(md5(p_partkey::VARCHAR), 1, 12)) AS r FROM part) SELECT primitive_class, data_property, id, hits::BIGINT AS hits, contract_id FROM x WHERE r <= 2")
def contract_lru(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("primitive_class"), F.col("p_type").alias("data_property"), F.col("p_partkey").alias("id"), F.col("p_size").alias("hits"), X.short_md5(12, F.col("p_partkey").cast("string")).alias("contract_id"))
    return rounded(C.evict(rows, 2))


@query("SELECT p_partkey, p_brand || ' of ' || p_size::VARCHAR || ' (N/A)' AS text FROM part")
def readout(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.readout("{brand} of {size} ({missing})", {"brand": F.col("p_brand"), "size": F.col("p_size")}).alias("text"))


@query("SELECT p_partkey, upper(trim(p_name)) AS a, length(p_name) AS b, split_part(p_name, ' ', 1) AS c, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS d, p_size * 2 + 1 AS e, p_name[1:3] AS f FROM part")
def compiled_expressions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_name")
    size = F.col("p_size").cast("string")
    c = expressions.compile_expression
    return rounded(table(spark, sf, "part").select("p_partkey", c("x.strip().upper()", x).alias("a"), c("len(x)", x).alias("b"), c("x.split(' ')[0]", x).alias("c"), c("'big' if int(x) > 25 else 'small'", size).alias("d"), c("int(x) * 2 + 1", size).alias("e"), c("x[:3]", x).alias("f")))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type FROM r WHERE i % greatest(1, n // 20) = 0 AND i // greatest(1, n // 20) < 20")
def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    return C.systematic(table(spark, sf, "events"), ["event_type"], "event_id", 20).select("event_id", "event_type")


# -- ontology --------------------------------------------------------------------------------------------------------

#: A small hierarchy over the tables' columns, with two parents for one class.
CLASSES = [("Column", None), ("Quantitative", "Column"), ("Price", "Quantitative"), ("Quantity", "Quantitative"), ("Balance", "Price"), ("Temporal", "Column"), ("OrderDate", "Temporal"), ("ShipDate", "Temporal"), ("Name", "Column"), ("CustomerName", "Name"), ("PartName", "Name"), ("PriceDate", "Price"), ("PriceDate", "Temporal")]
MAPPINGS = [("customer", 0, "CustomerName"), ("customer", 1, "upo:Balance"), ("orders", 0, "Price"), ("orders", 1, "OrderDate"), ("part", 0, "PartName"), ("part", 1, "Price"), ("lineitem", 0, "Quantity"), ("lineitem", 1, "ShipDate"), ("lineitem", 2, "PriceDate"), ("supplier", 0, "Balance"), ("nation", 0, "Name"), ("events", 0, "Column")]
CONSTRAINTS = [(1, 1, "Price", None), (1, 2, "OrderDate", "1995-01-01"), (2, 1, "CustomerName", None), (3, 1, "Balance", "100"), (3, 2, "Temporal", None), (3, 3, "Unknown", None), (4, 1, "Column", None)]
PROPERTIES = [("hasValue", "Column", None, "xsd:string"), ("hasTime", "Temporal", "hasValue", "xsd:dateTime"), ("hasAmount", "Quantitative", "hasValue", "xsd:decimal"), ("hasPrice", "Price", "hasAmount", "xsd:decimal"), ("hasCurrency", "Price", None, "xsd:string"), ("hasRank", "Quantitative", "hasAmount", "xsd:integer")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


ONTO_SQL = f"""RECURSIVE cls(class, parent) AS (VALUES {_values(CLASSES)}), map0(table_id, column_index, class) AS (VALUES {_values(MAPPINGS)}), map AS (SELECT table_id, column_index, regexp_replace(class, '^(upo|ont):', '') AS class FROM map0),
con(query_id, cid, class, value) AS (VALUES {_values(CONSTRAINTS)}), prop(property, domain, parent, range) AS (VALUES {_values(PROPERTIES)}),
walk(anc, "desc", dist) AS (SELECT DISTINCT class, class, 0 FROM cls UNION ALL SELECT e.parent, w."desc", w.dist + 1 FROM walk w JOIN cls e ON e.class = w.anc WHERE e.parent IS NOT NULL),
clo AS (SELECT anc, "desc", min(dist) AS dist FROM walk GROUP BY 1, 2), dep AS (SELECT "desc" AS class, max(dist) AS depth FROM clo GROUP BY 1),
nt AS (SELECT count(DISTINCT table_id) AS n FROM map), fr AS (SELECT c.class, coalesce(f.df, 0) AS df, n, ln((n + 1) / (coalesce(f.df, 0) + 1)) AS idf FROM (SELECT DISTINCT class FROM cls) c LEFT JOIN (SELECT anc, count(DISTINCT table_id) AS df FROM map JOIN clo ON clo."desc" = map.class GROUP BY 1) f ON f.anc = c.class, nt),
sh AS (SELECT DISTINCT q.query_id, q.cid, q.value, q.class AS required, t.table_id, a.anc AS class, fr.idf, dep.depth, need.idf AS need FROM con q JOIN clo a ON a."desc" = q.class JOIN clo b ON b.anc = a.anc JOIN map t ON t.class = b."desc" JOIN fr ON fr.class = a.anc JOIN dep ON dep.class = a.anc LEFT JOIN fr need ON need.class = q.class)"""


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class string, parent string")


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "table_id string, column_index int, class string")


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSTRAINTS, "query_id long, cid long, class string, value string")


def properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROPERTIES, "property string, domain string, parent string, range string")


@query(f'WITH {ONTO_SQL} SELECT anc, "desc", dist::BIGINT AS dist FROM clo')
def hierarchy_closure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.closure(classes(spark)))


@query(f"WITH {ONTO_SQL} SELECT class, df, n, round(idf, 6) AS idf FROM fr")
def class_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.class_frequencies(classes(spark), mappings(spark)))


@query(f"""WITH {ONTO_SQL}, k AS (SELECT DISTINCT class, property FROM (SELECT "desc" AS class, property, rank() OVER (PARTITION BY "desc" ORDER BY dist) AS r FROM clo JOIN prop ON prop.domain = clo.anc) WHERE r = 1),
pw(anc, d, n) AS (SELECT property, property, 0 FROM prop UNION ALL SELECT p.parent, w.d, w.n + 1 FROM pw w JOIN prop p ON p.property = w.anc WHERE p.parent IS NOT NULL)
SELECT class, property FROM k WHERE NOT EXISTS (SELECT 1 FROM k k2 JOIN pw ON pw.d = k2.property AND pw.n > 0 WHERE k2.class = k.class AND pw.anc = k.property)""")
def nearest_property(spark: SparkSession, sf: str) -> DataFrame:
    return O.nearest_properties(classes(spark), properties(spark))


@query(f"WITH {ONTO_SQL} SELECT domain AS class, arg_min(range, property) AS range FROM prop GROUP BY 1")
def class_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return O.class_ranges(classes(spark), properties(spark))


_V3 = f"""WITH {ONTO_SQL}, one AS (SELECT query_id, cid, table_id, CASE WHEN any_value(value) IS NULL THEN arg_max(idf, (depth, idf)) ELSE max(idf) END AS s FROM sh GROUP BY 1, 2, 3),
sc3 AS (SELECT o.query_id, table_id AS doc_id, sum(s) / (SELECT count(*) FROM con WHERE con.query_id = o.query_id) AS score FROM one o GROUP BY 1, 2)"""


@query(f"{_V3} SELECT query_id, doc_id, round(score, 6) AS score FROM sc3 WHERE round(score, 12) > 0")
def scorer_plain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.score_plain(classes(spark), mappings(spark), constraints(spark)))


@query(f"""WITH {ONTO_SQL}, one AS (SELECT query_id, cid, table_id, arg_max(idf, (depth, idf)) AS idf, any_value(need) AS need FROM sh GROUP BY 1, 2, 3), w AS (SELECT query_id, cid, coalesce(fr.idf, 0) * CASE WHEN value IS NULL THEN 1.0 ELSE 1.5 END AS w FROM con LEFT JOIN fr ON fr.class = con.class), t AS (SELECT query_id, sum(w) AS total FROM w GROUP BY 1),
s AS (SELECT o.query_id, table_id AS doc_id, CASE WHEN any_value(total) > 0 THEN sum(CASE WHEN need > 0 THEN greatest(0.0, least(1.0, o.idf / need)) ELSE 0 END * w) / any_value(total) ELSE 0.0 END AS score FROM one o JOIN w ON w.query_id = o.query_id AND w.cid = o.cid JOIN t ON t.query_id = o.query_id GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score FROM s WHERE round(score, 12) > 0""")
def scorer_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.score_weighted(classes(spark), mappings(spark), constraints(spark)))


@query(f"""{_V3}, st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc3 WHERE round(score, 12) > 0), se(query_id, doc_id, rank) AS (VALUES (1, 'orders', 1), (1, 'region', 2), (2, 'nation', 1)),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN a.rank IS NOT NULL THEN 'semantic' ELSE 'structural' END AS source FROM se a FULL JOIN st b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, round(score, 9) AS score, rank, source FROM r WHERE rank <= 5""")
def dual_path(spark: SparkSession, sf: str) -> DataFrame:
    semantic = spark.createDataFrame([(1, "orders", 1), (1, "region", 2), (2, "nation", 1)], "query_id long, doc_id string, rank int")
    structural = R.ranked(O.score_plain(classes(spark), mappings(spark), constraints(spark)))
    return rounded(R.dual_path(semantic, structural, 5), 9)


@query(f"""WITH {ONTO_SQL} SELECT a.class AS wanted, b.class AS found, CASE WHEN a.class = b.class THEN 'exact' WHEN EXISTS (SELECT 1 FROM clo WHERE anc = a.class AND "desc" = b.class AND dist > 0) THEN 'subclass' WHEN EXISTS (SELECT 1 FROM clo WHERE anc = b.class AND "desc" = a.class AND dist > 0) THEN 'superclass' ELSE 'none' END AS match FROM (SELECT DISTINCT class FROM con) a, (SELECT DISTINCT class FROM map) b""")
def class_match(spark: SparkSession, sf: str) -> DataFrame:
    wanted = sorted({c[2] for c in CONSTRAINTS})
    found = sorted({m[2].removeprefix("upo:") for m in MAPPINGS})
    pairs = spark.createDataFrame([(a, b) for a in wanted for b in found], "wanted string, found string")
    return O.class_matches(classes(spark), pairs)


@query("SELECT c_nationkey::BIGINT AS class, round(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / 5.0, 6) AS coverage, count(*) FILTER (c_acctbal > 0) AS positives, coalesce(list(c_mktsegment ORDER BY c_mktsegment) FILTER (c_acctbal > 0), []) AS groups FROM (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1, 2) GROUP BY 1")
def vote_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("class"), F.col("c_mktsegment").alias("group")).agg(F.max("c_acctbal").alias("b")).withColumn("vote", (F.col("b") > 0).cast("int"))
    return rounded(O.vote_summary(votes, 5))


@query("WITH c AS (SELECT year(o_orderdate)::BIGINT AS iteration, o_orderpriority AS class, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS coverage FROM orders GROUP BY 1, 2), m AS (SELECT iteration, avg(coverage) AS mean, count(*) FILTER (coverage > 0.5) / count(*) AS covered, count(*) AS classes FROM c GROUP BY 1) SELECT iteration, round(mean, 6) AS mean, round(covered, 6) AS covered, classes, round(abs(mean - lag(mean) OVER (ORDER BY iteration)), 6) AS delta FROM m")
def coverage_delta(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("iteration"), F.col("o_orderpriority").alias("class")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("coverage"))
    return rounded(O.iteration_metrics(c))


@query(f"""WITH {ONTO_SQL}, t(class, sort, depth) AS (SELECT class, class, 0 FROM cls WHERE parent IS NULL UNION ALL SELECT e.class, t.sort || chr(1) || e.class, t.depth + 1 FROM t JOIN cls e ON e.parent = t.class) SELECT row_number() OVER (ORDER BY sort) AS n, repeat('  ', depth) || class AS line FROM t""")
def hierarchy_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(O.tree_text(classes(spark)))


@query("WITH k(c) AS (VALUES ('Quantity'), ('Price'), ('ShipDate')), n(name) AS (VALUES ('Price'), ('upo:Quantity'), ('ship_date'), ('OrderPrice')) SELECT name, CASE name WHEN 'Price' THEN 'Price' WHEN 'upo:Quantity' THEN 'Quantity' WHEN 'ship_date' THEN 'ShipDate' ELSE 'Price' END AS class FROM n")
def class_repair(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("Price",), ("upo:Quantity",), ("ship_date",), ("OrderPrice",)], "name string")
    return O.repaired(names, spark.createDataFrame([("Quantity",), ("Price",), ("ShipDate",)], "class string"))


@query("SELECT source, lang, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY source, lang)")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest(table(spark, sf, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id", "n_chars")


# -- relations: sinks, batches, reports ------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, 'old' AS state FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, upper(lang), lang, 'new' FROM documents WHERE doc_id % 10 = 0")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", "text", "lang", F.lit("old").alias("state"))
    new = old.where("doc_id % 10 = 0").select("doc_id", F.upper("lang").alias("text"), "lang", F.lit("new").alias("state"))
    return sinks.upserted(old, new, ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def next_batch(spark: SparkSession, sf: str) -> DataFrame:
    return lake.batch_of(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", 50)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS batch FROM documents")
def batch_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lake.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 128))


@query("SELECT doc_id, lang, ntile(3) OVER (PARTITION BY lang ORDER BY doc_id) AS batch FROM documents")
def even_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("batch", F.ntile(3).over(Window.partitionBy("lang").orderBy("doc_id")))
    return rounded(d.select("doc_id", "lang", "batch"))


@query("SELECT source, count(*) AS count, round(avg(n_chars), 6) AS n_chars_mean, round(stddev_samp(n_chars), 6) AS n_chars_std, min(n_chars) AS n_chars_min, max(n_chars) AS n_chars_max FROM documents GROUP BY 1")
def summary_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.grouped_summary(table(spark, sf, "documents"), ["source"], ["n_chars"]))


@query("SELECT source, round(avg(n_chars) FILTER (lang = 'de'), 6) AS de, round(avg(n_chars) FILTER (lang = 'en'), 6) AS en, round(avg(n_chars) FILTER (lang = 'es'), 6) AS es, round(avg(n_chars) FILTER (lang = 'fr'), 6) AS fr FROM documents GROUP BY 1")
def pivot_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.pivoted(table(spark, sf, "documents"), ["source"], "lang", ["de", "en", "es", "fr"], F.avg("n_chars")))


@query("SELECT role, turn, count(*) AS calls, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ROLLUP (role, turn)")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.usage_rollup(table(spark, sf, "conversations").withColumn("chars", F.length("text").cast("long")), ["role", "turn"], ["chars"]))


@query("SELECT conv_id, turn, role, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS total_chars FROM conversations")
def cumulative_usage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), F.struct("turn", "role").alias("o"))
    return rounded(E.cumulative(rows, ["conv_id"], "o", "chars").drop("o"))


@query("SELECT query_id, variant, rank FROM (VALUES (1, 'a', 1), (1, 'b', 2), (2, 'a', 3), (3, 'b', 1), (3, 'a', NULL)) t(query_id, variant, rank) WHERE query_id IN (1, 3)")
def common_queries(spark: SparkSession, sf: str) -> DataFrame:
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (3, "b", 1), (3, "a", None)], "query_id long, variant string, rank int")
    return rounded(E.common_queries(ranks, 2))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.q, b.q) AS q FROM (SELECT doc_id, quality::VARCHAR AS q FROM labels WHERE quality = 1) a FULL JOIN (SELECT doc_id, lang AS q FROM documents) b ON a.doc_id = b.doc_id")
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.col("quality").cast("string").alias("q"))
    return sinks.merged_cache(old, table(spark, sf, "documents").select("doc_id", F.col("lang").alias("q")), "doc_id", "q")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def sql_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return lake.sql(spark, "SELECT n_name, r_name FROM table WHERE r_name <> 'ASIA'", joined)


# -- text functions and serialisation --------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace('[A > ' || source || '] ' || lang || ': x', '\[[^\]]+\]\s*', '', 'g') AS stripped, regexp_replace('[A] ' || lang, '\[[^\]]+\]', '[Type]', 'g') AS placed FROM documents")
def class_marker_strip(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("[A > "), F.col("source"), F.lit("] "), F.col("lang"), F.lit(": x"))
    return table(spark, sf, "documents").select("doc_id", X.strip_markers(marked).alias("stripped"), X.placeholder_markers(F.concat(F.lit("[A] "), F.col("lang"))).alias("placed"))


_HINT = r"regexp_extract(text, '[\x{0E00}-\x{0E7F}\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{0100}-\x{017F}]')"


@query(rf"""WITH x AS (SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'aé' || text || 'ไทย Ж' WHEN 2 THEN 'ж中' || text WHEN 3 THEN '中' || text WHEN 4 THEN text || ' ő' WHEN 5 THEN '' WHEN 6 THEN 'ascii' ELSE text END AS text FROM documents), y AS (SELECT *, unicode({_HINT}) AS c FROM x)
SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii, CASE WHEN c BETWEEN 3584 AND 3711 THEN 'th' WHEN c BETWEEN 1024 AND 1279 THEN 'ru' WHEN c BETWEEN 19968 AND 40959 THEN 'zh' WHEN c BETWEEN 256 AND 383 THEN 'extended_latin' WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'non_ascii' ELSE 'en' END AS hint FROM y""")
def language_hint(spark: SparkSession, sf: str) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id") % 8
    t = F.when(i == 1, F.concat(F.lit("aé"), t, F.lit("ไทย Ж"))).when(i == 2, F.concat(F.lit("ж中"), t)).when(i == 3, F.concat(F.lit("中"), t)).when(i == 4, F.concat(t, F.lit(" ő"))).when(i == 5, "").when(i == 6, "ascii").otherwise(t)
    return table(spark, sf, "documents").select("doc_id", X.has_non_ascii(t).alias("non_ascii"), X.language_hint(t).alias("hint"))


@query("SELECT p_partkey, lower(regexp_replace('OrderPrice' || p_brand, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words FROM part")
def camel_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.lower(X.camel_words(F.concat(F.lit("OrderPrice"), F.col("p_brand")))).alias("words"))


@query("SELECT p_partkey, '[' || p_type || '] ' || p_name || ': ' || p_brand AS described, p_brand || chr(10) || p_name || ': ' || p_type || ' (size ' || p_size::VARCHAR || ')' AS document FROM part")
def index_document(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    described = P.column_text(c("p_name"), c("p_type"), c("p_brand"), F.lit(""), 2)
    document = P.index_document(c("p_brand"), F.concat(c("p_name"), F.lit(": "), c("p_type")), F.concat(c("p_name"), F.lit(": size "), c("p_size").cast("string")), "td_cd_cs")
    return table(spark, sf, "part").select("p_partkey", described.alias("described"), document.alias("document"))


@query("SELECT n_regionkey::BIGINT AS table_id, string_agg(n_name, ' || ' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def column_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("column_index"), "n_name")
    return rounded(P.joined_views(rows, "n_name"))


@query("WITH c AS (SELECT c_custkey AS r, 'Row ' || c_custkey::VARCHAR || ': ' || c_custkey::VARCHAR || ', ' || c_name || ', ' || c_nationkey::VARCHAR || ', ' || c_mktsegment AS line FROM customer WHERE c_custkey < 500) SELECT 'customer' AS table_id, string_agg(line, chr(10) ORDER BY r) AS text FROM c")
def flatten_content(spark: SparkSession, sf: str) -> DataFrame:
    return P.flattened(customer_cells(spark, sf))


@query("SELECT table_id, column_index::BIGINT AS column_index, header FROM (VALUES ('t', 0, 'A'), ('t', 1, 'B'), ('t', 2, 'A:2'), ('u', 0, 'A')) x(table_id, column_index, header)")
def duplicate_headers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.headers(spark.createDataFrame([("t", ["A", "B", "A"]), ("u", ["A"])], "table_id string, columns array<string>")))


@query("SELECT * FROM (VALUES ('Foo_Bar_SEP_table_3.csv', 'table_3', 'Foo Bar'), ('a,b_SEP_db-#-t.csv', 'db-#-t', 'db - t'), ('db-#-t.csv', 'db-#-t', 'db - t'), ('My_File.csv', 'My_File', 'My File')) t(name, table_id, title)")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("Foo_Bar_SEP_table_3.csv",), ("a,b_SEP_db-#-t.csv",), ("db-#-t.csv",), ("My_File.csv",)], "name string")
    return names.withColumn("f", X.file_identity(F.col("name"))).select("name", "f.table_id", "f.title")


@query("SELECT doc_id, CASE WHEN n_chars >= 1000 THEN printf('%.1fK', n_chars / 1000.0) ELSE n_chars::VARCHAR END AS short, CASE WHEN doc_id % 3 = 0 THEN '?' WHEN n_chars * 12500.0 >= 1e9 THEN printf('%.1fB', n_chars * 12500.0 / 1e9) WHEN n_chars * 12500.0 >= 1e6 THEN printf('%.1fM', n_chars * 12500.0 / 1e6) ELSE printf('%.1fK', n_chars * 12500.0 / 1e3) END AS large, CASE WHEN n_chars % 8 = 0 THEN floor(-n_chars / 1000.0)::BIGINT::VARCHAR ELSE '' END AS negative, printf('%.2f', n_chars / 8.0 / 128.0 + 0.005) AS two FROM documents WHERE n_chars > 0")
def short_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    large = X.short_number(F.when(F.col("doc_id") % 3 > 0, n * 12500.0))
    whole = F.when(n % 8 == 0, X.short_number(F.floor(-n / 1000).cast("long"))).otherwise("")
    return table(spark, sf, "documents").where("n_chars > 0").select("doc_id", X.short_number(n).alias("short"), large.alias("large"), whole.alias("negative"), X.fixed(n / 8.0 / 128.0 + 0.005, 2).alias("two"))


@query(r"""WITH RECURSIVE x AS (SELECT conv_id, text, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations), p(conv_id, i, block, n, text) AS (
SELECT conv_id, i, 0::BIGINT, w, text FROM x WHERE i = 1 UNION ALL SELECT p.conv_id, x.i, CASE WHEN p.n = 0 OR p.n + x.w <= 60 THEN p.block ELSE p.block + 1 END, CASE WHEN p.n = 0 OR p.n + x.w > 60 THEN x.w ELSE p.n + x.w END, CASE WHEN p.n = 0 OR p.n + x.w > 60 THEN x.text ELSE p.text || ' | ' || x.text END FROM p JOIN x ON x.conv_id = p.conv_id AND x.i = p.i + 1)
SELECT conv_id, block, arg_max(text, i) AS text FROM p GROUP BY 1, 2""")
def text_packing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.packed(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 60))


_HEADERS = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "part": "p_partkey p_name p_brand p_type p_size p_retailprice"}


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_id, {i}::BIGINT AS column_index, '{c}' AS h" for t, names in _HEADERS.items() for i, c in enumerate(names.split())) + ") SELECT table_id, column_index, CASE WHEN regexp_matches(h, 'date|time|_ts$') THEN 'TemporalColumn' WHEN regexp_matches(h, 'price|cost|acctbal|amount|total') THEN 'PriceColumn' WHEN regexp_matches(h, 'qty|quantity|count|size') THEN 'QuantityColumn' WHEN regexp_matches(h, '(_|^)id$|key$') THEN 'IdentifierColumn' WHEN regexp_matches(h, 'name|title') THEN 'NameColumn' WHEN regexp_matches(h, 'url|uri|link') THEN 'UriColumn' ELSE 'Column' END AS class FROM h")
def rule_classification(spark: SparkSession, sf: str) -> DataFrame:
    tables = spark.createDataFrame([(t, table(spark, sf, t).columns) for t in ("customer", "orders", "lineitem", "part")], "table_id string, columns array<string>")
    return rounded(V.classified(P.headers(tables).withColumn("sample_values", F.array().cast("array<string>")), V.Rules()))


# -- streams (their plans over the whole table) ----------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.tumbling(table(spark, sf, "events"), "ts", ["event_type"], "value"), 4)


@query("WITH x AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, value FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT start, start + INTERVAL 1 HOUR AS end, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY 1")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.sliding(table(spark, sf, "events"), "ts", [], "value"), 4)


@query("WITH x AS (SELECT user_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.sessions(table(spark, sf, "events"), "ts", ["user_id"], "value"), 4)


# -- whole plans -----------------------------------------------------------------------------------------------------


def customer_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer", 0, "Key"), ("customer", 2, "Key"), ("customer", 3, "Label")], "table_id string, column_index int, class string")


LAKE_CONTRACTS = [C.Contract("Key", "hasNumber", r"^\d+$", "int(x)", "int"), C.Contract("Key", "hasNumber", r"^1", "int(x)", "int"), C.Contract("Label", "hasText", r"^[A-Z]+$", "x.lower()")]


@query(f"""WITH c AS ({_CELLS}), v AS (SELECT column_index, value::DOUBLE AS x FROM c WHERE column_index IN (0, 2)), a AS (SELECT column_index, count(*) AS count, min(x) AS min, max(x) AS max, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std, list_sort(list(x)) AS s FROM v GROUP BY 1)
SELECT 'customer' AS table_id, column_index::BIGINT AS column_index, 'hasNumber' AS property, count, min, max, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round({_quartile_sql(1)}, 6) AS p25, round({_quartile_sql(3)}, 6) AS p75 FROM a""")
def lake_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to typed properties to contracts to statistics, all columns in one plan."""
    cls = spark.createDataFrame([("Column", None), ("Key", "Column"), ("Label", "Column")], "class string, parent string")
    props = spark.createDataFrame([("hasNumber", "Key", None, "xsd:integer"), ("hasText", "Label", None, "xsd:string")], "property string, domain string, parent string, range string")
    columns = D.column_properties(customer_columns(spark), cls, props)
    results = D.converted(customer_cells(spark, sf), columns, LAKE_CONTRACTS)
    return rounded(D.numeric_profile(results, D.chosen_contracts(results)))


@query(f"WITH c AS ({_CELLS}) SELECT DISTINCT 'customer' AS table_id, c.column_index::BIGINT AS column_index, CASE WHEN c.column_index = 3 THEN 'hasText' ELSE 'hasNumber' END AS property, CASE WHEN c.column_index = 3 THEN 2 ELSE 0 END::BIGINT AS contract, 1.0::DOUBLE AS rate FROM c WHERE c.column_index IN (0, 2, 3)")
def lake_contracts(spark: SparkSession, sf: str) -> DataFrame:
    columns = customer_columns(spark).withColumn("property", F.when(F.col("class") == "Key", "hasNumber").otherwise("hasText"))
    return rounded(D.chosen_contracts(D.converted(customer_cells(spark, sf), columns, LAKE_CONTRACTS)))


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Stands for a model's analyses: some queries have none, some only one of the two texts."""
    i, t = F.col("item_id"), F.col("text")
    return table(spark, sf, "benchmark").select(i.alias("query_id"), t.alias("query"), F.when(i % 3 > 0, F.substring(t, 1, 40)).alias("table_desc"), F.when(i % 2 > 0, F.substring(t, 41, 40)).otherwise(" ").alias("column_desc"))


@query("""WITH a AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 3 > 0 THEN nullif(trim(text[1:40]), '') END AS t, CASE WHEN item_id % 2 > 0 THEN nullif(trim(text[41:80]), '') END AS c FROM benchmark)
SELECT query_id, 'raw' AS mode, query AS text FROM a UNION ALL SELECT query_id, 'table_desc', coalesce(t, query) FROM a UNION ALL SELECT query_id, 'column_desc', coalesce(c, query) FROM a UNION ALL SELECT query_id, 'combined', coalesce(nullif(concat_ws(' ', t, c), ''), query) FROM a""")
def search_text_modes(spark: SparkSession, sf: str) -> DataFrame:
    return D.search_texts(analyses(spark, sf))


_ANALYSES_SQL = """WITH a AS (SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 3 > 0 THEN nullif(trim(text[1:40]), '') END AS t, CASE WHEN item_id % 2 > 0 THEN nullif(trim(text[41:80]), '') END AS c FROM benchmark), m AS (
SELECT query_id, 'raw' AS mode, query AS text FROM a UNION ALL SELECT query_id, 'table_desc', coalesce(t, query) FROM a UNION ALL SELECT query_id, 'column_desc', coalesce(c, query) FROM a UNION ALL SELECT query_id, 'combined', coalesce(nullif(concat_ws(' ', t, c), ''), query) FROM a)"""


def _metrics_sql(by: str, ranks: str) -> str:
    hits = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in E.KS)
    return f"SELECT {by}, count(*) AS queries, count(rank) AS found, {hits}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM {ranks} GROUP BY 1"


@query(f"""{_ANALYSES_SQL}, tok AS (SELECT doc_id, {_TOK} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok), post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT mode, query_id, term, count(*) AS qtf FROM (SELECT mode, query_id, unnest({_TOK}) AS term FROM m) GROUP BY 1, 2, 3),
sc AS (SELECT mode, query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN dfs USING (term), st GROUP BY 1, 2, 3),
bm AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0), {TRUTH_SQL},
r AS (SELECT mode, query_id, min(rank) AS rank FROM truth JOIN (SELECT DISTINCT mode, query_id FROM m) USING (query_id) LEFT JOIN (SELECT * FROM bm WHERE rank <= 100) USING (mode, query_id, doc_id) GROUP BY 1, 2) {_metrics_sql("mode", "r")}""")
def mode_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.mode_metrics(table(spark, sf, "documents"), D.search_texts(analyses(spark, sf)), truth(spark, sf)))


@query(rf"""WITH x AS (SELECT doc_id, '[Column > ' || source || '] ' || text AS text FROM documents), v AS (SELECT 'as_is' AS variant, doc_id, text FROM x UNION ALL SELECT 'removed', doc_id, regexp_replace(text, '\[[^\]]+\]\s*', '', 'g') FROM x UNION ALL SELECT 'only', doc_id, array_to_string(regexp_extract_all(text, '\[([^\]]+)\]', 1), ' ') FROM x),
tok AS (SELECT variant, doc_id, {_TOK} AS ws FROM v), st AS (SELECT variant, count(*) AS n, avg(len(ws)) AS avgdl FROM tok GROUP BY 1), post AS (SELECT variant, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT variant, doc_id, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY 1, 2, 3), dfs AS (SELECT variant, term, count(*) AS df FROM post GROUP BY 1, 2),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT variant, query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN dfs USING (variant, term) JOIN st USING (variant) GROUP BY 1, 2, 3),
bm AS (SELECT variant, query_id, doc_id, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE score > 0), {TRUTH_SQL},
r AS (SELECT variant, query_id, min(rank) AS rank FROM truth JOIN (SELECT DISTINCT variant FROM v) ON true LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) USING (variant, query_id, doc_id) GROUP BY 1, 2) {_metrics_sql("variant", "r")}""")
def marker_ablation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("text", F.concat(F.lit("[Column > "), F.col("source"), F.lit("] "), F.col("text")))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(D.ablation(docs, q, truth(spark, sf)))


@query(f"WITH {BM25_SQL}, {TRUTH_SQL}, n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS n FROM bm WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = bm.query_id AND t.doc_id = bm.doc_id)) SELECT query_id, doc_id, 1::BIGINT AS label FROM truth UNION ALL SELECT query_id, doc_id, 0 FROM n WHERE n <= 5")
def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = truth(spark, sf)
    return rounded(D.training_pairs(t, R.hard_negatives(bm25(spark, sf, 20), t, 5)))


@query(f"WITH {BM25_SQL} SELECT query_id, string_agg(rank::VARCHAR || '. ' || text[1:2000], chr(10) ORDER BY rank)[1:2000] AS context FROM bm JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1")
def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    return D.contexts(bm25(spark, sf, 3), table(spark, sf, "documents"), 3)


@query("SELECT * FROM (VALUES (1, 0, 'Year', NULL), (1, 1, 'Name', 'x'), (1, 2, 'Name', 'y'), (2, 0, 'Price', '5')) t(query_id, cid, class, value)")
def constraint_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, ["upo:Year"], [("Name", ["x", " ", "y"])]), (2, None, [("ont:Price", ["5"])]), (3, [], None)]
    return rounded(D.constraint_rows(spark.createDataFrame(rows, "query_id int, tbox array<string>, abox array<struct<class:string,values:array<string>>>")))


@query(_fusion_sql(True).replace("0.5 * (", "0.7 * (", 1).replace("+ 0.5 * (", "+ 0.3 * (", 1))
def alpha_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.alpha_fusion(paired_text(spark, sf, 20), vectors(spark, sf, 20), lambda pairs: completed_text(spark, sf, pairs), lambda pairs: complete(spark, sf, pairs), 10, 0.3))


@query("SELECT * FROM (VALUES ('t1', ['Odd']::VARCHAR[], ['b']::VARCHAR[], false), ('t2', []::VARCHAR[], []::VARCHAR[], true), ('t3', []::VARCHAR[], ['x']::VARCHAR[], true)) t(table_id, errors, warnings, valid)")
def reference_validation(spark: SparkSession, sf: str) -> DataFrame:
    notes = spark.createDataFrame([("t1", "a", "Odd"), ("t1", "a", "Price"), ("t2", "c", "upo:Price")], "table_id string, column_name string, class string")
    tables = spark.createDataFrame([("t1", ["a", "b"]), ("t2", ["c"]), ("t3", ["x"])], "table_id string, columns array<string>")
    return D.validated(notes, classes(spark), tables)


@query("WITH c AS (SELECT n_regionkey AS table_id, n_nationkey AS column_index, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation) SELECT table_id::BIGINT AS table_id, column_index::BIGINT AS column_index, CASE WHEN pos < 3 THEN 0 ELSE 1 END::BIGINT AS call FROM c")
def call_batches(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.call_batches(table(spark, sf, "nation").select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("column_index")), 3))


@query("SELECT n_regionkey::BIGINT AS table_id, n_nationkey::BIGINT AS column_index, n_regionkey::VARCHAR || '::' || n_name AS class_name, 'Name ⊓ ∃hasText.⊤' AS definition, n_name AS description FROM nation")
def defined_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("column_index"), F.lit("Name").alias("class"), F.array(F.lit("hasText")).alias("properties"), F.col("n_name").alias("description"), F.col("n_name").alias("header"))
    return rounded(D.defined_classes(rows.drop("header"), rows.select("table_id", "column_index", "header")))


from tarn import queries_io  # noqa: E402, F401  (registers its queries)
