"""Whole plans of table discovery: profile a lake, search it, compare ways of searching. Each is one DataFrame plan over
all tables or all queries; steps that need a model take its results as relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import stats
from tarn.functions import text as X
from tarn.operators import contracts as C
from tarn.operators import evaluation as E
from tarn.operators import ontology as O
from tarn.operators import profile as P
from tarn.operators import retrieval as R
from tarn.sources import storage

#: Characters of a context, columns of one model call, confidence of a class that says nothing.
CONTEXT, PER_CALL, VAGUE = 2000, 32, 0.3
MODES = ("raw", "table_desc", "column_desc", "combined")


# -- profiling -------------------------------------------------------------------------------------------------------


def column_properties(typed: DataFrame, classes: DataFrame, properties: DataFrame) -> DataFrame:
    """table_id, column_index, class, property, range: the nearest properties of each column's class."""
    near = O.nearest_properties(classes, properties).join(properties.select("property", "range"), "property")
    return typed.join(near, "class").select("table_id", "column_index", "class", "property", "range")


def converted(cells: DataFrame, columns: DataFrame, contracts: list[C.Contract]) -> DataFrame:
    """table_id, column_index, property, contract, value, result, state of every cell under every contract of its
    column's class and property. One pass over the cells."""
    rows = cells.join(columns.select("table_id", "column_index", "class", "property"), ["table_id", "column_index"])
    tries = []
    for i, c in enumerate(contracts):
        mine = (F.col("class") == c.primitive_class) & (F.col("property") == c.data_property)
        o = C.outcome(F.col("value"), c)
        tries.append(F.when(mine, F.struct(F.lit(i).alias("contract"), o["ok"].alias("ok"), o["result"].alias("result"))))
    rows = rows.select("table_id", "column_index", "row_index", "property", "value", F.explode(F.array_compact(F.array(*tries))).alias("t"))
    state = F.when(X.blank(F.col("value")), "null").when(F.col("t.ok"), "ok").otherwise("error")
    return rows.select("table_id", "column_index", "row_index", "property", F.col("t.contract").alias("contract"), "value", state.alias("state"), F.when(state == "ok", F.col("t.result")).alias("result"))


def chosen_contracts(results: DataFrame, accept: float = C.ACCEPT) -> DataFrame:
    """Of each column and property the contract with the highest rate (the earlier on ties), if it is accepted."""
    filled = results.where("state <> 'null'")
    rates = filled.groupBy("table_id", "column_index", "property", "contract").agg((F.count_if(F.col("state") == "ok") / F.count("*")).alias("rate"))
    order = Window.partitionBy("table_id", "column_index", "property").orderBy(F.desc("rate"), "contract")
    return rates.withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) & (F.col("rate") >= accept)).drop("_r")


def numeric_profile(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """Statistics of the converted values of the chosen contracts."""
    key = ["table_id", "column_index", "property"]
    values = results.join(chosen.select(*key, "contract"), [*key, "contract"]).where("state = 'ok'").withColumn("x", F.col("result").try_cast("double")).where("x is not null")
    return stats.decimal_stats(values, key, "x")


def defined_classes(columns: DataFrame, summaries: DataFrame) -> DataFrame:
    """table_id, column_index, class_name (table::column), definition, description: annotations joined with summaries on
    their column; ``unmatched`` lists those without one."""
    parts = F.array_compact(F.array(F.col("class"), F.when(F.size("properties") > 0, F.array_join(F.transform("properties", lambda p: F.concat(F.lit("∃"), p, F.lit(".⊤"))), " ⊓ "))))
    rows = columns.join(summaries.select("table_id", "column_index", "header"), ["table_id", "column_index"])
    return rows.select("table_id", "column_index", F.concat_ws("::", "table_id", "header").alias("class_name"), O.definition(parts).alias("definition"), "description")


def unmatched(columns: DataFrame, summaries: DataFrame) -> DataFrame:
    return columns.join(summaries, ["table_id", "column_index"], "left_anti")


def validated(annotations: DataFrame, classes: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, errors (unknown classes), warnings (columns without an annotation), valid."""
    known = classes.select(F.col("class")).distinct().withColumn("_k", F.lit(True))
    seen = annotations.withColumn("class", X.strip_prefix(F.col("class"))).join(known, "class", "left")
    per = seen.groupBy("table_id").agg(F.array_sort(F.collect_set(F.when(F.col("_k").isNull(), F.col("class")))).alias("errors"), F.collect_set("column_name").alias("named"))
    out = tables.select("table_id", "columns").join(per, "table_id", "left")
    none = F.array().cast("array<string>")
    out = out.select("table_id", F.coalesce("errors", none).alias("errors"), F.array_sort(F.array_except("columns", F.coalesce("named", none))).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def only_valid(annotations: DataFrame, checked: DataFrame) -> DataFrame:
    return annotations.join(checked.where("valid").select("table_id"), "table_id", "left_semi")


def repaired_annotations(annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Unknown classes replaced by the one that shares most words, else by the root: the correction of one round."""
    names = annotations.select(F.col("class").alias("name")).distinct()
    fixed = O.repaired(names, classes).withColumnRenamed("class", "better")
    return annotations.join(fixed, annotations["class"] == fixed["name"], "left").drop("name").withColumn("class", F.coalesce("better", F.lit(O.ROOT))).drop("better")


def call_batches(columns: DataFrame, most: int = PER_CALL) -> DataFrame:
    """Columns of each table in even batches of at most ``most``, larger ones first."""
    w = Window.partitionBy("table_id")
    n = F.ceil(F.count("*").over(w) / most)
    total = F.count("*").over(w)
    at = F.row_number().over(w.orderBy("column_index")) - 1
    small, extra = F.floor(total / n), total % n
    first = extra * (small + 1)
    return columns.withColumn("call", F.when(at < first, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - first) / small)).cast("int"))


# -- searching -------------------------------------------------------------------------------------------------------


def search_texts(analyses: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """query_id, mode, text: what each mode searches for; where the model gave nothing, the query itself."""
    given = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    both = F.nullif(F.concat_ws(" ", given("table_desc"), given("column_desc")), F.lit(""))
    texts = {"raw": F.col("query"), "table_desc": given("table_desc"), "column_desc": given("column_desc"), "combined": both}
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(texts[m], F.col("query")).alias("text")) for m in modes])
    return analyses.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.mode", "m.text")


def mode_metrics(docs: DataFrame, texts: DataFrame, truth: DataFrame, k: int = 100) -> DataFrame:
    """Metrics of every mode in one plan: (query, mode) is the query's id."""
    q = texts.withColumn("qm", F.concat_ws("|", F.col("query_id").cast("string"), "mode"))
    hits = R.bm25_search(docs, q, "doc_id", "text", "qm", "text", k)
    t = truth.join(q.select("query_id", "mode", "qm"), "query_id").select(F.col("qm").alias("query_id"), "doc_id", "mode")
    ranks = E.best_ranks(hits, t).join(t.select("query_id", "mode").distinct(), "query_id")
    return E.metrics(ranks, ["mode"])


def variants(docs: DataFrame, text: str) -> dict[str, DataFrame]:
    """The corpus as it is, without class markers, and with markers only."""
    return {"as_is": docs, "removed": docs.withColumn(text, X.strip_markers(F.col(text))), "only": docs.withColumn(text, X.only_markers(F.col(text)))}


def ablation(docs: DataFrame, queries: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of each variant of the corpus, queries that all variants answer."""
    ranks = None
    for name, d in variants(docs, "text").items():
        r = E.best_ranks(R.bm25_search(d, queries, "doc_id", "text", "query_id", "text", k), truth).withColumn("variant", F.lit(name))
        ranks = r if ranks is None else ranks.unionByName(r)
    return E.metrics(E.common_queries(ranks, 3), ["variant"])


def training_pairs(truth: DataFrame, negatives: DataFrame) -> DataFrame:
    """query_id, doc_id, label: answers and hard negatives."""
    return truth.select("query_id", "doc_id", F.lit(1).alias("label")).unionByName(negatives.select("query_id", "doc_id", F.lit(0).alias("label")))


def contexts(hits: DataFrame, texts: DataFrame, k: int, most: int = CONTEXT) -> DataFrame:
    """query_id, context: the k best tables' texts, numbered, cut to ``most`` characters."""
    rows = hits.where(F.col("rank") <= k).join(texts.select("doc_id", "text"), "doc_id")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.substring("text", 1, most))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"])
    return rows.groupBy("query_id").agg(F.substring(F.array_join(listed, "\n"), 1, most).alias("context"))


def constraint_rows(analyses: DataFrame) -> DataFrame:
    """query_id, cid, class, value from class names (tbox) and (class, values) pairs (abox): one row a class and value;
    classes without a value keep one row; blank values are dropped."""
    tbox = F.transform(F.coalesce("tbox", F.array().cast("array<string>")), lambda c: F.struct(X.strip_prefix(c).alias("class"), F.lit(None).cast("string").alias("value")))
    abox = F.flatten(F.transform(F.coalesce("abox", F.from_json(F.lit("[]"), "array<struct<class:string,values:array<string>>>")), lambda a: F.transform(F.filter(a["values"], lambda v: F.btrim(v) != ""), lambda v: F.struct(X.strip_prefix(a["class"]).alias("class"), v.alias("value")))))
    rows = analyses.select("query_id", F.posexplode(F.concat(tbox, abox)).alias("cid", "c"))
    return rows.select("query_id", F.col("cid").cast("long").alias("cid"), "c.class", "c.value")


def confident(hits: DataFrame, types: DataFrame) -> DataFrame:
    """Results with a confidence: low for tables of which every column has only the root class."""
    return hits.join(types.select("doc_id", "fallback_only"), "doc_id", "left").withColumn("confidence", F.when(F.col("fallback_only"), VAGUE).otherwise(1.0))


Completion = Callable[[DataFrame], DataFrame]


def alpha_fusion(text: DataFrame, vector: DataFrame, complete_text: Completion, complete_vector: Completion, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha minmax(text) + (1 - alpha) minmax(vector) over the candidates of both lists; the completions give the scores
    of stated pairs, for those that only the other list has."""
    pairs = storage.checkpointed(text.select("query_id", "doc_id").unionByName(vector.select("query_id", "doc_id")).distinct())
    fused = R.score_fusion(vector, text, complete_vector(pairs), complete_text(pairs), (1 - alpha, alpha), (True, True))
    return R.ranked(fused.select("query_id", "doc_id", "score"), k)


def contained(docs: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage_text: str) -> DataFrame:
    """query_id, doc_id: documents that hold a passage verbatim. The longest word inside a passage (between white space) is
    a word of every such document: documents join on it, and what joins is verified. Passages without such a word, of
    one or two words, are held against all documents."""
    inner = F.slice(F.split(F.col(passage_text), r"\s+"), 2, F.greatest(F.size(F.split(F.col(passage_text), r"\s+")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    p = passages.where(F.col(passage_text).isNotNull()).select(F.col(passage_key).alias("query_id"), F.col(passage_text).alias("_p"), longest["w"].alias("_w"))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t"))
    found = d.select("doc_id", F.explode(F.array_distinct(F.split("_t", r"\s+"))).alias("_w")).join(p.where("_w <> ''"), "_w").select("query_id", "doc_id", "_p")
    sure = found.join(d, "doc_id").where(F.contains("_t", "_p")).select("query_id", "doc_id")
    brief = d.join(p.where("_w is null or _w = ''"), F.contains("_t", "_p")).select("query_id", "doc_id")
    return sure.unionByName(brief).distinct()


def answered(queries: DataFrame, ids: Column) -> DataFrame:
    """One row a (query, answer)."""
    return queries.select("query_id", F.explode(ids).alias("doc_id"))


def numbered_passages(passages: DataFrame) -> DataFrame:
    """Schema and row passages numbered from 0 within their table."""
    return passages.withColumn("passage", F.row_number().over(Window.partitionBy("table_id").orderBy("kind", "at")) - 1)


def table_documents(tables: DataFrame, columns: DataFrame, fields: str) -> DataFrame:
    """doc_id, text of every table for the index: descriptions joined in column order, with statistics if asked for."""
    d = P.joined_views(columns, "description_text").withColumnRenamed("text", "cd")
    s = P.joined_views(columns, "stats_text").withColumnRenamed("text", "cs")
    rows = tables.join(d, "table_id", "left").join(s, "table_id", "left")
    none = F.lit("")
    return rows.select(F.col("table_id").alias("doc_id"), P.index_document(F.coalesce("description", none), F.coalesce("cd", none), F.coalesce("cs", none), fields).alias("text"))
