"""Small plans around runs: result frames, checks before a run, votes, proposals, passages, trees, baselines."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import similarity as S

# Fields of the index by key, and the suffix of the variant without class markers.
INDEX_KEYS = ["td", "cd", "cs", "td_cd", "td_cs", "cd_cs", "td_cd_cs"]
NO_MARKERS = "_no_pc"


# -- runs ------------------------------------------------------------------------------------------------------------


def run_id(dataset: str, method: str, at: datetime, *more: str | None) -> str:
    """dataset_method_..._yyyymmdd_hhmmss without the parts that are empty."""
    return "_".join([dataset, method, *[m for m in more if m], at.strftime("%Y%m%d_%H%M%S")])


def result_frame(results: DataFrame, run: dict[str, str]) -> DataFrame:
    """One row a query with the run's description beside it."""
    return results.select(*[F.lit(v).alias(k) for k, v in run.items()], *results.columns)


def index_key(key: str | None, default: str = "td_cd_cs") -> str:
    """A checked index key; None is the default, the suffix of the variant is kept."""
    if key is None:
        return default
    key = key.lower().strip()
    if key.removesuffix(NO_MARKERS) not in INDEX_KEYS:
        raise ValueError(f"index key {key}: one of {', '.join(INDEX_KEYS)} is needed")
    return key


def missing(spark: SparkSession, paths: list[str], tables: tuple[str, ...] = ()) -> list[str]:
    """Which of the paths and tables that a run needs don't exist."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [p for p in paths if not fs_path(p).getFileSystem(conf).exists(fs_path(p))] + [t for t in tables if not spark.catalog.tableExists(t)]


def nested(text: Column, *path: str) -> Column:
    """A value inside JSON text, null where a step is missing or the text is broken."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))


# -- votes, proposals, trees -----------------------------------------------------------------------------------------


def parsed_votes(replies: DataFrame, classes: DataFrame) -> DataFrame:
    """group, class, vote: of each reply (group, reply as a JSON object of score_<class>) one row a known class; classes that
    it doesn't name have 0. Characters that no field name has stand as underscores in it."""
    field = F.concat(F.lit("score_"), F.regexp_replace("class", r"\W", "_"))
    scores = replies.select("group", F.explode_outer(F.from_json("reply", "map<string,int>")).alias("field", "vote"))
    every = replies.select("group").distinct().join(F.broadcast(classes.select("class").distinct()))  # groups of voters by classes: what is returned
    return every.withColumn("field", field).join(scores, ["group", "field"], "left").select("group", "class", F.coalesce("vote", F.lit(0)).alias("vote"))


def with_scores(classes: DataFrame, scores: DataFrame) -> DataFrame:
    """Classes with their coverage; those without votes keep null."""
    return classes.join(scores.select("class", F.col("coverage").alias("usefulness")), "class", "left")


def voted_line(name: Column, description: Column, positives: Column, voters: Column) -> Column:
    """A line of a tree: **Name**: description [3/5 votes, 60%]."""
    text = F.concat(F.lit("**"), name, F.lit("**"), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise(""))
    return F.when(positives.isNull(), text).otherwise(F.concat(text, F.format_string(" [%d/%d votes, %d%%]", positives, voters, F.rint(100 * positives / voters).cast("int"))))


def proposals(parts: dict[str, DataFrame]) -> DataFrame:
    """Proposals of several agents in one relation: each with its agent as source unless it names one."""
    out = None
    for agent, df in parts.items():
        own = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("source", F.coalesce(own, F.lit(agent)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def release_log(changes: DataFrame) -> DataFrame:
    """iteration, added, deleted, merged, log: counts of the edits of each iteration and their lines in order."""
    a = F.col("action")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit("- "), F.upper("action"), F.lit(" "), F.col("name"), F.when(F.col("target").isNotNull(), F.concat(F.lit(" -> "), F.col("target"))).otherwise("")).alias("line")))), lambda x: x["line"])
    return changes.groupBy("iteration").agg(F.count_if(a == "add").alias("added"), F.count_if(a == "delete").alias("deleted"), F.count_if(a == "merge").alias("merged"), F.array_join(lines, "\n").alias("log"))


def level_averages(nodes: DataFrame) -> DataFrame:
    """level, nodes, radius, cohesion: averages over the nodes of each level of a cluster tree (null ones left out)."""
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.avg("radius").alias("radius"), F.avg("cohesion").alias("cohesion"))


def node_shapes(items: DataFrame, code: str, vec: str, digits: int = 2) -> DataFrame:
    """code, level, items, radius (mean distance to the centre), cohesion (mean cosine to it) of every node of a cluster tree;
    an item belongs to the nodes of all prefixes of its code. Centres come from one aggregate by (node, dimension)."""
    n = F.length(code) / digits
    rows = items.select(F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("level"), F.col(code).alias("c"), F.col(vec).alias("v")).withColumn("code", F.substr("c", F.lit(1), F.col("level") * digits))
    parts = rows.select("code", F.posexplode("v").alias("d", "x")).groupBy("code", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    far = F.sqrt(F.aggregate(F.zip_with("v", "centre", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    cosine = dot(F.col("v"), F.col("centre")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("centre"), F.col("centre")))
    return rows.join(centres, "code").groupBy("code", "level").agg(F.count("*").alias("items"), F.avg(far).alias("radius"), F.avg(cosine).alias("cohesion"))


def query_clusters(similarity: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """item, cluster: spectral clusters of a bounded set from its pair similarities (i, j, sim); the limit is that of the
    kernel step."""
    rows = similarity.select("i", "j", "sim").limit(S.KERNEL * (S.KERNEL - 1) // 2 + 1).toPandas()
    ids = sorted(set(rows["i"]) | set(rows["j"]))
    if len(ids) > S.KERNEL:
        raise ValueError(f"more than {S.KERNEL} items")
    import numpy as np

    at = {x: n for n, x in enumerate(ids)}
    m = np.eye(len(ids))
    i, j = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = rows["sim"].to_numpy()
    return similarity.sparkSession.createDataFrame(list(zip(ids, S.spectral(m, k, seed).tolist(), strict=True)), f"item {similarity.schema['i'].dataType.simpleString()}, cluster int")


def cluster_pairs(clusters: DataFrame, similarity: DataFrame, most: int) -> DataFrame:
    """cluster, i, j, sim: the most similar pairs inside each cluster (a report of so many)."""
    a = clusters.select(F.col("item").alias("i"), F.col("cluster").alias("ci"))
    b = clusters.select(F.col("item").alias("j"), F.col("cluster").alias("cj"))
    inside = similarity.join(a, "i").join(b, "j").where("ci = cj")
    order = Window.partitionBy("ci").orderBy(F.round("sim", 9).desc(), "i", "j")
    return inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(F.col("ci").alias("cluster"), "i", "j", "sim", "rank")


# -- baselines -------------------------------------------------------------------------------------------------------


def row_summaries(cells: DataFrame, headers: DataFrame, per: int, done: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """table_id, row_index, summary ("column: value | ..."): of each table the rows with the smallest hashes (a sampling
    operator); tables in ``done`` are left out."""
    todo = cells if done is None else cells.join(done.select("table_id").distinct(), "table_id", "left_anti")
    order = Window.partitionBy("table_id").orderBy(F.md5(F.concat_ws(":", "table_id", F.col("row_index").cast("string"), F.lit(str(seed)))), "row_index")
    picked = todo.select("table_id", "row_index").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).drop("_r")
    named = todo.join(picked, ["table_id", "row_index"]).join(headers.select("table_id", "column_index", "header"), ["table_id", "column_index"])
    listed = F.array_sort(F.collect_list(F.struct("column_index", F.concat("header", F.lit(": "), "value").alias("s"))))
    return named.groupBy("table_id", "row_index").agg(F.array_join(F.transform(listed, lambda x: x["s"]), " | ").alias("summary"))


def predicted_tables(predictions: DataFrame) -> DataFrame:
    """One row: the number of different tables in predictions; their contexts count, their tags where they have none."""
    of_contexts = F.transform("ctxs", lambda c: c["tag"]["table_id"])
    of_tags = F.transform("tags", lambda t: t["table_id"])
    ids = F.when(F.coalesce(F.size("ctxs"), F.lit(0)) > 0, of_contexts).otherwise(of_tags)
    return predictions.select(F.explode(ids).alias("t")).where("t <> ''").agg(F.count_distinct("t").alias("tables"))


def translated_answers(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """Answers or predictions (query_id, place, foreign) under the ids of another naming (foreign, table_id); unknown ones go
    and the places close up."""
    known = answers.join(ids, "foreign").select("query_id", "place", "table_id")
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "table_id"))).select("query_id", "table_id", "rank")


QUESTION = r'"question"\s*:\s*"((?:[^"\\]|\\.)*)"'


def generated_queries(replies: DataFrame, per: int, seed: int = 42) -> DataFrame:
    """table_id, question: questions from model replies, as JSON (a list of objects or one) or, where that is broken, by
    their field; blank and repeated ones go, and of each table the ``per`` with the smallest hashes stay (a sampling
    operator)."""
    kind = "array<struct<question:string>>"
    whole = F.from_json("reply", kind)
    found = F.regexp_extract_all("reply", F.lit(QUESTION), F.lit(1))
    asked = F.when(F.exists(whole, lambda x: x["question"].isNotNull()), F.transform(whole, lambda x: x["question"])).otherwise(found)
    rows = replies.select("table_id", F.explode(asked).alias("question")).withColumn("question", F.btrim("question")).where("question <> ''").distinct()
    order = Window.partitionBy("table_id").orderBy(F.md5(F.concat_ws(":", "table_id", "question", F.lit(str(seed)))))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).drop("_r")


def sanitised(name: str) -> str:
    """A name that any catalog takes."""
    return re.sub(r"\W", "_", name).lower()
