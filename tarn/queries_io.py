"""Queries of sources, sinks, patterns, expressions and readouts. What is written goes to the session's shared folder
and is read back from there, so the results hold both ways against the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import expressions, regex
from tarn.functions import text as X
from tarn.operators import contracts as C
from tarn.operators import evaluation as E
from tarn.operators import ontology as O
from tarn.operators import profile as P
from tarn.operators import retrieval as R
from tarn.plans import discovery as D
from tarn.plans import helpers as H
from tarn.plans import provider as V
from tarn.queries import query, rounded, table
from tarn.sources import lake, sinks, storage
from tarn.streaming import events as T


def folder(spark: SparkSession) -> str:
    return f"{storage.shared_folder(spark)}/relations-{uuid.uuid4().hex}"


# -- files -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' \"' || c_mktsegment || '\", a' || chr(10) || 'b' AS c_name, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV, with quotes, commas and line ends in cells, and read as strings."""
    at = folder(spark)
    name = F.concat("c_name", F.lit(' "'), "c_mktsegment", F.lit('", a\nb'))
    sinks.csv_file(table(spark, sf, "customer").select("c_custkey", name.alias("c_name"), "c_mktsegment"), at)
    return lake.csv_table(spark, at)


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
SELECT 'nation' AS table_id, 'Some Lake' AS title, i::BIGINT AS row_index, 0::BIGINT AS column_index, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT 'nation', 'Some Lake', i, 1, n_name FROM n UNION ALL SELECT 'nation', 'Some Lake', -1, 0, 'n_nationkey' UNION ALL SELECT 'nation', 'Some Lake', -1, 1, 'n_name'""")
def csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of CSV files as cells, table ids and titles from the file names."""
    at = folder(spark)
    sinks.single_csv(table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), f"{at}/Some_Lake_SEP_nation.csv")
    return rounded(lake.csv_cells(spark, at))


@query("SELECT 'nation' AS table_id, 'Some Lake' AS title, ['n_nationkey', 'n_name'] AS columns, 2::BIGINT AS column_count, (SELECT count(*) FROM nation)::BIGINT AS row_count")
def catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    sinks.single_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), f"{at}/Some_Lake_SEP_nation.csv")
    return rounded(lake.catalog_of(lake.csv_cells(spark, at)).select("table_id", "title", "columns", "column_count", "row_count"))


def _unified(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by region as unified tables."""
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("table_id", F.concat(F.lit("Region "), "table_id").alias("title"), F.lit("").alias("section_title"), F.array(F.lit("key"), F.lit("name")).alias("columns"), F.lit(2).alias("column_count"), F.size("r").alias("row_count"), cells.alias("rows"))


_REGION_CELLS = "WITH n AS (SELECT n_regionkey::VARCHAR AS table_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT table_id, i::BIGINT AS row_index, 0::BIGINT AS column_index, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT table_id, i, 1, n_name FROM n"


@query(_REGION_CELLS)
def unified_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Unified tables written as one JSON file each, read back and taken apart; a broken file is left out."""
    at = folder(spark)
    sinks.json_lines(_unified(spark, sf).withColumn("part", F.col("table_id")), at, ["part"])
    spark.createDataFrame([('{"table_id": "broken", "rows": [',)], "value string").coalesce(1).write.text(f"{at}/part=broken")
    return rounded(lake.unified_cells(lake.unified_tables(spark, at)))


@query("SELECT 1::BIGINT AS files")
def broken_files(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    sinks.json_lines(_unified(spark, sf).withColumn("part", F.col("table_id")), at, ["part"])
    spark.createDataFrame([('{"table_id": "broken", "rows": [',)], "value string").coalesce(1).write.text(f"{at}/part=broken")
    return lake.broken_tables(spark, at).agg(F.count("*").alias("files"))


@query(_REGION_CELLS)
def nested_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSONL tables in the unified form."""
    at = folder(spark)
    text = lambda c: F.struct(c.alias("text"))
    nested = _unified(spark, sf).select(F.col("table_id").alias("tableId"), F.col("title").alias("documentTitle"), F.lit("http://x").alias("documentUrl"), F.transform("columns", text).alias("columns"), F.transform("rows", lambda r: F.struct(F.transform(r, text).alias("cells"))).alias("rows"))
    sinks.json_lines(nested, at)
    return rounded(lake.unified_cells(lake.nested_tables(spark, at)))


@query("SELECT item_id::VARCHAR AS query_id, text AS query_text, 'a' AS answer, (item_id % 5)::VARCHAR AS ground_truth_table_id, '[\"' || (item_id % 5)::VARCHAR || '\",\"x\"]' AS ground_truth_table_ids, '{\"source\":\"s\"}' AS metadata FROM benchmark")
def query_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Queries written as JSONL, read back and put in the relation's form."""
    at, i = folder(spark), F.col("item_id").cast("string")
    rows = table(spark, sf, "benchmark").select(i.alias("query_id"), F.col("text").alias("question"), F.array((F.col("item_id") % 5).cast("string"), F.lit("x")).alias("answer_tables"), F.create_map(F.lit("source"), F.lit("s")).alias("metadata"), F.lit("test").alias("split"), F.lit("a").alias("answer"))
    sinks.json_lines(rows, at)
    return sinks.query_relation(lake.queries(spark, at))


@query("SELECT item_id::VARCHAR AS query_id, CASE WHEN row_number() OVER (ORDER BY md5(item_id::VARCHAR || ':42'), item_id::VARCHAR) <= 15 THEN 'train' ELSE 'test' END AS split FROM benchmark")
def query_split(spark: SparkSession, sf: str) -> DataFrame:
    return lake.split_queries(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id")), 15)


@query("SELECT doc_id, lang, NULL::VARCHAR AS source, 'train' AS original_split FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, source, 'test' FROM documents WHERE doc_id % 2 = 1")
def united_splits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return lake.united_splits({"train": d.where("doc_id % 2 = 0").select("doc_id", "lang"), "test": d.where("doc_id % 2 = 1").select("doc_id", "source")}).select("doc_id", "lang", "source", "original_split")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [source, lang] ELSE [lang] END AS answers FROM documents")
def answer_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from a JSON list, else the single one."""
    ids = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("source", "lang"))).when(F.col("doc_id") % 3 == 1, F.lit("not json"))
    return table(spark, sf, "documents").select("doc_id", lake.answers(ids, F.col("lang")).alias("answers"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND n_chars > 200")
def filtered_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lake.scan(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "lang = 'de' AND n_chars > 200").select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def row_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return lake.by_id(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", 7)


@query("SELECT n_nationkey::BIGINT AS row_index, [n_nationkey::VARCHAR, n_name] AS row FROM nation")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = P.cells_of(table(spark, sf, "nation"), "nation", ["n_nationkey", "n_name"], F.col("n_nationkey").cast("long"))
    return lake.table_rows(cells, "nation")


@query("SELECT doc_id, lang, n_chars FROM documents")
def parquet_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A relation partitioned by language, read with all its subfolders and a column that only some files have."""
    at, d = folder(spark), table(spark, sf, "documents")
    sinks.replace(d.where("lang in ('de', 'en')").select("doc_id", F.col("lang").alias("l"), "lang"), f"{at}/a", ["l"])
    sinks.replace(d.where("lang not in ('de', 'en')").select("doc_id", "lang", "n_chars"), f"{at}/b")
    got = lake.parquet_folder(spark, at).select("doc_id", "lang", F.col("n_chars").alias("n"))
    return got.join(d.select("doc_id", "n_chars"), "doc_id").select("doc_id", "lang", F.coalesce("n", "n_chars").alias("n_chars"))


@query("SELECT coalesce(vec_id, 0) AS vec_id, CASE WHEN label = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings")
def fallback_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, those of another relation where a key is missing."""
    e = table(spark, sf, "embeddings")
    return lake.embeddings_or(e.where("label <> 0"), e.withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding")


@query("WITH c AS (SELECT o_orderpriority AS class, 'd' AS dataset, year(o_orderdate) AS y FROM orders) SELECT DISTINCT class, y::BIGINT AS iteration FROM c WHERE y = (SELECT max(y) FROM c)")
def latest_iteration(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of a dataset's last ontology."""
    y = F.year("o_orderdate").cast("string")
    rows = table(spark, sf, "orders").select(F.lit("d").alias("dataset"), F.concat(F.lit("d_iter_"), y).alias("ontology_id"), F.col("o_orderpriority").alias("class")).distinct()
    other = rows.limit(1).withColumns({"dataset": F.lit("e"), "ontology_id": F.lit("e_iter_9999")})
    return rounded(lake.ontology(rows.unionByName(other), "d").select("class", "iteration"))


# -- relations -------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'merged' WHEN s_suppkey % 4 = 1 THEN 'updated' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def relation_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced, appended to, merged by key in place, updated and deleted from."""
    at, s = folder(spark), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    sinks.replace(s.limit(1), at)
    sinks.replace(s, at)
    sinks.append(s.withColumn("s_suppkey", F.col("s_suppkey") + 1000000), at)
    k = F.col("s_suppkey")
    sinks.upsert(spark, s.where(k % 4 == 0).withColumn("s_name", F.lit("merged")), at, ["s_suppkey"])
    rows = sinks.updated(spark.read.parquet(at), (k < 1000000) & (k % 4 == 1), {"s_name": F.lit("updated")})
    return sinks.deleted(rows, (k < 1000000) & (k % 4 == 3))


@query("SELECT n_regionkey::VARCHAR AS table_id, 'Region ' || n_regionkey::VARCHAR AS document_title, '[\"key\",\"name\"]' AS columns, count(*) AS row_count, CASE WHEN n_regionkey < 2 THEN 'test' ELSE 'train' END AS split FROM nation GROUP BY n_regionkey")
def ingested_catalog(spark: SparkSession, sf: str) -> DataFrame:
    test = spark.createDataFrame([("q", ["0", "1"]), ("r", ["1", "none"])], "query_id string, answer_tables array<string>")
    return rounded(sinks.ingested(_unified(spark, sf), test).select("table_id", "document_title", "columns", "row_count", "split"))


@query("SELECT doc_id, lang, source FROM documents")
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    at = folder(spark)
    sinks.json_lines(table(spark, sf, "documents").select("doc_id", "lang", "source"), at, ["source"])
    return spark.read.schema("doc_id long, lang string, source string").json(at)


@query("SELECT n_name AS class, 'Class: ' || n_name || CASE WHEN n_regionkey > 0 THEN chr(10) || '    SubClassOf: R' || n_regionkey::VARCHAR ELSE '' END AS frame FROM nation")
def class_frames(spark: SparkSession, sf: str) -> DataFrame:
    parent = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    return sinks.manchester(table(spark, sf, "nation").select(F.col("n_name").alias("class"), parent.alias("parent")))


@query("SELECT doc_id AS query_id, lang AS question, unnest([source, lang]) AS table_id FROM documents")
def single_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("question"), F.array("source", "lang").alias("answer_tables"))
    return sinks.passages(rows)


@query("SELECT conv_id::BIGINT AS table_id, role AS kind, turn AS at, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) - 1 AS passage FROM conversations")
def passage_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("table_id"), F.col("role").alias("kind"), F.col("turn").alias("at"))
    return rounded(D.numbered_passages(rows))


@query("WITH r AS (SELECT o_orderpriority AS variant, o_orderkey AS query_id, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 60 + 1 END AS rank FROM orders) SELECT variant, metric, round(value, 6) AS value FROM (SELECT variant, unnest(['hit_at_1', 'hit_at_5', 'hit_at_10']) AS metric, unnest([avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)]) AS value FROM r GROUP BY 1)")
def hit_curves(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    ranks = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_orderkey").alias("query_id"), F.when(c % 5 > 0, c % 60 + 1).alias("rank"))
    return rounded(E.hit_curve(ranks, ["variant"], (1, 5, 10)))


@query("WITH m AS (SELECT o_custkey AS query_id, o_orderpriority AS wanted, o_orderstatus AS found, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'exact' END AS match FROM orders), a AS (SELECT query_id, count(DISTINCT found) FILTER (match <> 'none') / count(DISTINCT found) AS p, count(DISTINCT wanted) FILTER (match <> 'none') / count(DISTINCT wanted) AS r FROM m GROUP BY 1) SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' WHEN p > 0 THEN 'low' ELSE 'zero' END AS band FROM a")
def constraint_quality(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("wanted"), F.col("o_orderstatus").alias("found"), F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise("exact").alias("match"))
    return rounded(E.constraint_quality(m))


@query("WITH d AS (SELECT doc_id FROM documents) SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM d")
def result_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Results on tables of which nothing but the root class is known are less sure."""
    d = table(spark, sf, "documents").select("doc_id")
    return D.confident(d, d.where("doc_id % 3 = 0 or doc_id % 4 = 0").withColumn("fallback_only", F.col("doc_id") % 4 == 0)).select("doc_id", F.when(F.col("confidence") < 1, F.lit(0.3)).otherwise(F.col("confidence")).alias("confidence"))


# -- patterns and expressions ----------------------------------------------------------------------------------------

#: RE2 patterns, then patterns that RE2 refuses (they match nothing).
PATTERNS = [r"(?P<first>\w+) \w+$", r"[[:upper:]]+\s", r"[*+-]?\d*[a-z]", r".{3,5}?e", r"(?i)ECONOMY|(?:small|LARGE) ", r"\w+\b.*[aeiou]$", r"\QSM\E", r"[^[:space:]&]+ [\w]+$", r"(?m)^\S+$", r"\pL+ \PL?\p{Lu}", r"^[A-Z]{4,8}\x20", r"[\dA-F]|E"]
REFUSED = [r"(?=S)", r"(?<!a)S", r"(S)\1", r"S++", r"(?>S)", r"(S)?(?(1)T|M)", r"S{1001}", "(", "[S", r"(?P=x)", r"\R"]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("WITH v AS (SELECT DISTINCT p_type AS v FROM part UNION SELECT DISTINCT p_type || chr(10) || p_brand FROM part UNION SELECT DISTINCT p_brand FROM part) " + " UNION ALL ".join([f"SELECT {_sql_text(p)} AS pattern, count(*) FILTER (regexp_matches(v, {_sql_text('^(?:' + p + ')')})) AS hits FROM v" for p in PATTERNS] + [f"SELECT {_sql_text(p)}, 0" for p in REFUSED]))
def regex_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    v = p.select(F.col("p_type").alias("v")).union(p.select(F.concat("p_type", F.lit("\n"), "p_brand"))).union(p.select("p_brand")).distinct()
    tries = F.array(*[F.struct(F.lit(x).alias("pattern"), regex.matches(F.col("v"), x).cast("long").alias("hit")) for x in PATTERNS + REFUSED])
    return v.select(F.explode(tries).alias("t")).groupBy("t.pattern").agg(F.sum("t.hit").alias("hits"))


@query("""WITH t AS (SELECT p_partkey, (p_partkey % 7 - 3)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS x FROM part), v AS (SELECT *, x::DOUBLE AS d FROM t)
SELECT p_partkey, trunc(d)::BIGINT AS a, CASE WHEN x[1:1] = '-' THEN '-' || lpad(x[2:], 5, '0') ELSE lpad(x, 6, '0') END AS b, CASE WHEN length(x) >= 3 THEN x ELSE NULL END AS c, ltrim(x, '-') AS d, true AS e, CASE WHEN d < 0 THEN 'neg' ELSE 'pos' END AS f, floor(d / 2.0) AS g, ((trunc(d)::BIGINT % 7) + 7) % 7 AS h, split_part(replace(x, '.', ','), ',', 1) AS i, contains(x, '.5') AS j, x[1:1] <> '-' AS k, CASE WHEN d % 1 = 0 THEN 'none' ELSE x END AS l, d * 4 - 1 AS m, NULL::VARCHAR AS n, regexp_extract(x, '([0-9]+)[.]([0-9])', 2) AS o, abs(trunc(d)::BIGINT) || '!' AS p FROM v""")
def expression_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Contract expressions over number texts from -3.9 to 3.9."""
    t = table(spark, sf, "part").select("p_partkey", F.concat((F.col("p_partkey") % 7 - 3).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string")).alias("x"))
    forms = {"a": "int(float(x))", "b": "x.zfill(6)", "c": "x.zfill(3)", "d": "x.strip('-') or 'none'", "e": "isinstance(x, str)", "f": "'neg' if float(x) < 0 else 'pos'", "g": "float(x) // 2", "h": "int(float(x)) % 7", "i": "x.replace('.', ',').split(',')[0]", "j": "'.5' in x", "k": "not x.startswith('-')", "l": "x if float(x) % 1 else 'none'", "m": "float(x) * 4 - 1", "n": "str(int(x))", "o": r"re.search(r'(\d+)\.(\d)', x).group(2)", "p": "str(abs(int(float(x)))) + '!'"}
    return rounded(t.select("p_partkey", *[expressions.compile_expression(e, F.col("x")).alias(n) for n, e in forms.items()]))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '-' || p_size::VARCHAR WHEN 2 THEN '.5' WHEN 3 THEN ' 7' WHEN 4 THEN '2024-01-02' ELSE '1.50' END AS x FROM part), f(target, pattern) AS (VALUES ('int', '^-?[0-9]+$'), ('float', '^-?[0-9]+\\.?[0-9]*$'), ('str', '^.+$'), ('datetime', '^\\d{4}-\\d{2}-\\d{2}$'))
SELECT target, count(*) AS tested, count(*) FILTER (regexp_matches(x, pattern)) AS ok FROM t, f GROUP BY 1""")
def fallback_contracts(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    x = F.when(k == 0, size).when(k == 1, F.concat(F.lit("-"), size)).when(k == 2, ".5").when(k == 3, " 7").when(k == 4, "2024-01-02").otherwise("1.50")
    targets = ["int", "float", "str", "datetime"]
    rates = C.success_rates(table(spark, sf, "part").select(x.alias("x")), [], "x", [C.fallback("A", "b", t) for t in targets])
    return rates.select(F.element_at(F.array(*map(F.lit, targets)), F.col("contract") + 1).alias("target"), "tested", "ok")


@query(r"""WITH e AS (SELECT event_id, props, CASE WHEN NOT regexp_matches(props, '^\{"k": \d') THEN 'pattern not matched' WHEN NOT regexp_matches(props, '^\{"k": \d\}$') THEN 'transform failed' END AS reason FROM events WHERE trim(props) <> '') SELECT props AS value, reason FROM e WHERE reason IS NOT NULL ORDER BY reason, event_id LIMIT 5""")
def contract_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of values that a contract fails on, with the reason."""
    c = C.Contract("Key", "hasKey", r'\{"k": \d', "int(x[6:-1]) if len(x) == 8 else int('none')", "int")
    return C.error_samples(table(spark, sf, "events"), "props", "event_id", c)


@query("SELECT range, template, needs FROM (VALUES ('xsd:integer', 'p: {min}-{max} (avg {mean})', ['min', 'max', 'mean']), ('xsd:nonNegativeInteger', 'p: {min}-{max} (avg {mean})', ['min', 'max', 'mean']), ('xsd:decimal', 'p: {min}-{max} (avg {mean})', ['min', 'max', 'mean']), ('xsd:dateTime', 'p: {min} to {max}', ['min', 'max']), ('xsd:dateTimeStamp', 'p: {min} to {max}', ['min', 'max']), ('xsd:anyURI', 'p: {distinct_count} unique URLs', ['distinct_count']), ('xsd:string', 'p: {distinct_count} unique values', ['distinct_count']), ('xsd:boolean', 'p: {count} values', ['count'])) t(range, template, needs)")
def readout_templates(spark: SparkSession, sf: str) -> DataFrame:
    ranges = ["xsd:integer", "xsd:nonNegativeInteger", "xsd:decimal", "xsd:dateTime", "xsd:dateTimeStamp", "xsd:anyURI", "xsd:string", "xsd:boolean"]
    return spark.createDataFrame([(r, *C.template_of(r, "p")) for r in ranges], "range string, template string, needs array<string>")


@query("""WITH a AS (SELECT o_orderstatus AS g, min(o_totalprice) AS mn, max(o_custkey) AS mx, avg(o_totalprice) AS me, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT g, 'price: ' || CASE WHEN mn = floor(mn) THEN format('{:,}', mn::BIGINT) ELSE format('{:,.2f}', mn) END || ' to ' || format('{:,}', mx) || ', mean ' || printf('%.2f', me) || ' of ' || format('{:,}', n) || ', ' || format('{:,}', n) || ' days, ' || printf('%.1f%%', n / 1000000.0 * 100) || ', a, b, c, d, e, N/A' AS text FROM a""")
def readout_formats(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("g")).agg(F.min("o_totalprice").alias("min"), F.max("o_custkey").alias("max"), F.avg("o_totalprice").alias("mean"), F.count("*").alias("count"))
    a = a.withColumn("range_days", F.col("count")).withColumn("null_ratio", F.col("count") / 1000000.0).withColumn("top_values", F.array(*map(F.lit, "abcdef")))
    kinds = dict(a.dtypes)
    return a.select("g", C.readout("price: {min} to {max}, mean {mean} of {count}, {range_days}, {null_ratio}, {top_values}, {unknown}", {c: F.col(c) for c in a.columns if c != "g"}, kinds).alias("text"))


@query(r"SELECT doc_id, ['order', 'price', source, 'key'] AS words FROM documents")
def class_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the class names in marker chains."""
    text = F.concat(F.lit("x [OrderPrice > "), F.col("source"), F.lit("] y [Key > Order]"))
    return table(spark, sf, "documents").select("doc_id", X.class_tokens(text).alias("words"))


# -- deep hierarchies ------------------------------------------------------------------------------------------------


def _chain(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("c"), i).alias("class"), F.when(i > 0, F.concat(F.lit("c"), i - 1)).alias("parent"))


@query("SELECT 'c' || a.range::VARCHAR AS anc, 'c' || b.range::VARCHAR AS \"desc\", (b.range - a.range)::BIGINT AS dist FROM range(150) a, range(150) b WHERE b.range >= a.range")
def deep_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of 150 classes: no ancestor is lost."""
    return rounded(O.closure(_chain(spark, 150)))


@query("SELECT 'c' || range::VARCHAR AS class FROM range(80)")
def long_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle of 80 classes with a tail that is on no cycle."""
    tail = spark.createDataFrame([("t1", "c3"), ("t2", "t1"), ("r", None)], "class string, parent string")
    return O.cycles(_chain(spark, 80).withColumn("parent", F.coalesce("parent", F.lit("c79"))).unionByName(tail))


@query("SELECT s_suppkey::VARCHAR AS class, (s_suppkey // 2)::VARCHAR AS anc, s_nationkey::BIGINT AS s_nationkey FROM supplier WHERE s_suppkey // 2 > 0")
def parents_of_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A binary tree over all suppliers: the closure's pairs at distance 1 are its edges."""
    s = table(spark, sf, "supplier")
    half = F.floor(F.col("s_suppkey") / 2)
    classes = s.select(F.col("s_suppkey").cast("string").alias("class"), F.when(half > 0, half.cast("string")).alias("parent"))
    near = O.closure(classes).where("dist = 1")
    return rounded(near.join(s, near["desc"] == s["s_suppkey"].cast("string")).select(F.col("desc").alias("class"), "anc", "s_nationkey"))


# -- streams ---------------------------------------------------------------------------------------------------------


@query("WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT start, start + INTERVAL 1 HOUR AS end, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stream_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over files in append mode: windows come out once the watermark has passed them."""
    at, e = folder(spark), table(spark, sf, "events").select("event_type", "ts", "value")
    sinks.replace(e.repartition(4), f"{at}/in")
    stream = T.source(spark, e.schema, f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.run_to_table(T.tumbling(stream, "ts", ["event_type"], "value", late="30 minutes"), f"{at}/out", f"{at}/state")
    return rounded(out, 4).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT event_id, event_type, round(value, 4) AS value FROM events")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is sent twice; each key is written once, from state bounded by the watermark."""
    at, e = folder(spark), table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    sinks.replace(e.union(e).repartition(3), f"{at}/in")
    stream = T.source(spark, e.schema, f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    T.ingest(stream, f"{at}/out", f"{at}/state", "event_id", "ts", "60 days").awaitTermination()
    return rounded(spark.read.parquet(f"{at}/out").select("event_id", "event_type", "value"), 4)


# -- stored index with stems -----------------------------------------------------------------------------------------


@query()
def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Search over an index of English stems; there is no stemmer in SQL here, so tests hold it against brute force."""
    at = folder(spark)
    R.build_index(table(spark, sf, "documents"), "doc_id", "text", at, stemmer="english")
    return rounded(R.index_search(spark, at, table(spark, sf, "benchmark"), "item_id", "text", 10))


@query("SELECT query_id, doc_id FROM (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))")
def verbatim_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a query's passage."""
    return D.contained(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")




# -- runs, votes, trees, baselines -----------------------------------------------------------------------------------


@query("SELECT 'lake' AS dataset, 'bm25' AS method, doc_id AS query_id, n_chars AS rank FROM documents")
def result_frame(spark: SparkSession, sf: str) -> DataFrame:
    return H.result_frame(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("n_chars").alias("rank")), {"dataset": "lake", "method": "bm25"})


@query("SELECT event_id, (props->>'$.k') AS k, NULL::VARCHAR AS none FROM events")
def nested_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", H.nested(F.col("props"), "k").alias("k"), H.nested(F.col("props"), "a", "b").alias("none"))


@query("SELECT c.c_mktsegment AS \"group\", n.n_name AS class, coalesce(any_value(CASE WHEN b > 0 THEN 1 ELSE 0 END) FILTER (x.k = n.n_nationkey AND k % 3 > 0), 0)::BIGINT AS vote FROM (SELECT DISTINCT c_mktsegment FROM customer) c, nation n LEFT JOIN (SELECT c_mktsegment, c_nationkey AS k, max(c_acctbal) AS b FROM customer GROUP BY 1, 2) x ON x.c_mktsegment = c.c_mktsegment AND x.k = n.n_nationkey GROUP BY 1, 2")
def parsed_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of voters that leave out some classes."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("class"))
    votes = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg((F.max("c_acctbal") > 0).cast("int").alias("v")).where("c_nationkey % 3 > 0").join(nation, "c_nationkey")
    field = F.concat(F.lit("score_"), F.regexp_replace("class", r"\W", "_"))
    replies = votes.groupBy(F.col("c_mktsegment").alias("group")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(field, "v")))).alias("reply"))
    return rounded(H.parsed_votes(replies, nation))


@query("SELECT n_nationkey, '**' || n_name || '**' || CASE WHEN n_regionkey = 0 THEN '' ELSE ': region ' || n_regionkey::VARCHAR END || CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE ' [' || (n_nationkey % 4)::VARCHAR || '/5 votes, ' || (20 * (n_nationkey % 4))::VARCHAR || '%]' END AS line FROM nation")
def voted_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    described = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    return table(spark, sf, "nation").select("n_nationkey", H.voted_line(F.col("n_name"), described, F.when(k < 3, k.cast("int")), F.lit(5)).alias("line"))


@query("SELECT doc_id, lang AS name, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'own' WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM documents")
def collected_proposals(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("name"))
    odd = d.where("doc_id % 2 = 1").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "own"))
    return H.proposals({"even": d.where("doc_id % 2 = 0"), "odd": odd}).select("doc_id", "name", "source")


@query("WITH c AS (SELECT n_regionkey::BIGINT AS iteration, n_nationkey AS pos, CASE n_nationkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'merge' END AS action, n_name AS name, CASE WHEN n_nationkey % 3 = 2 THEN 'Column' END AS target FROM nation) SELECT iteration, count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'merge') AS merged, string_agg('- ' || upper(action) || ' ' || name || coalesce(' -> ' || target, ''), chr(10) ORDER BY pos) AS log FROM c GROUP BY 1")
def release_logs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    changes = table(spark, sf, "nation").select(F.col("n_regionkey").alias("iteration"), F.col("n_nationkey").alias("at"), F.when(k == 0, "add").when(k == 1, "delete").otherwise("merge").alias("action"), F.col("n_name").alias("name"), F.when(k == 2, "Column").alias("target"))
    return rounded(H.release_log(changes))


@query("""WITH i AS (SELECT vec_id, lpad(label::VARCHAR, 2, '0') || lpad((vec_id % 3)::VARCHAR, 2, '0') AS c, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id, v, l AS level, c[1:2 * l] AS code FROM i, (SELECT unnest([0, 1, 2]) AS l)),
x AS (SELECT code, generate_subscripts(v, 1) AS d, unnest(v) AS e FROM p), m AS (SELECT code, list(m ORDER BY d) AS centre FROM (SELECT code, d, avg(e) AS m FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT code, level::BIGINT AS level, count(*) AS items, round(avg(list_distance(v, centre)), 6) AS radius, round(avg(list_cosine_similarity(v, centre)), 6) AS cohesion FROM p JOIN m USING (code) GROUP BY 1, 2""")
def cluster_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Radius and cohesion of every node of a tree of two levels."""
    code = F.concat(F.lpad(F.col("label").cast("string"), 2, "0"), F.lpad((F.col("vec_id") % 3).cast("string"), 2, "0"))
    return rounded(H.node_shapes(table(spark, sf, "embeddings").withColumn("code", code), "code", "embedding"))


@query("SELECT n_regionkey::BIGINT AS level, count(*) AS nodes, avg(n_nationkey::DOUBLE) FILTER (n_nationkey % 2 = 0) AS radius, round(avg(1.0 / (1 + n_nationkey)), 6) AS cohesion FROM nation GROUP BY 1")
def level_averages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return rounded(H.level_averages(table(spark, sf, "nation").select(F.col("n_regionkey").alias("level"), F.when(k % 2 == 0, k.cast("double")).alias("radius"), (1.0 / (1 + k)).alias("cohesion"))))


@query("WITH r AS (SELECT n_regionkey::VARCHAR AS table_id, n_nationkey::BIGINT AS row_index, 'key: ' || n_nationkey::VARCHAR || ' | name: ' || n_name AS summary, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5(n_regionkey::VARCHAR || ':' || n_nationkey::VARCHAR || ':42'), n_nationkey) AS i FROM nation WHERE n_regionkey > 0) SELECT table_id, row_index, summary FROM r WHERE i <= 3")
def row_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables as text, for tables that have none yet."""
    n = table(spark, sf, "nation")
    cells = n.select(F.col("n_regionkey").cast("string").alias("table_id"), F.col("n_nationkey").alias("row_index"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("column_index", "value"))
    headers = cells.select("table_id", "column_index").distinct().withColumn("header", F.when(F.col("column_index") == 0, "key").otherwise("name"))
    return rounded(H.row_summaries(cells, headers, 3, spark.createDataFrame([("0",)], "table_id string")))


@query("SELECT count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END) AS tables FROM documents")
def predicted_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions in two forms."""
    ctxs = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.struct(F.col("source").alias("table_id")).alias("tag"))))
    return H.predicted_tables(table(spark, sf, "documents").select(ctxs.alias("ctxs"), F.array(F.struct(F.col("lang").alias("table_id"))).alias("tags")))


@query("SELECT o_custkey AS query_id, n_name AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, n_name) AS rank FROM orders JOIN nation ON n_nationkey = o_orderkey % 40")
def translated_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions under foreign ids, of which some are unknown."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 40).cast("int").alias("foreign"))
    return rounded(H.translated_answers(o, table(spark, sf, "nation").select(F.col("n_nationkey").alias("foreign"), F.col("n_name").alias("table_id"))))


@query("WITH q AS (SELECT DISTINCT source AS table_id, CASE WHEN doc_id % 4 < 3 THEN 'Is ' || lang || '?' END AS question FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY md5(table_id || ':' || question || ':42')) AS i FROM q WHERE question IS NOT NULL) SELECT table_id, question FROM r WHERE i <= 3")
def generated_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions from replies: well-formed, broken and without any."""
    q, k = F.concat(F.lit('{"question": " Is '), F.col("lang"), F.lit('? "}')), F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("["), q, F.lit(", "), q, F.lit("]"))).when(k == 1, q).when(k == 2, F.concat(F.lit("Sure: "), q, F.lit(" [broken"))).otherwise("none")
    return H.generated_queries(table(spark, sf, "documents").select(F.col("source").alias("table_id"), reply.alias("reply")), 3)


@query("SELECT md5('m:' || lang) AS key, CASE WHEN lang = 'de' THEN NULL ELSE upper(lang) END AS answer, CASE WHEN lang = 'de' THEN 'ValueError: de' END AS error FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def cached_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a model that fails on one prompt; half of the answers are in the cache by then."""
    at = folder(spark)

    def call(prompt: str) -> str:
        if prompt == "de":
            raise ValueError(prompt)
        return prompt.upper()

    prompts = table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("prompt"))
    V.called(prompts.where("prompt < 'es'"), "m", call, at, attempts=2)
    return V.called(prompts, "m", call, at, attempts=2)


@query(r"""WITH x AS (SELECT event_type, count(*) FILTER (regexp_matches(props, '^\{"k": \d+\}')) / count(*) AS a, count(*) FILTER (regexp_matches(props, '^\{"k": \d\}')) / count(*) AS b FROM events WHERE trim(props) <> '' GROUP BY 1) SELECT event_type, CASE WHEN b >= a THEN 1 ELSE 0 END::BIGINT AS contract, greatest(a, b)::DOUBLE AS rate FROM x WHERE greatest(a, b) >= 0.85""")
def reused_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored contracts taken again for columns that they fit; the more used one on ties."""
    stored = [C.Contract("K", "k", r'\{"k": \d+\}', "x", hits=1), C.Contract("K", "k", r'\{"k": \d\}', "x", hits=5)]
    return rounded(C.reused(table(spark, sf, "events"), ["event_type"], "props", stored))
