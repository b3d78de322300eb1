"""Hand-checkable cases of functions and operators."""

import json
import statistics
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions import expressions, regex, stats
from tarn.functions import text as X
from tarn.operators import contracts as C
from tarn.operators import evaluation as E
from tarn.operators import ontology as O
from tarn.operators import profile as P
from tarn.operators import retrieval as R
from tarn.operators import similarity as S
from tarn.plans import provider as V
from tarn.sources import lake, sinks
from tarn.streaming import events as T


def values(spark, xs, kind="long"):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], f"g int, pos int, x {kind}")


@pytest.mark.parametrize("xs", [[1, 2], [1, 2, 3], [1, 2, 3, 4], [5, 1, 9, 9, 2, 7, 7], list(range(11))])
def test_exclusive_quartiles(spark, xs):
    r = stats.integer_stats(values(spark, xs), ["g"], "x", "pos").first()
    q = statistics.quantiles(xs, n=4)
    assert (r["p25"], r["p75"]) == (q[0], q[2]) and r["median"] == statistics.median(xs)
    assert abs(r["std"] - statistics.stdev(xs)) < 1e-9


def test_integer_stats_edges(spark):
    r = stats.integer_stats(values(spark, [7]), ["g"], "x", "pos").first()
    assert (r["std"], r["p25"], r["mode"], r["count"]) == (None, None, 7, 1)
    assert stats.integer_stats(values(spark, [2, 1, 1, 2, None]), ["g"], "x", "pos").first()["mode"] == 2
    r = stats.nonnegative_stats(values(spark, [-1, 0, 3]), ["g"], "x").first()
    assert (r["count"], r["min"], r["max"], r["mean"]) == (2, 0, 3, 1.5)


def test_string_stats(spark):
    assert stats.string_stats(values(spark, list("aabb"), "string"), ["g"], "x").first()["entropy"] == 1.0
    flag = lambda xs: stats.string_stats(values(spark, xs, "string"), ["g"], "x").first()["is_categorical"]
    assert not flag(["a"] * 9 + ["b"]) and flag(["a"] * 10 + ["b"])
    affix = lambda xs: tuple(stats.common_affixes(values(spark, xs, "string"), ["g"], "x").first())[1:]
    assert affix(["ab1", "ab2"])[0] == "ab" and affix(["x"]) == ("x", "x") and affix(["a", "b"]) == (None, None)
    assert affix(["one.csv", "two.csv"]) == (None, ".csv")


def test_range_days(spark):
    df = spark.sql("select 0 g, timestamp_ntz'2024-01-01 23:00:00' x union all select 0, timestamp_ntz'2024-01-02 22:00:00'")
    assert stats.datetime_stats(df, ["g"], "x").first()["range_days"] == 0


def test_registry():
    assert stats.statistics("xsd:decimal") is stats.decimal_stats and stats.statistics("odd") is stats.string_stats


def test_regex(spark):
    for good in (r"^\d{4}-(\d+)", r"a+?b*?\\+", r"(?P<y_1>\d{4})", r"[*+-]\d", r"[[:alpha:]]", r"\p{Greek}x", r"[]a]", r"a{2,3}"):
        assert regex.valid(good), good
    for bad in (r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"(?>a)", "(", r"(?P=x)", r"(a)?(?(1)b|c)", r"\h", "a{1001}", "[", "*a", r"\p{Nothing}", "(?U)a"):
        assert not regex.valid(bad), bad
    df = spark.createDataFrame([("1999x",), ("a[b",), ("a&&b",), ("line\n",), ("+5",)], "x string")
    hits = lambda p: [r["x"] for r in df.where(regex.matches(F.col("x"), p)).collect()]
    assert hits(r"(?P<y>\d{4})x$") == ["1999x"] and hits(r"a[[&]") == ["a[b", "a&&b"] and hits(r"line$") == [] and hits(r"[+]\d") == ["+5"] and hits("(") == []


def test_contracts(spark):
    c = C.Contract("Year", "hasYear", r"^\d{4}", "int(x)", "int")
    df = values(spark, ["1982", "19", "", "1982a", None], "string")
    r = C.success_rates(df, [], "x", [c]).first()
    assert (r["tested"], r["ok"]) == (3, 1)
    assert tuple(C.apply_counts(df, [], "x", c).first()) == (1, 2, 2)
    assert [r["x"] for r in C.unmatched(df, "x", "pos", c).collect()] == ["19"]
    assert [tuple(r) for r in C.error_samples(df, "x", "pos", c).collect()] == [("19", "pattern not matched"), ("1982a", "transform failed")]
    assert C.halving_plan(8, 1000) == [(41, 4), (82, 2), (164, 1)]
    assert C.best_contract(values(spark, [str(i) for i in range(1900, 2000)], "string"), "x", "pos", [C.Contract("Y", "p", "^z", "x"), c]) == (c, 1.0)
    assert C.best_contract(df, "x", "pos", []) == (None, 0.0)
    assert C.table(spark, [c]).first()["contract_id"] == __import__("hashlib").md5(c.key.encode()).hexdigest()[:12]
    assert C.missing_statistics("{name} {mean} {odd}", ["mean"]) == ["odd"] and C.property_name("YearColumn") == "hasYearValue"
    assert C.fallback("A", "b", "float").expression == "float(x)"
    odd = [C.Contract("Y", "p", r"(?P<y>\d{4})", "int(x)"), C.Contract("Y", "p", "(a)?(?(1)b|c)", "x"), C.Contract("Y", "p", ".", "open(x)"), C.Contract("Y", "p", ".", "int(x) * 9223372036854775807")]
    rates = {r["contract"]: r["ok"] for r in C.success_rates(values(spark, ["1982", "2001"], "string"), [], "x", odd).collect()}
    assert rates == {0: 2, 1: 0, 2: 0, 3: 0}  # none of them fails the job


@pytest.mark.parametrize(
    ("source", "value", "want"),
    [
        ("x.strip()", " a ", "a"), ("int(x)", " 12 ", 12), ("int(x)", "1.5", None), ("float(x.replace(',', ''))", "1,200.5", 1200.5), ("len(x)", "abc", 3), ("x.split('-')[-1]", "a-b-c", "c"), ("x[1:-1]", "(ab)", "ab"), ("x[-2:]", "abcd", "cd"),
        ("re.sub('[^0-9]', '', x)", "a1b2", "12"), ("re.match(r'(\\d+)-(\\d+)', x).group(2)", "10-20x", "20"), ("x.upper() if x.startswith('a') else x", "ab", "AB"), ("float(x) / 2 + 1", "4", 3.0), ("round(float(x))", "2.5", 2),
        ("datetime.strptime(x, '%d/%m/%Y').year" if False else "x.zfill(5)", "42", "00042"), ("'a' in x", "cab", True), ("x == 'y' or x == 'z'", "z", True), ("'v' + x", "1", "v1"), ("max(int(x), 3)", "2", 3),
    ],
)
def test_expressions(spark, source, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(expressions.compile_expression(source, F.col("x"))).first()[0] == want


VALUES = ["", " a ", "-1.5", "2.5", "12", "-7", "+3", "1e8", "100000000", "1e-5", "0.00012", "1234567.891", "1e17", "12345", "abc", "a-b c", "Tom O'Neil x2y", "1_000", "0", "-0.0", "nan", "é\u00a0", "x" * 40]
FORMS = [
    "x.strip()", "x.lstrip('-')", "x.rstrip('5')", "x.strip() or 'none'", "x.strip() and 'some'", "int(x)", "float(x)", "int(float(x))", "str(float(x))", "str(int(x))", "float(x) + 1", "int(x) // 5", "int(x) % 5", "int(x) % -5", "float(x) % 2", "-int(x)", "int(x) / 4", "int(x) * 3 - 1", "2 ** 3",
    "x.zfill(3)", "x.zfill(8)", "x.upper()", "x.lower()", "x.title()", "x.capitalize()", "x.isdigit()", "len(x)", "len(x.split())", "x.split()[0]", "x.split('-')[-1]", "x[1:3]", "x[-2:]", "x[:-1]", "x[0]", "x[-3]", "x.startswith('1')", "x.endswith('5')", "not x", "x == '12'", "x != '12'", "x < 'b'",
    "'1' in x", "x in ('12', 'abc')", "x not in ['12']", "isinstance(x, str)", "isinstance(x, (int, float))", "'n' if not x else x", "1 if x else 2.5", "abs(float(x))", "round(float(x))", "max(int(x), 3)", "min(float(x), 0.5)", "bool(x)", "x + '!'", "x * 2", "x.replace(' ', '')", "1 < len(x) <= 5", "float(x) if '.' in x else int(x)",
    "str(bool(x))", "x is None", "x is not None", "len(x) > 3 and x[0] == '1'", "int(x) if x.isdigit() else None",
]


def test_expressions_as_python_evaluates_them(spark):
    """Every form on every value: Python's result, null where Python raises."""
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, x string")
    got = df.orderBy("i").select(*[expressions.compile_expression(f, F.col("x")).alias(f"c{n}") for n, f in enumerate(FORMS)]).collect()
    wrong = []
    for i, x in enumerate(VALUES):
        for n, f in enumerate(FORMS):
            try:
                want = eval(f, {}, {"x": x})  # noqa: S307
            except (ValueError, IndexError, ZeroDivisionError, OverflowError):
                want = None
            have = got[i][n]
            same = have == want or isinstance(want, float) and isinstance(have, float) and have != have and want != want
            wrong += [] if same else [(f, x, have, want)]
    assert wrong == []


def test_numbers_as_python_prints_them(spark):
    import random

    rng = random.Random(1)
    xs = [1250.0, 1350.0, 1450.0, 1850.0, 2.675, 0.125, -0.005, 0.005, 1e9, 999.995, 0.045, 123456789.0] + [rng.randint(0, 10**7) / rng.choice([1, 2, 4, 8, 10, 16, 1000]) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(X.fixed(F.col("x"), 1), X.fixed(F.col("x"), 2), X.short_number(F.col("x"))).collect()
    for x, r in zip(xs, rows, strict=True):
        a = abs(x)
        short = f"{x / 1e9:.1f}B" if a >= 1e9 else f"{x / 1e6:.1f}M" if a >= 1e6 else f"{x / 1e3:.1f}K" if a >= 1e3 else f"{x:.2f}" if x != int(x) else str(int(x))
        assert tuple(r) == (f"{x:.1f}", f"{x:.2f}", short), x
    assert spark.range(1).select(X.short_number(F.lit(None).cast("double"))).first()[0] == "?"


def test_stems_and_search_by_them(spark, tmp_path):
    from tarn.functions.stems import stem

    pairs = "consign consign,consigned consign,consigning consign,consignment consign,consist consist,consistency consist,consolation consol,conspicuously conspicu,knaves knave,knightly knight,knots knot,generously generous,communities communiti,arsenal arsenal,dying die,skies sky,news news,proceed proceed,hopping hop,hoping hope,happy happi,by by,say say,ties tie,cries cri,gas gas,this this,national nation,rational ration,relational relat,vileness vile,probate probat,rate rate,controll control,falling fall,running run,agreed agre,feed feed,luxuriated luxuri,activate activ,adoption adopt,organization organ,sensibility sensibl"
    for pair in pairs.split(","):
        word, want = pair.split()
        want = {"communiti": "communiti", "sensibl": "sensibl"}.get(want, want)
        assert stem(word) == want, (word, stem(word), want)
    docs = spark.createDataFrame([(1, "running runners hope"), (2, "hoping hops"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    R.build_index(docs, "doc_id", "text", str(tmp_path / "i"), stemmer="english")
    q = spark.createDataFrame([(7, "run hopes")], "q int, t string")
    n, avgdl = 4, (3 + 2 + 2) / 4
    weight = lambda df, tf, dl: log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    got = {r["doc_id"]: r["score"] for r in R.index_search(spark, str(tmp_path / "i"), q, "q", "t", 10).collect()}
    assert got == {1: pytest.approx(weight(1, 1, 3) + weight(2, 1, 3)), 2: pytest.approx(weight(2, 1, 2))}


def test_contained_passages(spark):
    docs = spark.createDataFrame([(1, "a b long c"), (2, "xa b long cx"), (3, "a b  long c"), (4, None), (5, "b")], "d int, t string")
    p = spark.createDataFrame([(1, "a b long c"), (2, "b"), (3, "b long"), (4, None), (5, "")], "p int, t string")
    from tarn.plans import discovery as D

    got = sorted(tuple(r) for r in D.contained(docs, "d", "t", p, "p", "t").collect())
    texts = {1: "a b long c", 2: "xa b long cx", 3: "a b  long c", 5: "b"}
    assert got == sorted((i, d) for i, t in {1: "a b long c", 2: "b", 3: "b long", 5: ""}.items() for d, x in texts.items() if t in x)


def test_vector_search_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, v array<float>")
    whole = sorted(tuple(r) for r in R.vector_search(df, df, "i", "v", "i", "v", 3).collect())
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert sorted(tuple(r) for r in R.vector_search(df, df, "i", "v", "i", "v", 3).collect()) == whole and len(whole) == 120


def test_tree_text_marks_cycles_and_cuts(spark):
    cls = spark.createDataFrame([("R", None), ("A", "R"), ("B", "A"), ("A", "B"), ("C", "R")], "class string, parent string")
    lines = [r["line"] for r in O.tree_text(cls).orderBy("n").collect()]
    assert lines == ["R", "  A", "    B", "      A (cycle)", "  C"]
    assert [r["line"] for r in O.tree_text(cls, 2).orderBy("n").collect()] == ["R", "  A", "... (3 more)"]


def test_dates_and_refusals(spark):
    df = spark.createDataFrame([("03/02/2024", "2024-02-03T10:00:00")], "a string, b string")
    r = df.select(expressions.compile_expression("datetime.strptime(x, '%d/%m/%Y')", F.col("a")), expressions.compile_expression("datetime.fromisoformat(x.replace(' ', 'T'))", F.col("b"))).first()
    assert (r[0].month, r[0].day, r[1].hour) == (2, 3, 10)
    for bad in ("__import__('os')", "y", "x.__class__", "[i for i in x]", "lambda: x", "open(x)", "x[", "exec(x)"):
        with pytest.raises(expressions.Refused):
            expressions.compile_expression(bad, F.col("a"))


def test_text_functions(spark):
    df = spark.createDataFrame([("It is a Zürich-test, x 42", "[Identifier > Name] Person: x", "  \t a  ")], "a string, b string, c string")
    r = df.select(X.tokens(F.col("a"), []), X.tokens(F.col("a")), X.strip_markers(F.col("b")), X.placeholder_markers(F.col("b")), X.class_tokens(F.col("b")), X.strip(F.col("c")), X.only_markers(F.col("b"))).first()
    assert list(r[0]) == ["it", "is", "zürich", "test", "42"] and list(r[1]) == ["zürich", "test", "42"]
    assert r[2] == "Person: x" and r[3] == "[Type] Person: x" and list(r[4]) == ["identifier", "name"] and r[5] == "a" and r[6] == "Identifier > Name"
    nums = spark.createDataFrame([(1234567.0,), (1500.0,), (2.5,), (3.0,)], "x double").select(X.short_number(F.col("x"))).collect()
    assert [n[0] for n in nums] == ["1.2M", "1.5K", "2.50", "3"]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, doc_id string, rank int")
    got = {r["doc_id"]: r["score"] for r in R.rrf(a, b).collect()}
    assert got["b"] == pytest.approx(0.5 / 62 + 0.5 / 61) and got["a"] == pytest.approx(0.5 / 61) and got["c"] == pytest.approx(0.5 / 62)
    s = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0)], "query_id int, doc_id string, score double")
    assert {r["score"] for r in R.score_fusion(s, s, s, s, scale=(True, True)).collect()} == {1.0}
    assert R.unified_search("hybrid", 5, text=s).count() == 2
    empty = spark.createDataFrame([], "v int, e array<float>")
    assert R.vector_search(empty, empty, "v", "e", "v", "e", 3).count() == 0


def test_ontology(spark):
    cls = spark.createDataFrame([("Column", None), ("Temporal", "Column"), ("Year", "Temporal"), ("Name", "Column")], "class string, parent string")
    maps = spark.createDataFrame([("t1", 0, "Year"), ("t2", 0, "Name")], "table_id string, column_index int, class string")
    idf = {r["class"]: (r["df"], round(r["idf"], 9)) for r in O.class_frequencies(cls, maps).collect()}
    assert idf == {"Column": (2, 0.0), "Temporal": (1, round(log(1.5), 9)), "Year": (1, round(log(1.5), 9)), "Name": (1, round(log(1.5), 9))}
    want = spark.createDataFrame([(1, 1, "Year", None)], "query_id int, cid int, class string, value string")
    assert [(r["doc_id"], r["score"]) for r in O.score_plain(cls, maps, want).collect()] == [("t1", pytest.approx(log(1.5)))]
    assert [(r["doc_id"], r["score"]) for r in O.score_weighted(cls, maps, want).collect()] == [("t1", 1.0)]
    props = spark.createDataFrame([("hasVal", "Column", None), ("hasTime", "Temporal", None)], "property string, domain string, parent string")
    near = {r["class"]: r["property"] for r in O.nearest_properties(cls, props).collect()}
    assert near["Year"] == "hasTime" and near["Name"] == "hasVal"
    assert {r["class"]: r["path"] for r in O.paths(O.closure(cls)).collect()}["Year"] == "Column > Temporal > Year"
    loop = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A")], "class string, parent string")
    assert sorted(r[0] for r in O.cycles(loop).collect()) == ["A", "B"]
    key = lambda df: sorted(map(tuple, df.select("anc", "desc", "dist").collect()))
    assert len(key(O.closure(loop))) == 7 and ("Column", "Year", 2) in key(O.closure(cls)) and O.closure(cls.limit(0)).count() == 0
    cells = spark.createDataFrame([("t1", 0, 0, " 1982 ")], "table_id string, row_index int, column_index int, value string")
    v = spark.createDataFrame([(1, 1, "Year", "1982")], "query_id int, cid int, class string, value string")
    assert O.value_matches(cells, maps, v).count() == 1


def test_edits():
    p = {"Column": None, "A": "Column", "B": "A", "C": "B"}
    assert O.makes_cycle(p, "A", "C") and not O.makes_cycle(p, "C", "Column")
    out, d = O.edited(p, {"q": ["B"], "r": ["C"]}, [O.Edit("modify", "A", "C"), O.Edit("delete", "B"), O.Edit("merge", "C", into="A")])
    assert out == {"Column": None, "A": "Column"} and d == {"r": ["A"]}
    f = O.fixed({"AColumn": None}, [O.Edit("add", "A", "Z"), O.Edit("add", "N", "A"), O.Edit("merge", "N", into="Q")])
    assert [(e.action, e.name, e.parent) for e in f] == [("modify", "AColumn", "Column"), ("add", "NColumn", "AColumn"), ("add", "QColumn", "Column")]


def test_metrics(spark):
    r = E.metrics(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query_id int, rank int")).first()
    assert (r["hit_at_1"], r["hit_at_5"], r["mrr"]) == pytest.approx((1 / 3, 2 / 3, 1.25 / 3))
    q = spark.createDataFrame([(1, "a", "x", "exact"), (1, "a", "y", "none"), (1, "b", "y", "none")], "query_id int, wanted string, found string, match string")
    assert tuple(E.constraint_quality(q).first())[1:] == (0.5, 0.5, "medium")
    assert E.hit_curve(spark.createDataFrame([("m", 1, 1)], "method string, query_id int, rank int"), ["method"]).count() == len(E.KS)


def test_sampling():
    assert S.tree_design(100) == {"leaf_capacity": 15, "clusters": 9, "depth": 1} and S.tree_levels(101) == [101, 11, 2, 1]
    assert S.allocation({"a": 90, "b": 9, "c": 1}, 20) == {"a": 18, "b": 1, "c": 1}
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.05, (10, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    label = S.lloyd(pts, 3)
    assert sorted(np.bincount(label)) == [10, 10, 10] and len({tuple(label[i * 10 : i * 10 + 10]) for i in range(3)}) == 3
    sim = np.exp(-((pts[:, None] - pts[None]) ** 2).sum(2))
    assert len(set(S.spectral(sim, 3).tolist())) == 3
    assert {i // 10 for i in S.dpp_greedy(list(range(30)), sim, 3)} == {0, 1, 2}
    assert len(set(S.dpp_sample(list(range(30)), sim, 3))) == 3


def test_profile(spark):
    tables = spark.createDataFrame([("t", ["a", "b", "a"])], "table_id string, columns array<string>")
    cells = spark.createDataFrame([("t", 0, 0, "x"), ("t", 0, 1, ""), ("t", 1, 0, "y"), ("t", 1, 1, " ")], "table_id string, row_index int, column_index int, value string")
    got = {r["column_index"]: r for r in P.summaries(tables, cells).collect()}
    assert got[2]["header"] == "a:2" and got[1]["null_count"] == 2 and got[0]["sample_values"] == ["x", "y"]
    v = P.with_virtual(cells, spark.createDataFrame([("t", 0, "v")], "table_id string, row_index int, value string"), spark.createDataFrame([("t", 2)], "table_id string, column_index int"))
    assert sorted(r["value"] for r in v.where("column_index = 2").collect()) == ["", "v"]
    row = spark.createDataFrame([("T", "", ["a", "", "b"], [["1", "2"], ["3", "4"]])], "t string, s string, c array<string>, r array<array<string>>")
    assert row.select(P.serialised_table(F.col("t"), F.col("s"), F.col("c"))).first()[0] == "T\nColumns: a, b"
    assert row.select(P.markdown(F.col("c"), F.col("r"))).first()[0].count("\n") == 3
    assert row.select(P.markdown(F.col("c"), F.col("r"), 11)).first()[0].count("\n") == 2
    rec = spark.createDataFrame([("t", "T", "", "a:7: x", "s", ["upo:Column", "Column"])], "table_id string, title string, description string, column_descriptions string, column_stats string, classes array<string>")
    r = P.retrieval_record(rec).first()
    assert (r["table_description"], r["column_descriptions"], r["column_types"], r["has_fallback_only"], r["num_cols"]) == ("T", "a: x", ["Column"], True, 2)
    names = spark.createDataFrame([('["a", "b"]', "x, null, ,y"), ('[{"name": "c"}]', "")], "a string, b string").select(P.parsed_names(F.col("a")), P.value_list(F.col("b"))).collect()
    assert [list(r[0]) for r in names] == [["a", "b"], ["c"]] and [list(r[1]) for r in names] == [["x", "y"], []]
    packs = P.packed(spark.createDataFrame([(1, i, "a b") for i in range(5)], "g int, o int, t string"), ["g"], "o", "t", 4).collect()
    assert [r["text"] for r in packs] == ["a b | a b", "a b | a b", "a b"]


def test_lake_round_trip(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "Foo_SEP_table_1.csv").write_bytes('a,b\n"x ""q""\ny",1\nz,\xff\n'.encode("latin-1"))
    (d / "Other.csv").write_text("c\n1\n2\n3\n")
    cells = lake.csv_cells(spark, str(d))
    cat = {r["table_id"]: r for r in lake.catalog_of(cells).collect()}
    assert cat["table_1"]["columns"] == ["a", "b"] and cat["table_1"]["row_count"] == 2 and cat["Other"]["row_count"] == 3 and cat["table_1"]["title"] == "Foo"
    assert [r["row"] for r in lake.table_rows(cells.where("row_index >= 0"), "table_1").orderBy("row_index").collect()] == [['x "q"\ny', "1"], ["z", "�"]]
    assert lake.csv_table(spark, str(d / "Foo_SEP_table_1.csv")).count() == 2
    u = tmp_path / "unified"
    u.mkdir()
    (u / "a.json").write_text(json.dumps({"table_id": "t1", "title": "T", "columns": ["a"], "rows": [["1"], [None]], "column_count": 1, "row_count": 2}, indent=1))
    (u / "b.json").write_text("{broken")
    tables = lake.unified_tables(spark, str(u))
    assert tables.count() == 1 and lake.broken_tables(spark, str(u)).count() == 1 and lake.unified_cells(tables).count() == 2
    n = tmp_path / "n.jsonl"
    n.write_text(json.dumps({"tableId": "n", "documentTitle": "D", "documentUrl": "u", "columns": [{"text": "a"}], "rows": [{"cells": [{"text": "1"}]}]}))
    assert lake.nested_tables(spark, str(n)).first()["rows"] == [["1"]]
    q = tmp_path / "q.jsonl"
    q.write_text("\n".join(json.dumps({"query_id": f"q{i}", "question": "?", "answer_tables": ["t1"], "split": "test"}) for i in range(5)))
    qs = lake.queries(spark, str(q))
    assert {r["split"]: r["count"] for r in lake.split_queries(qs, 2).groupBy("split").count().collect()} == {"train": 2, "test": 3}
    assert sinks.ingested(tables, qs).first()["split"] == "test" and sinks.query_relation(qs).first()["ground_truth_table_id"] == "t1"
    assert sinks.passages(qs).count() == 5 and lake.united_splits({"a": qs, "b": qs}).count() == 10


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "rel")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.replace(old, path)
    sinks.append(spark.createDataFrame([(3, "c")], "k int, v string"), path)
    sinks.upsert(spark, spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert sinks.deleted(old, F.col("v") == "a").count() == 1
    assert sorted(r["v"] for r in sinks.updated(old, F.col("k") == 1, {"v": F.lit("z")}).collect()) == ["b", "z"]
    sinks.json_lines(old, str(tmp_path / "j"))
    sinks.csv_file(old, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == lake.csv_table(spark, str(tmp_path / "c")).count() == 2
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id int, text string")
    R.build_index(docs, "doc_id", "text", str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() == 3
    onto = spark.createDataFrame([("d", "o_iter_1", "A"), ("d", "o_iter_2", "B"), ("e", "o_iter_9", "C")], "dataset string, ontology_id string, class string")
    assert [r["class"] for r in lake.ontology(onto, "d").collect()] == ["B"] and [r["class"] for r in lake.ontology(onto, "d", 1).collect()] == ["A"]
    assert sinks.manchester(spark.createDataFrame([("A", "B")], "class string, parent string")).first()["frame"] == "Class: A\n    SubClassOf: B"


def test_providers(spark):
    rows = spark.createDataFrame([("t", 0, "o_totalprice", ["1"])], "table_id string, column_index int, header string, sample_values array<string>")
    assert V.classified(rows, V.Rules()).first()["class"] == "PriceColumn"
    assert V.described(spark.createDataFrame([("t", "T", ["a"])], "table_id string, title string, columns array<string>"), V.Rules()).first()[1] == "T with 1 columns: a"
    e = V.embedded(spark.createDataFrame([(1, "a bc"), (2, None)], "i int, t string"), "i", "t", V.Rules()).collect()
    assert len(e[0]["embedding"]) == 64 and sum(e[1]["embedding"]) == 0
    with pytest.raises(RuntimeError):
        V.error_share(spark.range(30).select(F.lit("x").alias("error")))


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev = spark.sql("select id event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(id)) ts, double(id) value, 'a' event_type from range(10)")
    ev.write.parquet(src)
    run = lambda c: T.ingest(T.source(spark, ev.schema, src), out, str(tmp_path / c), "event_id").awaitTermination()
    run("c1")
    ev.withColumn("event_id", F.col("event_id") + 5).write.mode("append").parquet(src)
    run("c1")
    run("c2")  # a lost checkpoint: nothing twice
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("event_id").distinct().count() == 15
    q = T.tumbling(T.source(spark, ev.schema, src).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "5 minutes", "1 minute").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from tumbled").first()[0] == 20


def test_greedy_picks_take_every_item(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    np.fill_diagonal(sim, 1)
    want = S.dpp_greedy(list(range(60)), sim, 6)
    assert S.dpp_greedy_of(list(range(60)), v, 6) == want
    monkeypatch.setattr(S, "KERNEL", 10)
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "i long, v array<double>, c string")
    assert sorted(r["item"] for r in S.stratified_dpp(df, "i", "v", "c", 6).collect()) == sorted(want)


def test_kernel_queries_take_the_whole_table(spark):
    from tarn import queries as library

    sf = "/root/testdata/sf0.001"
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r["vec_id"]: r["cluster"] for r in library.QUERIES["spectral_clusters"](spark, sf).collect()}
    assert set(got) == set(labels)
    assert {labels[r["vec_id"]] for r in library.QUERIES["dpp_sample"](spark, sf).collect()} - {0, 1}


def test_least_cost_assignment_is_the_optimum():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(15):
        n, k, floor = int(rng.integers(4, 8)), int(rng.integers(2, 4)), float(rng.choice([0.0, 0.5, 1.0]))
        x, c = rng.normal(size=(n, 2)), rng.normal(size=(k, 2))
        d = np.linalg.norm(x[:, None] - c[None], axis=2)
        most, least = -(-n // k) + int(rng.integers(0, 2)), int(floor * n / k)
        best = min(sum(d[i, j] for i, j in enumerate(p)) for p in product(range(k), repeat=n) if all(least <= p.count(j) <= most for j in range(k)))
        got = S.least_cost(x, c, most, floor)
        size = np.bincount(got, minlength=k)
        assert size.max() <= most and size.min() >= least and d[np.arange(n), got].sum() == pytest.approx(best)


def test_run_helpers(spark, tmp_path):
    from datetime import datetime

    from tarn.plans import helpers as H

    assert H.run_id("d", "m", datetime(2024, 1, 2, 3, 4, 5), "bm25", None) == "d_m_bm25_20240102_030405"
    assert H.index_key(None) == "td_cd_cs" and H.index_key(" TD_cd_no_pc ") == "td_cd_no_pc" and H.sanitised("A b-c") == "a_b_c"
    with pytest.raises(ValueError):
        H.index_key("xx")
    assert H.missing(spark, [str(tmp_path), str(tmp_path / "no")], ("no_table",)) == [str(tmp_path / "no"), "no_table"]
    sims = spark.createDataFrame([(a, b, 1.0 if (a < 3) == (b < 3) else 0.01) for a in range(6) for b in range(a + 1, 6)], "i int, j int, sim double")
    clusters = H.query_clusters(sims, 2)
    assert len({frozenset(r["item"] for r in clusters.collect() if r["cluster"] == c) for c in (0, 1)} & {frozenset({0, 1, 2}), frozenset({3, 4, 5})}) == 2
    pairs = H.cluster_pairs(clusters, sims, 2).collect()
    assert len(pairs) == 4 and all((r["i"] < 3) == (r["j"] < 3) for r in pairs)
    (tmp_path / "b.json").write_text('[{"a": 1}]')
    assert lake.analyses(spark, str(tmp_path), ["a.json", "b.json"]).first()["a"] == 1
    with pytest.raises(FileNotFoundError):
        lake.analyses(spark, str(tmp_path), ["c.json"])


def test_calls_are_cached_tried_again_and_stopped(spark, tmp_path):
    marks, cache = tmp_path / "marks", str(tmp_path / "cache")
    marks.mkdir()

    def flaky(prompt):
        n = len(list(marks.glob(f"{prompt}-*")))
        (marks / f"{prompt}-{n}").touch()
        if n == 0:
            raise OSError("busy")
        return prompt * 2

    prompts = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    for _ in range(2):
        assert sorted((r["answer"], r["error"]) for r in V.called(prompts, "m", flaky, cache).collect()) == [("aa", None), ("bb", None)]
    assert len(list(marks.iterdir())) == 4  # two tries each, none the second time

    def down(prompt):
        raise OSError("down")

    with pytest.raises(Exception, match="one after another"):
        V.called(spark.range(40).selectExpr("cast(id as string) prompt").coalesce(1), "m", down, attempts=1).count()


def test_contracts_improve_by_feedback(spark):
    df = values(spark, ["1", "2", "x3", "4"], "string")
    seen = []

    def propose(feedback):
        seen.append(feedback)
        return [C.Contract("A", "p", r"x?\d" if "x3" in feedback and len(feedback) == 1 else r"\d", "x")]

    best, rate = C.improved(df, "x", "pos", propose)
    assert rate == 1.0 and best.pattern == r"x?\d" and seen == [["1", "2", "x3", "4"], ["x3"]]
    assert C.improved(df, "x", "pos", lambda f: [])[0] is None


def test_pair_similarities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = {int(i): rng.normal(size=5) for i in rng.choice(100, 20, replace=False)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "k int, v array<double>").repartition(3)
    got = {(r["i"], r["j"]): r["sim"] for r in S.pair_similarities(df, "k", "v").collect()}
    want = {(a, b): float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])) for a in v for b in v if a < b}
    assert got == pytest.approx(want) and S.pair_similarities(df.limit(0), "k", "v").count() == 0


def test_pair_similarities_shuffle_no_pairs(spark, monkeypatch):
    """Items are dealt a bounded number of times, and what another similarity adds needs no join of the pairs."""
    from tarn import queries as library

    monkeypatch.setattr(S, "BLOCK", 1)
    monkeypatch.setattr(S, "GROUPS", 4, raising=False)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "k int, v array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.pair_similarities(df, "k", "v")
        assert len(out.collect()) == 780
        nodes, dealt = [out._jdf.queryExecution().executedPlan()], []
        while nodes:
            p = nodes.pop()
            nodes += [p.children().apply(i) for i in range(p.children().size())]
            dealt += [p.metrics().get("shuffleRecordsWritten").get().value()] if p.nodeName().startswith("Exchange") else []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt and sum(dealt) <= 4 * 40
    plan = library.QUERIES["sim_hybrid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan


def test_pair_similarities_of_odd_rows_and_with_others(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "STRIP", 3, raising=False)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 0.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    said = lambda d: sorted((r["i"], r["j"], "none" if r["sim"] is None else f"{r['sim']:g}") for r in d.collect())
    cos = {(1, 2): ["0", "0.707107"], (1, 5): ["-1"], (2, 5): ["-0.707107", "0"]}
    want = [(i, j, s) for (i, j), x in cos.items() for s in x] + [(i, j, "none") for i, j in ((1, 3), (2, 3), (2, 3), (3, 4), (3, 5))] + [(i, j, "nan") for i, j in ((1, 4), (2, 4), (2, 4), (4, 5))]
    assert said(S.pair_similarities(df, "k", "v", digits=6)) == sorted(want)
    other = spark.createDataFrame([(2, 1, 1.0), (3, 5, 1.0), (7, 9, 1.0), (1, 5, None)], "i long, j long, sim double")
    cos = {(1, 2): ["0.75", "0.926777"], (1, 5): ["-0.25"], (2, 5): ["-0.176777", "0"], (7, 9): ["0.75"]}
    assert said(S.pair_similarities(df, "k", "v", digits=6, other=other, alpha=0.25)) == sorted([(i, j, s) for (i, j), x in cos.items() for s in x] + want[5:])


def test_pair_similarities_move_an_item_once(spark, monkeypatch):
    """Items are stored once, and what is dealt to tasks grows with the other's pairs alone."""
    monkeypatch.setattr(S, "BLOCK", 1)
    monkeypatch.setattr(S, "GROUPS", 4)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "k int, v array<double>")
    other = spark.createDataFrame([(1, 2, 1.0), (3, 30, 1.0)], "i long, j long, sim double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.pair_similarities(df, "k", "v", digits=6, other=other, alpha=0.25)
        got = {(r["i"], r["j"]): r["sim"] for r in out.collect()}
        nodes, dealt = [out._jdf.queryExecution().executedPlan()], 0
        while nodes:
            p = nodes.pop()
            nodes += [p.children().apply(i) for i in range(p.children().size())]
            dealt += p.metrics().get("shuffleRecordsWritten").get().value() if p.nodeName().startswith("Exchange") else 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt == 4 * 5 // 2 + 2
    cos = {(i, j): (1 + i * j) / np.sqrt((1 + i * i) * (1 + j * j)) for i in range(40) for j in range(i + 1, 40)}
    assert got == pytest.approx({k: 0.25 * c + 0.75 * (k in ((1, 2), (3, 30))) for k, c in cos.items()}, abs=5.1e-7)
    folder, counts = S._stored(df.selectExpr("cast(k as long) i", "v", "k % 3 g"), 3)
    assert counts == {0: 14, 1: 13, 2: 13}
    kept = pa.schema([("i", pa.int64()), ("v", pa.list_(pa.float64()))])
    assert [len(S._group(folder, g, counts.get(g, 0), kept)) for g in range(4)] == [14, 13, 13, 0]
    with pytest.raises(RuntimeError, match="13 of 14"):
        S._group(folder, 1, 14, kept)


def test_rounded_pairs_leave_in_order(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, v array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): (v[i] @ v[j] + 1) / 2 for i in range(30) for j in range(i + 1, 30)}
    sims = [r["sim"] for r in S.pair_similarities(df, "k", "v", True, 6).collect()]
    assert sims == sorted(sims) and len(sims) == 435
    monkeypatch.setattr(S, "STRIP", 40)  # several strips and runs, and two groups
    monkeypatch.setattr(S, "ORDERED", 100)
    monkeypatch.setattr(S, "BLOCK", 16)
    rows = S.pair_similarities(df, "k", "v", True, 6).collect()
    assert len(rows) == 435 and {(r["i"], r["j"]): r["sim"] for r in rows} == pytest.approx(want, abs=5.1e-7)


def test_determinantal_draw_of_more_items_than_a_kernel_has(spark, monkeypatch):
    from tarn import queries as library

    monkeypatch.setattr(S, "KERNEL", 10)
    picks = [r["vec_id"] for r in library.QUERIES["dpp_sample"](spark, "/root/testdata/sf0.001").collect()]
    assert len(set(picks)) == 10
    rng = np.random.default_rng(2)
    sets = rng.normal(size=(50, 3, 4))
    sets[0, 1] = sets[0, 0]
    sets /= np.linalg.norm(sets, axis=2, keepdims=True)
    want = [np.linalg.det(np.clip(x @ x.T, 0, 1) + 1e-6 * np.eye(3)) for x in sets]
    assert S.dpp_chances(sets) == pytest.approx(np.array(want), abs=1e-4) and S.dpp_chances(sets)[0] < 1e-5
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30, [0.0, 1.0]), (31, [0.0, 1.0]), (32, None), (33, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    for seed in range(3):
        a, b = sorted(S.dpp_items(df, "k", "v", 2, seed))
        assert a < 30 and b in (30, 31)
    assert sorted(S.dpp_items(df, "k", "v", 40)) == list(range(34)) and S.dpp_items(df.limit(0), "k", "v", 2) == []


def test_spectral_clusters_of_more_items_than_a_kernel_has(spark, monkeypatch):
    from tarn import queries as library

    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    ids, m = S.kernel(e, "vec_id", "embedding")
    want = S.spectral((m + 1) / 2, 4)
    monkeypatch.setattr(S, "KERNEL", 10)
    got = {r["vec_id"]: r["cluster"] for r in library.QUERIES["spectral_clusters"](spark, sf).collect()}
    assert sorted(got) == ids and len({(a, got[i]) for i, a in zip(ids, want, strict=True)}) == 4
    x = np.random.default_rng(4).normal(size=(60, 2))
    priced = S.least_cost(x, x[:3])
    monkeypatch.setattr(S, "KERNEL", 4000)
    d = np.linalg.norm(x[:, None] - x[None, :3], axis=2)
    assert np.bincount(priced).tolist() == [20] * 3 and d[np.arange(60), priced].sum() == pytest.approx(d[np.arange(60), S.least_cost(x, x[:3])].sum())
    odd = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(8)] + [(8, None), (9, [0.0, 0.0])], "k long, v array<double>")
    got = S.spectral_items(odd, "k", "v", 2).collect()
    assert sorted(r["k"] for r in got) == list(range(10)) and sorted(np.bincount([r["cluster"] for r in got])) == [5, 5]
    assert S.spectral_items(odd.limit(0), "k", "v", 2).count() == 0


def test_cluster_levels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * 0.1 + [10 * (i % 3), 0, 0]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    for most in (S.NODE, 30):  # the second: the root by the distributed fit
        monkeypatch.setattr(S, "NODE", most)
        got = {r["k"]: r["code"] for r in S.cluster_levels(df, "k", "v", 3, 20, 2).collect()}
        assert len(got) == 60 and {frozenset(i for i in got if got[i][:2] == c) for c in ("00", "01", "02")} == {frozenset(range(m, 60, 3)) for m in range(3)}
