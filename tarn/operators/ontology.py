"""Class hierarchy: closure, nearest properties, document frequencies, structural scores, votes, edits.

Classes are (class, parent) rows, one per parent; a root has a null parent.
The closure (anc, desc, dist) has the smallest distance over all paths and every
class with itself at 0. It is made by joining paths with paths until nothing is
new, so a hierarchy of depth d takes log2(d) rounds and cycles end by themselves;
functions that need it take it as ``closed`` if it is there already. Tables and
mappings are joined and aggregated, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.sources import storage

ROOT, ABOX_BOOST = "Column", 1.5


def strict_closure(classes: DataFrame) -> DataFrame:
    """anc, desc, dist of every path of one step or more; a class on a cycle is its own ancestor."""
    edges = classes.where("class is not null and parent is not null")
    found = _kept(edges.select(X.strip_prefix(F.col("parent")).alias("anc"), X.strip_prefix(F.col("class")).alias("desc"), F.lit(1).alias("dist")).distinct())
    size, same = found.agg(F.count("*"), F.sum("dist")).first(), False
    while not same and size[0]:
        up = found.select(F.col("anc").alias("top"), F.col("desc").alias("anc"), F.col("dist").alias("more"))
        longer = found.join(up, "anc").select(F.col("top").alias("anc"), "desc", (F.col("dist") + F.col("more")).alias("dist"))
        found = _kept(found.unionByName(longer).groupBy("anc", "desc").agg(F.min("dist").alias("dist")))
        before, size = size, found.agg(F.count("*"), F.sum("dist")).first()
        same = before == size  # pairs only come and distances only fall
    return found


def closure(classes: DataFrame) -> DataFrame:
    """anc, desc, dist over all parents, every class with itself at 0."""
    own = classes.where("class is not null").select(X.strip_prefix(F.col("class")).alias("anc")).distinct()
    own = own.select("anc", F.col("anc").alias("desc"), F.lit(0).alias("dist"))
    return _kept(strict_closure(classes).where("anc <> desc").unionByName(own))


def _kept(df: DataFrame) -> DataFrame:
    """The rows, computed once: written to the session's checkpoint folder."""
    return storage.checkpointed(df)


def depths(closed: DataFrame) -> DataFrame:
    """Depth of each class: its largest distance to an ancestor."""
    return closed.groupBy(F.col("desc").alias("class")).agg(F.max("dist").alias("depth"))


def paths(closed: DataFrame) -> DataFrame:
    """The path from the root to each class as a string."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), F.col("anc"))))
    return closed.groupBy(F.col("desc").alias("class")).agg(F.array_join(F.transform(steps, lambda s: s["anc"]), " > ").alias("path"))


def cycles(classes: DataFrame) -> DataFrame:
    """Classes that are their own ancestor."""
    return strict_closure(classes).where("anc = desc").select(F.col("desc").alias("class"))


def nearest_properties(classes: DataFrame, properties: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """class, property: of the properties (property, domain, parent) whose domain is the class or an ancestor those at the
    smallest distance, without ancestors of other kept ones."""
    reach = (closed or closure(classes)).join(properties.select("property", "domain"), F.col("anc") == F.col("domain"))
    kept = reach.withColumn("r", F.rank().over(Window.partitionBy("desc").orderBy("dist"))).where("r = 1").select(F.col("desc").alias("class"), "property").distinct()
    above = strict_closure(properties.select(F.col("property").alias("class"), F.col("parent"))).where("anc <> desc")
    covered = kept.join(above, kept["property"] == above["desc"]).select("class", F.col("anc").alias("property")).distinct()
    return kept.join(covered, ["class", "property"], "left_anti")


def class_ranges(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """The range of the first property (by name) whose domain is the class."""
    return properties.groupBy(F.col("domain").alias("class")).agg(F.min_by("range", "property").alias("range")).join(classes.select("class").distinct(), "class", "left_semi")


def class_frequencies(classes: DataFrame, mappings: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """class, df (tables with the class or a descendant), n (tables), idf = ln((n + 1) / (df + 1))."""
    pairs = mappings.select("table_id", X.strip_prefix(F.col("class")).alias("desc")).distinct()
    n = pairs.agg(F.count_distinct("table_id").alias("n"))
    closed = closed or closure(classes)
    df = pairs.join(closed, "desc").groupBy(F.col("anc").alias("class")).agg(F.count_distinct("table_id").alias("df"))
    every = classes.select(X.strip_prefix(F.col("class")).alias("class")).distinct()
    return every.join(df, "class", "left").fillna(0, ["df"]).join(F.broadcast(n)).select("class", "df", "n", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def _shared(closed: DataFrame, idf: DataFrame, mappings: DataFrame, constraints: DataFrame) -> DataFrame:
    """query_id, cid, value, table_id, class (ancestor that a constraint and a table share), idf, depth, need (idf of the
    required class). An equi-join of two closures: tables that share nothing don't occur."""
    of_table = mappings.select("table_id", X.strip_prefix(F.col("class")).alias("desc")).distinct().join(closed, "desc").select("table_id", F.col("anc").alias("class")).distinct()
    wanted = constraints.select("query_id", "cid", X.strip_prefix(F.col("class")).alias("desc"), "value")
    of_query = wanted.join(closed, "desc").select("query_id", "cid", "value", F.col("desc").alias("required"), F.col("anc").alias("class")).distinct()
    need = idf.select(F.col("class").alias("required"), F.col("idf").alias("need"))
    return of_query.join(of_table, "class").join(idf, "class").join(depths(closed), "class").join(need, "required", "left")


def _per_query(constraints: DataFrame) -> DataFrame:
    return constraints.groupBy("query_id").agg(F.count("*").alias("n"))


def score_plain(classes: DataFrame, mappings: DataFrame, constraints: DataFrame) -> DataFrame:
    """query_id, doc_id, score: of each constraint the idf of the deepest shared class (with a value: the largest idf of
    a shared class), averaged over all constraints; scores above 0."""
    closed = closure(classes)
    s = _shared(closed, class_frequencies(classes, mappings, closed).select("class", "idf"), mappings, constraints)
    deepest = F.max_by("idf", F.struct("depth", "idf"))
    one = s.groupBy("query_id", "cid", "table_id").agg(F.when(F.first("value").isNull(), deepest).otherwise(F.max("idf")).alias("s"))
    total = one.groupBy("query_id", "table_id").agg(F.sum("s").alias("s")).join(_per_query(constraints), "query_id")
    return total.select("query_id", F.col("table_id").alias("doc_id"), (F.col("s") / F.col("n")).alias("score")).where(F.round("score", 12) > 0)


def score_weighted(classes: DataFrame, mappings: DataFrame, constraints: DataFrame) -> DataFrame:
    """query_id, doc_id, score: of each constraint the share of the required class's idf that the deepest shared class
    has (0 to 1), weighted by that idf, 1.5 times with a value; scores above 0."""
    closed = closure(classes)
    idf = _kept(class_frequencies(classes, mappings, closed).select("class", "idf"))
    s = _shared(closed, idf, mappings, constraints)
    one = s.groupBy("query_id", "cid", "table_id").agg(F.max_by("idf", F.struct("depth", "idf")).alias("idf"), F.first("need").alias("need"))
    ratio = F.when(F.col("need") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("idf") / F.col("need")))).otherwise(0.0)
    names = idf.select(F.col("class").alias("required"), "idf")
    weights = constraints.withColumn("required", X.strip_prefix(F.col("class"))).join(names, "required", "left")
    weights = weights.select("query_id", "cid", (F.coalesce("idf", F.lit(0.0)) * F.when(F.col("value").isNotNull(), ABOX_BOOST).otherwise(1.0)).alias("w"))
    total = weights.groupBy("query_id").agg(F.sum("w").alias("total"))
    scored = one.withColumn("s", ratio).join(weights, ["query_id", "cid"]).groupBy("query_id", "table_id").agg(F.sum(F.col("s") * F.col("w")).alias("s")).join(total, "query_id")
    return scored.select("query_id", F.col("table_id").alias("doc_id"), F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(0.0).alias("score")).where(F.round("score", 12) > 0)


def value_matches(cells: DataFrame, mappings: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints whose value occurs in a column of their class: query_id, cid, table_id, n (cells). Cells join on the
    value, lower-cased."""
    wanted = constraints.where("value is not null").select("query_id", "cid", F.col("class").alias("class"), F.lower(F.btrim("value")).alias("v"))
    typed = cells.join(mappings.select("table_id", "column_index", "class"), ["table_id", "column_index"]).select("table_id", "class", F.lower(F.btrim("value")).alias("v"))
    return typed.join(wanted, ["class", "v"]).groupBy("query_id", "cid", "table_id").agg(F.count("*").alias("n"))


def class_matches(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """How a found class relates to a wanted one: exact, subclass, superclass or none."""
    c = closure(classes).where("dist > 0").select("anc", "desc").withColumn("hit", F.lit(True))
    down = c.select(F.col("anc").alias("wanted"), F.col("desc").alias("found"), F.col("hit").alias("sub"))
    up = c.select(F.col("desc").alias("wanted"), F.col("anc").alias("found"), F.col("hit").alias("super"))
    both = pairs.join(down, ["wanted", "found"], "left").join(up, ["wanted", "found"], "left")
    return both.select("wanted", "found", F.when(F.col("wanted") == F.col("found"), "exact").when(F.col("sub"), "subclass").when(F.col("super"), "superclass").otherwise("none").alias("match"))


# -- votes -----------------------------------------------------------------------------------------------------------


def vote_summary(votes: DataFrame, groups: int) -> DataFrame:
    """By class over (group, class, vote): coverage (missing votes are 0), positives and who gave them."""
    positive = F.col("vote") > 0
    return votes.groupBy("class").agg((F.sum("vote") / groups).alias("coverage"), F.count_if(positive).alias("positives"), F.array_sort(F.collect_set(F.when(positive, F.col("group")))).alias("groups"))


def iteration_metrics(coverage: DataFrame) -> DataFrame:
    """By iteration over (iteration, class, coverage): mean, share above one half, and the change since the one before."""
    m = coverage.groupBy("iteration").agg(F.avg("coverage").alias("mean"), (F.count_if(F.col("coverage") > 0.5) / F.count("*")).alias("covered"), F.count("*").alias("classes"))
    return m.withColumn("delta", F.abs(F.col("mean") - F.lag("mean").over(Window.orderBy("iteration"))))


def latest(rows: DataFrame, by: list[str], order: str = "version") -> DataFrame:
    """The newest row of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# -- names -----------------------------------------------------------------------------------------------------------


def repaired(names: DataFrame, classes: DataFrame) -> DataFrame:
    """name, class: the class of that name, or the one that shares most words with it (first by name on ties)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(X.camel_words(c)), r"[\s_]+"), lambda w: w != ""))
    n = names.select("name", X.strip_prefix(F.col("name")).alias("plain"))
    known = classes.select(F.col("class").alias("c")).distinct()
    exact = n.join(known, n["plain"] == known["c"]).select("name", F.col("c").alias("class"))
    word = known.select("c", F.explode(words(F.col("c"))).alias("w"))
    fuzzy = n.join(exact, "name", "left_anti").select("name", F.explode(words(F.col("plain"))).alias("w")).join(word, "w").groupBy("name", "c").agg(F.count("*").alias("k"))
    best = fuzzy.groupBy("name").agg(F.min_by("c", F.struct(-F.col("k"), "c")).alias("class"))
    return exact.unionByName(best)


def definition(parts: Column) -> Column:
    """A conjunction as text."""
    return F.array_join(parts, " ⊓ ")


# -- edits (driver: hundreds of rows) --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Edit:
    action: str  # add, modify, delete, merge
    name: str
    parent: str | None = None
    into: str | None = None


def makes_cycle(parents: dict[str, str | None], child: str, parent: str | None) -> bool:
    """Whether giving child that parent closes a cycle; the root is always allowed."""
    seen = set()
    while parent is not None and parent != ROOT and parent not in seen:
        if parent == child:
            return True
        seen.add(parent)
        parent = parents.get(parent)
    return False


def fixed(parents: dict[str, str | None], edits: list[Edit]) -> list[Edit]:
    """Names end in "Column", unknown parents become the root, adding what exists modifies it, merging into what does not
    exist adds it."""
    suffix = lambda s: s if s is None or s.endswith("Column") else f"{s}Column"
    known = set(parents)
    out = []
    for e in edits:
        e = replace(e, name=suffix(e.name), parent=suffix(e.parent), into=suffix(e.into))
        if e.action in ("add", "modify") and e.parent not in known | {ROOT}:
            e = replace(e, parent=ROOT)
        if e.action == "add" and e.name in known:
            e = replace(e, action="modify")
        if e.action == "merge" and e.into not in known:
            e = Edit("add", e.into or e.name, ROOT)
        known |= {e.name} if e.action == "add" else set()
        out.append(e)
    return out


def edited(parents: dict[str, str | None], domains: dict[str, list[str]], edits: list[Edit]) -> tuple[dict[str, str | None], dict[str, list[str]]]:
    """The hierarchy and the properties' domains after the edits, in order. Children of a deleted class go to its parent;
    a merged one's children and properties go to its target; edits that close a cycle are left out."""
    parents, domains = dict(parents), {k: list(v) for k, v in domains.items()}
    for e in edits:
        if e.action in ("add", "modify"):
            if not makes_cycle(parents, e.name, e.parent) and (e.action == "add" or e.name in parents):
                parents[e.name] = e.parent
            continue
        if e.name not in parents or e.action == "merge" and (e.into not in parents or makes_cycle(parents, e.name, e.into) or e.into == e.name):
            continue
        heir = parents.pop(e.name) if e.action == "delete" else e.into
        if e.action == "merge":
            parents.pop(e.name)
        for c, p in parents.items():
            if p == e.name:
                parents[c] = heir
        for p, d in list(domains.items()):
            if e.name in d:
                d = [x for x in d if x != e.name] + ([heir] if e.action == "merge" and heir not in d else [])
                if d:
                    domains[p] = d
                else:
                    del domains[p]
    return parents, domains


def tree_text(classes: DataFrame, most: int | None = None) -> DataFrame:
    """line, n: the hierarchy as indented lines, children sorted by name, from the classes without a parent down. A class
    that is met again below itself is marked and not followed. With ``most`` only so many lines, and one that says how
    many are left out."""
    edges = _kept(classes.select("class", "parent").distinct())
    level = _kept(edges.where("parent is null").select("class", F.array("class").alias("path"), F.lit(False).alias("again")))
    every = level
    while level.take(1):
        down = level.where("not again").join(edges.select(F.col("class").alias("child"), F.col("parent").alias("class")), "class")
        level = _kept(down.select(F.col("child").alias("class"), F.concat("path", F.array("child")).alias("path"), F.array_contains("path", F.col("child")).alias("again")))
        every = every.unionByName(level)
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.col("class"), F.when(F.col("again"), " (cycle)").otherwise(""))
    out = every.select(F.row_number().over(Window.orderBy("path")).alias("n"), line.alias("line"))
    if most is None:
        return out
    total = every.count()
    rest = edges.sparkSession.createDataFrame([(most + 1, f"... ({total - most} more)")] if total > most else [], "n int, line string")
    return out.where(F.col("n") <= most).unionByName(rest)
