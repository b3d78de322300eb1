import sentencepiece
from conftest import *  # noqa: F403
from test_dedup import alike, kept, shingles
from test_texts import contamination

import corpus_pipeline
from tarn.llm import langid, pieces


def test_stages_against_brute_force(spark, tmp_path, texts):
    rows, seen = [], set()
    for i, t, l in texts:
        if i is not None and i not in seen:
            rows.append((i, t, l))
            seen.add(i)
    items = [(1, words(103, 40)), (2, "a")]  # noqa: F405
    spark.createDataFrame([r[:5] for r in rows_of(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")  # noqa: F405
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fitted(docs)
    pred = {r["k"]: r for r in langid.predicted(docs, model).collect()}
    left = [r for r in rows if pred[r[0]]["lang_pred"] != "und" and pred[r[0]]["score"] >= corpus_pipeline.LEAST_SCORE]
    sets = {i: shingles(t) for i, t, _ in left}
    group = {i: i for i in sets}
    for i in sorted(sets):  # the smallest of each component
        todo = [i] if group[i] == i else []
        while todo:
            x = todo.pop()
            near = [j for j in sets if group[j] > i and alike(sets[x], sets[j]) >= 0.8]
            group.update(dict.fromkeys(near, i))
            todo += near
    assert not any(0.75 < alike(sets[i], sets[j]) < 0.83 for i in sets for j in sets if i < j)  # none that an estimate could miss
    left = [r for r in left if group[r[0]] == r[0]]
    shorter = kept(left, 20)
    left = [(i, shorter[i][2] if shorter[i][1] else t, l) for i, t, l in left if not shorter[i][1] or shorter[i][1] < shorter[i][0]]
    bad = contamination(left, items)
    left = {i: t for i, t, _ in left if not bad[i][1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left)
    for i, r in got.items():
        assert list(r["ids"]) == sp.encode(left[i]) and r["round_trip"] and r["n_chars"] == len(left[i])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_passages", "tokens"]


def test_columns_stay(spark, tmp_path, docs):
    spark.createDataFrame([(1, "of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_null_and_repeated_ids_with_different_texts_stay(spark, tmp_path):
    a, b, c, d, e = (words(900 + i, 90) for i in range(5))  # noqa: F405
    shared = words(950, 30)  # noqa: F405
    rows = [(None, a, "en"), (None, b, "en"), (None, b, "en"), (7, c, "en"), (7, d, "en"), (8, a, "en"), (9, e, "en"), (9, e, "en"), (10, d, "en")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)  # noqa: F405
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect())
    assert got == sorted([(0, a), (0, b), (7, c), (7, d), (9, e)])
    rows = [(None, f"{a} {shared}", "en"), (None, b, "en"), (7, f"{c} {shared}", "en"), (7, d, "en")]
    df = spark.createDataFrame(rows_of(rows), SCHEMA)  # noqa: F405
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, df, str(tmp_path)).collect()]
    own = [(n, t, l) for n, (_, t, l) in enumerate(rows)]
    orders = [kept(x, 20) for x in (own, [(3 - n, t, l) for n, t, l in own])]  # whichever of the two comes first
    wants = [[(i, x[n if o == 0 else 3 - n][2]) for n, (i, _, _) in enumerate(rows)] for o, x in enumerate(orders)]
    assert sorted(got, key=repr) in [sorted(w, key=repr) for w in wants] and wants[0] != wants[1]


def test_stages_on_empty_tables_and_texts(spark, tmp_path, nothing, docs):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == [], name
    none = docs.where("doc_id in (160, 161, 162)")
    assert none.count() == 3
    counts = [stage(spark, none, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [0, 1, 3, 3, 3]  # no letter; all alike; nothing repeats; no window; no pieces


def test_stages_on_null_and_repeated_rows(spark, tmp_path, docs, texts):
    """Every stage on the whole fixture, null and repeated ids included: rows only go by the stage's own rule."""
    spark.createDataFrame([(1, words(103, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")  # noqa: F405
    bad = contamination(texts, [(1, words(103, 40))])  # noqa: F405
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect())
    assert got == sorted((i or -1, t or "") for i, t, _ in texts if not bad[i if i is not None else langid.scan.NO_KEY][1])
    rows = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)


def test_run_leaves_only_its_result(spark, tmp_path, texts):
    import os

    spark.createDataFrame([r[:5] for r in rows_of(texts[:20])], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")  # noqa: F405
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    path = out.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert out.count() > 0 and os.listdir(os.path.dirname(os.path.dirname(path))) == ["4-tokens"]
