"""The pipeline stage by stage against brute force, and the registered queries."""

import re

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import language_id
from tidewatch.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = [(r.doc_id, r.text, r.source) for r in table.limit(80).collect()]
    extra = [(5000 + i, f"Same line everywhere\n{t}\nlast line {i}", s) for i, t, s in base[:20]]
    extra += [(6000, None, "a"), (6001, "123 --- 456", "a"), (6002, "", None), (6003, 'my password = "abcdef123456" here and no more', "b")]
    full = docs(spark, [(r.doc_id, r.text, r.source) for r in table.collect()] + extra)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]

    first = stages["language_id"](spark, full, "")
    assert first.columns == COLUMNS
    rows = [(r.doc_id, r.text, r.source) for r in first.collect()]
    assert {i for i, _, _ in rows}.isdisjoint({6000, 6001, 6002}) and len(rows) >= full.count() - 5

    second = stages["line_dedup"](spark, first, "")
    wanted = {i: n for i, _, n, _ in brute.dedup_lines([r[:2] for r in rows])}
    texts = by_id(second)
    assert second.columns == COLUMNS
    assert all(len(t.split("\n")) == len((dict((r[0], r[1]) for r in rows)[i] or "").split("\n")) - wanted[i] or not t for i, t in texts.items())

    third = stages["ngram_jaccard_join"](spark, second, "")
    kept = {i for i, _, c in brute.components(sorted(texts.items())) if i == c}
    assert set(by_id(third)) == kept

    fourth = stages["secret_scan"](spark, third, "")
    for i, t in by_id(fourth).items():
        spans = [s.split(":") for s in brute.secrets([(i, texts[i], "o")])[0][5].split(",") if s]
        clean = texts[i]
        for _, a, b in sorted(spans, key=lambda s: -int(s[1])):
            clean = clean[: int(a)] + "[SECRET]" + clean[int(b) :]
        assert t == clean or len(spans) > 1
    assert "abcdef123456" not in by_id(fourth)[6003]
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    packed = stages["best_fit_packing"](spark, fourth, "").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(brute.words(t)) for i, t in by_id(fourth).items()}


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "bin" in out.columns


def test_language_of_held_out_texts(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = language_id.language_report(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in report if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in report)
    odd = docs(spark, [(None, None, "a"), (1, "", "a"), (2, "12 %%", "a"), (2, "the and of that", None)])
    assert [r.lang_pred for r in language_id.language_report(odd).collect()][:3] == ["und"] * 3
    assert language_id.language_report(odd.limit(0)).count() == 0
    assert language_id.with_language(odd).columns == [*odd.columns, "lang_pred", "lang_score"]


def test_numbered_queries():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score int, line_dedup string, row string, kept string, spans string"


def clashing(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "p", 1, "d", "r", "k", "s") for i, t, s in rows]
    return spark.createDataFrame(full, CLASHING)


def test_stages_on_clashing_names_repeated_rows_and_empty_tables(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = [(r.doc_id, r.text, r.source) for r in table.limit(40).collect()]
    rows = base + base[:10] + [(None, None, None), (None, base[0][1], None), (7001, "", "a"), (7002, None, "a")]
    docs = clashing(spark, rows)
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.where("lang_pred <> 'p' OR lang_score <> 1 OR line_dedup <> 'd' OR row <> 'r' OR kept <> 'k' OR spans <> 's'").count() == 0
    # Nothing without a letter goes on, and rows that repeat are rows of their own.
    assert counts[0] >= 50 - 3 and counts[1] == counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    docs = clashing(spark, rows).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_a_run_leaves_only_its_result(spark):
    import os

    from tidewatch.llm import tables
    from tidewatch.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    # Checkpoints bear the names of Spark's RDDs and go with them.
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if not n.startswith("rdd-")}
    assert left == {"best_fit_packing"} and out.count() > 100 and not tables._open


def test_every_language_is_learned(spark):
    """300 labels: each gives fewer rows, none is left out of the sample; repeated rows and very long texts are no case of their own."""
    rows = [(i, f"text number {i} of label", f"l{i % 300}") for i in range(3000)] + [(5, "again", "l5")] * 50 + [(9999, "word " * 60000, "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language_id._sampled(docs, 4)
    per = {r["l"]: r["n"] for r in chosen.groupBy("l").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    assert len(per) > 280 and max(per.values()) <= 12
    assert language_id._sampled(docs, 2000).select("l").distinct().count() == 300
    few = docs.where("lang in ('l1', 'l2')").replace({"l1": "en", "l2": "de"}, subset=["lang"])
    report = {(r.doc_id, r.lang_pred) for r in language_id.language_report(few.unionByName(few)).collect()}
    assert {i for i, _ in report} == {r.doc_id for r in few.collect()} and len(report) == len({i for i, _ in report})


def test_texts_go_to_python_once_and_do_not_come_back(spark):
    table = docs(spark, [(1, "the and of that", "a"), (2, "der und das", "b")])
    found = corpus_pipeline.identify_language(spark, table, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert found.count() == 2
