import json
import os

import pytest
from pyspark.sql import functions as F

from quillmetry import constants as C
from quillmetry.operators import distill, ordering, prep, reports, views
from quillmetry.sources import readers, sinks
from quillmetry.streaming import documents


def test_numbered(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert sorted((r.v, r.row_no) for r in ordering.numbered(df, "v").collect()) == [(i, i) for i in range(1000)]
    keyed = df.withColumn("k", F.when(F.col("v") < 600, "hot").when(F.col("v") < 601, None).otherwise("cold"))
    rows = ordering.ranked_within(keyed, "k", "v").collect()
    assert sorted(r["rank"] for r in rows if r.k == "hot") == list(range(600)) and {r.group_size for r in rows if r.k is None} == {1}
    assert ordering.numbered(df.limit(0), "v").count() == 0


def test_summary_and_outliers(spark):
    long = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 100])] + [(1, "b", 3.0), (2, "b", None), (3, "b", float("nan"))], "doc_id int, feature string, value double")
    got = {r.feature: r for r in reports.summary_stats(long).collect()}
    a = got["a"]
    assert (a.n, a.q1, a.q3, a.median, a.iqr) == (9, 3.0, 7.0, 5.0, 4.0) and got["b"].stdev == 0 and got["b"].q3 == 3.0
    assert [(r.value, r.side) for r in reports.outliers(long).collect()] == [(100.0, "HIGH")]
    assert {r.feature: r.nulls for r in reports.null_counts(long).collect()} == {"a": 0, "b": 1}


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, 2.0)], "a double, b double, c double, d double")
    got = {(r.a, r.b): r.r for r in reports.correlations(df, [("a", "b"), ("a", "c"), ("a", "d")]).collect()}
    assert got[("a", "b")] == pytest.approx(1) and got[("a", "c")] is None and got[("a", "d")] is None


def test_histogram_latency_range(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.95, 1.0, 7.0, -1.0, None)], "difficulty double")
    assert {r.bucket: r.n for r in reports.histogram(df, "difficulty").collect()} == {0: 3, 9: 3}
    calls = spark.createDataFrame([(float(i), i % 4 > 0) for i in range(20)], "ms double, ok boolean")
    r = reports.latency_report(calls, "ms", "ok").first()
    assert (r.p50, r.p95, r.max, r.success) == (10.0, 19.0, 19.0, 0.75)
    long = spark.createDataFrame([("hapax_ratio", v) for v in (0.0, 0.1, 0.2, 0.3)], "feature string, value double")
    r = reports.range_fitness(long).first()
    assert (r.below, r.inside, r.above, r.verdict) == (2, 2, 0, "widen")


def test_prep(spark):
    good = "זה משפט ראשון די ארוך. זה משפט שני אחר לגמרי. וזה המשפט השלישי של הטקסט הזה. " * 1
    texts = [(1, good * 3), (2, "קצר"), (3, None), (4, "a. " * 200), (5, good + good.replace("ראשון", "אחרון") + good.replace("שני", "רביעי") + "ו" * 60)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: r.reason for r in prep.quality_gate(df).collect()}
    assert got[1] == "repetitive" and got[2] == got[3] == "too_short" and got[4] == "low_hebrew"
    lines = spark.createDataFrame([(i, f" line {i} " if i % 5 else "  ") for i in range(23)], "no int, line string")
    groups = sorted((r.doc, r.n_lines) for r in prep.fixed_size_groups(lines, 7, "no").collect())
    assert groups == [("doc_0000001", 7), ("doc_0000002", 7), ("doc_0000003", 4)]
    named = [(r.no, r["name"]) for r in prep.skip_take(lines, "no", skip=2, take=2).collect()]
    assert sorted(named) == [(2, "doc_0000001"), (3, "doc_0000002")]
    assert {r.no for r in prep.unfinished(lines, lines.where("no < 20"), "no").collect()} == {20, 21, 22}


def record(**changed):
    base = {"scores": {}, "issues": {}, "diagnoses": {}}
    return base | changed


def test_labels(spark):
    rows = [(1, {"difficulty": 0.5}, {"fragmentation": 2.0}, {}, [0.1, 5.0, None], [0.3]), (2, {}, {}, {"low_cohesion": 1.0}, None, [])]
    df = spark.createDataFrame(rows, "record_id int, scores map<string,double>, issues map<string,double>, diagnoses map<string,double>, sentence_complexities array<double>, cohesion_pairs array<double>")
    stats = {(r.kind, r.key): r for r in distill.label_stats(df, "record_id").collect()}
    assert len(stats) == 30 and stats["issues", "fragmentation"].mean == 1.0 and stats["issues", "fragmentation"].active == 0.5
    fitted = {r.record_id: r for r in distill.trained_labels(df, F.lit(4)).collect()}
    assert fitted[1].sentence_complexities == [0.1, 1.0, 0.0, 0.0] and fitted[1].cohesion_pairs == [0.3, 0.0, 0.0] and fitted[1].issues == {"fragmentation": 1.0} and fitted[2].sentence_complexities == [0.0] * 4
    named = {r.record_id: r for r in distill.named_predictions(df.withColumn("sentence_complexities", F.coalesce("sentence_complexities", F.array().cast("array<double>")))).collect()}
    assert [(x["index"], x.severity) for x in named[1].sentence_list] == [(1, 5.0)] and named[1].named_issues["sentence_complexity"] == 5.0 and "sentence_complexity" not in named[2].named_issues


def test_sentence_labels(spark):
    rows = [(1, "sentence_complexity", 0.4, [1]), (1, "weak_cohesion", 0.6, [0, 1]), (1, "fragmentation", 0.9, [0, 3])]
    table = spark.createDataFrame(rows, "doc_id int, type string, severity double, span array<int>")
    counts = spark.createDataFrame([(1, 3), (2, 0), (3, 1)], "doc_id int, n int")
    got = {r.doc_id: (r.sentence_complexities, r.cohesion_pairs) for r in distill.sentence_labels(table, counts, "doc_id").collect()}
    assert got == {1: ([0.0, 0.4, 0.0], [0.6, 0.0]), 2: ([], []), 3: ([0.0], [])}


def test_merge_split_and_lines(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "line long, text string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (3, "")], "line long, text string")
    got = {r.text: (r.line, r.added) for r in distill.merged_last_wins(base, new, "text", "line").collect()}
    assert got == {"a": (3, False), "b": (1, False), "c": (2, True), "": (3, False)}
    parts = [r.part for r in distill.split_exact(spark.range(25), "id", 0.1, 7).collect()]
    assert parts.count("val") == 2 and len(parts) == 25
    assert [r.part for r in distill.split_exact(spark.range(1), "id", 0.1, 7).collect()] == ["val"]
    assert distill.by_line(base, new, "line").count() == 3


def test_metrics(spark):
    rows = [(i, "issues", "fragmentation", p, t) for i, (p, t) in enumerate([(0.9, 1.0), (0.8, 0.0), (0.1, 0.7), (0.2, 0.1)])]
    pairs = spark.createDataFrame(rows, "id int, kind string, key string, predicted double, label double")
    assert distill.f1_per_type(pairs).first().f1 == 0.5
    assert distill.spearman(pairs, "id").first().rho == pytest.approx(1 - 6 * (0 + 4 + 4 + 0) / 60)
    assert distill.rmse(pairs).first().rmse == pytest.approx(((0.01 + 0.64 + 0.36 + 0.01) / 4) ** 0.5)
    assert distill.disagreements(pairs, "id").where("differs").count() == 2


def test_routing(spark):
    row = lambda i, v: (i, {k: v for k in C.DIAGNOSIS_KEYS})
    model = spark.createDataFrame([row(1, 0.9), row(2, 0.1)], "id int, diagnoses map<string,double>")
    rest = spark.createDataFrame([row(1, 0.5), row(2, 0.6)], "id int, diagnoses map<string,double>")
    got = {r.id: (r.origin, r.diagnoses["low_cohesion"]) for r in distill.routed(model, rest, "id").collect()}
    assert got == {1: ("model", 0.9), 2: ("pipeline", 0.6)}


def test_views(spark):
    one = spark.createDataFrame([({"a": 0.9, "b": 0.5, "c": 0.1}, {"a": 0.2, "b": 0.6, "c": 0.46})], "x map<string,double>, y map<string,double>")
    changes = one.select(views.diagnosis_changes(F.col("x"), F.col("y")).alias("d")).first().d
    assert (changes.resolved, changes.new) == (["a"], ["c"])
    text = spark.range(1).select(views.rewritten(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("XY!")).alias("t"), views.prompt(F.lit("t"), F.array(F.lit("one"), F.lit("two"))).alias("p")).first()
    assert text.t == "abXY!ef" and "- one\n- two" in text.p
    old = spark.createDataFrame([(1, 0.5, 3)], "id int, a double, b int")
    new = spark.createDataFrame([(1, None, 5)], "id int, a double, b int")
    assert tuple(views.updated_config(old, new, "id").first()) == (1, 0.5, 5)
    named, unknown = views.localised(old, spark.createDataFrame([(2, "x")], "id int, name string"), "id")
    assert named.count() == 0 and unknown.count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("שלום\n\n world ", encoding="utf-8")
    (tmp_path / "t/b.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "t/c.md").write_text("no")
    got = {r.doc_id: (r.text, r.error) for r in readers.text_directory(spark, str(tmp_path / "t")).collect()}
    assert got == {"a": ("שלום\n\n world ", None), "b": (None, "EncodingError")}
    assert [r.line for r in readers.line_corpus(spark, str(tmp_path / "t/a.txt")).orderBy("line_no").collect()] == ["שלום", "world"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json").write_text(json.dumps({"text": "a", "n": 1}))
    (tmp_path / "j/y.json").write_text("{broken")
    (tmp_path / "j/feature_stats.json").write_text("{}")
    good, bad = readers.json_directory(spark, str(tmp_path / "j"), "text string, n int")
    assert [r.text for r in good.collect()] == ["a"] and [r.file_name for r in bad.collect()] == ["y.json"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": null}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("line_no").collect()] == [1, None]
    (tmp_path / "d.json").write_text('{"x": 3, "y": 1}')
    assert {r.token: r.cnt for r in readers.frequency_dictionary(spark, str(tmp_path / "d.json")).collect()} == {"x": 3, "y": 1}
    (tmp_path / "e.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        readers.frequency_dictionary(spark, str(tmp_path / "e.json")).collect()
    kept, dropped = readers.validated(spark.createDataFrame([("a", 1), (None, 2)], "text string, n int"), ("text",))
    assert kept.count() == dropped.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ש", None)], "a string, b int")
    sinks.json_lines(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first().value == '{"a":"ש","b":null}'
    stats = spark.createDataFrame([("f", 1.0, 2.0, 0.0, 3.0, 0.1, 0.2, 0.3, 0.4, 0.5, 9, True, False)], "feature string, mean double, std double, min double, max double, p10 double, p25 double, p50 double, p75 double, p90 double, valid_count long, unstable boolean, degenerate boolean")
    sinks.feature_stats(stats, str(tmp_path / "s"))
    assert readers.feature_stats(spark, str(tmp_path / "s")).collect() == stats.collect()


def test_parsers(spark):
    raw = ["1\tהוא\tהוא\tPRP\tPRP\tgen=M|num=S\t2\tsubj", "2\tהלך\tהלך\tVB\tVB\t_\t0\tROOT", "", "", "1\tכן\tכן\tRB\tRB\t_\t0\tROOT", "short\tline"]
    lines = spark.createDataFrame([(1, i, r) for i, r in enumerate(raw)], "doc int, line_no int, raw string")
    nodes = [(r.sent_idx, r.id, r.head, r.features) for r in readers.conll(lines, "doc").orderBy("line_no").collect()]
    assert nodes == [(0, 1, 2, {"gen": "M", "num": "S"}), (0, 2, 0, {}), (1, 1, 0, {})]
    edges = spark.createDataFrame([(1, f"0\t1\ta\ta\tN\tN\t_\t{i}") for i in (1, 1, 3)] + [(1, "x")], "doc int, raw string")
    assert sorted((r.token_id, r.ambiguity) for r in readers.ambiguity(readers.lattice(edges, "doc"), "doc").collect()) == [(1, 2), (2, 1), (3, 1)]


def test_stream(spark, tmp_path):
    from quillmetry.operators import baseline, features, frames

    docs = spark.createDataFrame([(i, f"One two {i}. Three four five.") for i in range(6)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    wide = features.document_features(frames.analysed(docs), "doc_id")
    stats = baseline.feature_stats(baseline.long_features(wide, "doc_id"))
    stream = documents.document_stream(spark, str(tmp_path / "in"), docs.schema)
    documents.analyse_stream(stream, stats, "doc_id", str(tmp_path / "out"), str(tmp_path / "cp"), 3).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").count().where("count = 3").count() == 6


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_against_sql(spark):
    import math

    import duckdb

    from quillmetry.plans import oracle, registry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)
    queries, sql = registry.queries(), oracle.oracle_sql()
    assert set(queries) == set(sql)
    for name in "token_counts token_affixes syntax_features ranked_issues_topk diagnosis_table quality_gate summary_stats spearman merge_last_wins cohesion_gaps share_url diagnosis_support derived_interventions missing_layers synthetic_metrics disagreement_cases named_predictions feature_stats_flat feature_stats_merged hybrid_routing".split():
        got = queries[name](spark, folder)
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(columns)} from ({sql[name]})").fetchall()
        mine = [tuple(r[c] for c in columns) for r in got.collect()]
        assert sorted(map(str, (tuple(map(plain, r)) for r in mine))) == sorted(map(str, (tuple(map(plain, r)) for r in want))), name
