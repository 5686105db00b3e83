"""The four cases of the regression policy, null checks, ties of runs, gates."""

from pyspark.sql import functions as F

from tessera.operators import compare, failures, retrieval, verdicts
from tessera.sources import tables

DELTAS = "accepted_delta long, avg_delta double, compile_delta double, runtime_delta double, newly_broken long, big_drops long"


def test_four_cases(spark):
    rows = [(0, 0.0, 0.0, 0.0, 0, 0), (2, 5.0, 0.0, 0.0, 0, 0), (-1, -5.0, 0.0, 0.0, 1, 0), (1, 2.0, 0.0, 0.0, 0, 1)]
    got = [r.v for r in spark.createDataFrame(rows, DELTAS).select(compare.verdict(*compare.signals()).alias("v")).collect()]
    assert got == ["pass", "improvement", "regression", "manual_review"]


def test_runs_of_an_equal_time_are_not_previous(spark):
    runs = spark.createDataFrame([("m", "a", "01"), ("m", "b", "01"), ("m", "c", "02"), ("n", "d", "02")], "model string, run_id string, stamp string")
    assert {r.run_id: r.previous_run for r in compare.previous_run(runs).collect()} == {"a": None, "b": None, "c": "b", "d": None}


def test_missing_scores_and_checks_count_as_zero(spark):
    s = "model string, run_id string, stamp string, id string, score long, accepted boolean, compile_passed boolean, runtime_passed boolean, semantic_passed boolean, keyword_passed boolean, timed_out boolean"
    r = compare.runs_of(spark.createDataFrame([("m", "a", "1", "x", 80, True, True, None, True, None, None), ("m", "a", "1", "y", None, None, None, None, True, True, True)], s)).first()
    assert (r.avg_score, r.accepted, r.compile_rate, r.runtime_rate, r.timeout_rate) == (40.0, 1, 0.5, 0.0, 0.5)


def test_labels_depend_on_one_another(spark):
    s = "proxy_passed boolean, truncation_passed boolean, has_main boolean, compile_passed boolean, runtime_passed boolean, compile_error string, match_ratio double, topic string"
    rows = [
        (False, None, None, False, None, "ld failed", None, "t"),
        (None, False, False, False, None, "x undeclared; array", None, "t"),
        (None, None, None, True, False, None, 0.7, "t"), (None, None, None, True, False, None, 0.0, "Nearest point"), (None, None, None, None, None, None, None, "t"),
    ]
    got = [(r.a, r.p) for r in spark.createDataFrame(rows, s).withColumn("a", failures.failure_labels()).select("a", failures.primary(F.col("a")).alias("p")).collect()]
    assert got == [
        (["partial_generation", "syntax_error"], "syntax_error"),
        (["truncation", "missing_entrypoint", "hallucinated_function", "array_bounds"], "truncation"),
        (["io_format_error"], "io_format_error"), (["geometry_reasoning"], "geometry_reasoning"), (["runtime_error"], "runtime_error"),
    ]


def test_checks_that_were_not_run_block(spark):
    checks = spark.createDataFrame([("a", "x", None, True), ("a", "y", True, False), ("b", "x", True, True), ("b", "y", None, False), ("c", "x", True, True)], "g string, check string, ok boolean, blocking boolean")
    assert {r.g: (r.verdict, r.blocked_by, r.warnings) for r in verdicts.deploy_gate(checks, "g").collect()} == {"a": ("blocked", "x", ""), "b": ("ready_with_warnings", "", "y"), "c": ("ready", "", "")}


def test_search_finds_the_heading_section(spark, tmp_path):
    (tmp_path / "notes.MD").write_text("# Arrays\nan array holds values\n\n# Pointers\na pointer dereference reads the value at an address\n")
    (tmp_path / "other.txt").write_text("\n".join(f"line {i} about arrays" for i in range(90)))
    (tmp_path / "skipped.bin").write_bytes(b"\xff\xfe")
    files = tables.read_documents(spark, str(tmp_path), ("md", "txt")).withColumn("name", F.element_at(F.split("source", "/"), -1)).select("source", "name", "text")
    p = retrieval.passages_of(files, "source", "name", "text").withColumn("key", F.concat_ws("#", "file", "passage"))
    assert sorted(r.key for r in p.collect()) == ["notes.md#0", "notes.md#1", "other.txt#0", "other.txt#1", "other.txt#2"]
    index = retrieval.postings(p.withColumn("all", F.concat_ws(" ", "file", "heading", "text")), "key", "all")
    names = p.select(F.col("key").alias("passage"), "file", F.lower("heading").alias("heading"))
    best = retrieval.search(index, p.count(), spark.createDataFrame([(1, "pointer dereference address")], "q long, t string"), "q", "t", 2, names).collect()
    assert best[0].passage == "notes.md#1"


def test_a_query_without_words_finds_what_file_names_hold(spark):
    index = retrieval.postings(spark.createDataFrame([(1, "a b"), (2, "c")], "p long, t string"), "p", "t")
    names = spark.createDataFrame([(1, "x_éà.md", "éà"), (2, "y.md", ""), (3, None, None)], "passage long, file string, heading string")
    queries = spark.createDataFrame([(1, "ÉÀ"), (2, ""), (3, None), (4, "c")], "q long, t string")
    got = lambda n: {tuple(r) for r in retrieval.search(index, 2, queries, "q", "t", 2, n).select("query", "rank", "passage").collect()}
    assert got(names) == {(1, 1, 1), (4, 1, 2)} and got(None) == {(4, 1, 2)}


def test_json_files_and_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 1}')
    (tmp_path / "b.json").write_text('[{"id": "y", "n": 2}, {"id": "z", "n": 3}]')
    (tmp_path / "c.json").write_text("{broken")
    schema = spark.createDataFrame([("x", 1)], "id string, n long").schema
    got = tables.read_json_files(spark, str(tmp_path), schema)
    assert {(r.id, r.n, r._filename) for r in got.collect()} == {("x", 1, "a.json"), ("y", 2, "b.json"), ("z", 3, "b.json")}
    tables.write_splits(got.withColumns({"split": F.when(F.col("n") < 3, "train").otherwise("test"), "type": F.lit("t")}), f"file://{tmp_path}/out")
    assert sorted(p.parent.name for p in (tmp_path / "out").rglob("part-*.json")) and spark.read.json(f"file://{tmp_path}/out/split=test").count() == 1


def test_weak_words_are_added_for_passages_near_the_best_only(spark, monkeypatch):
    sizes, real = [], retrieval.staged

    def staged(df):
        out = real(df)
        sizes.append((tuple(out.columns), out.count()))
        return out

    monkeypatch.setattr(retrieval, "staged", staged)
    docs = spark.createDataFrame([(i, "x " + "rare " * (i + 1 if i < 40 else 0)) for i in range(300)], "p long, t string")
    got = retrieval.search(retrieval.postings(docs, "p", "t"), 300, spark.createDataFrame([(1, "rare x")], "q long, t string"), "q", "t", 1).collect()
    assert [(r["rank"], r.passage) for r in got] == [(1, 39)]
    found, near = [n for columns, n in sizes if columns == ("query", "passage", "part")]
    assert 0 < near < found == 40
