"""Files, streams and sinks: numbers of lines, folders of runs, chunks cut anywhere, batches that come twice."""

import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.files import stream_events
from tessera.sources import folders, lines, listings, problems, tables
from tessera.streaming import chunks, sinks

ROW = StructType().add("id", "string").add("n", "long")


@pytest.fixture
def place():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_numbers_in_files_of_many_splits(spark, place):
    r, wanted = random.Random(4), {}
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c", "\n")):
        text = ["" if r.random() < 0.2 else json.dumps({"id": f"{name}{k}", "n": k}) + " " * r.randint(0, 60) for k in range(400)]
        (place / f"{name}.jsonl").write_bytes((end.join(text) + (end if name != "c" else "")).encode())
        wanted |= {(name, k + 1): x for k, x in enumerate(text) if x or k < 399 or name != "c"}  # an empty line needs its end
    sizes = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "40"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        read = lines.numbered_lines(spark, f"{place}/*.jsonl")
        assert spark.read.text(f"{place}/*.jsonl").rdd.getNumPartitions() > 20
        assert {(Path(x.file).stem, x.line): x.value for x in read.collect()} == wanted
        rows = lines.read_strict(spark, f"{place}/*.jsonl", ROW).collect()
        assert {(Path(x.file).stem, x.line): (x.id, x.n) for x in rows} == {k: (f"{k[0]}{k[1] - 1}", k[1] - 1) for k, x in wanted.items() if x}
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_bad_lines_are_named(spark, place):
    (place / "x.jsonl").write_text('{"id": "a", "n": 1}\n\n  \n{oops\n[1]\n{"id": "b", "n": 2}\n')
    got = [(r._line, r.id, r.n, r._json_error) for r in lines.read_permissive(spark, str(place), ROW).orderBy("_line").collect()]
    assert got == [(1, "a", 1, None), (4, None, None, "{oops"), (5, None, None, "[1]"), (6, "b", 2, None)]
    for columns in (["id"], ["line"], ["n", "file"]):
        with pytest.raises(Exception, match=r"x.jsonl:4: invalid JSON line"):
            lines.read_strict(spark, str(place), ROW).where("line < 5").select("id", *columns).collect()


def test_run_folders(spark, place):
    for name, report, results in (
        ("b_run", '{"meta": {"model": "m", "temperature": 0.5}, "average_score": 81.25, "accepted": 3, "rates": {"compile_pass_rate": 0.12345}, "timestamp": "t2"}', '{"id": "y", "score": 3}\n{"id": "x"}\n'),
        ("a_run", '{"model": "old"}', None),
        ("broken", "{oops", '{"id": "z", "score": 1}'),
        ("no_report", None, '{"id": "z", "score": 1}'),
        ("named=r1", "{}", ""),
    ):
        (place / name).mkdir()
        for file, text in (("report.json", report), ("results.jsonl", results)):
            if text is not None:
                (place / name / file).write_text(text)
    globs = f"{place}/*/report.json", f"{place}/*/results.jsonl"
    got = {r.run_id: tuple(r)[1:] for r in folders.run_reports(spark, *globs).collect()}
    assert got == {"b_run": ("m", "t2", 3, 81.2, 0.123, 0.0, True), "a_run": ("old", "", 0, 0.0, 0.0, 0.0, False), "r1": ("unknown", "", 0, 0.0, 0.0, 0.0, False)}
    nested = {r.run_id: [tuple(x) for x in r.results] for r in folders.run_results(spark, *globs).collect()}
    assert nested == {"b_run": [("x", 0), ("y", 3)], "a_run": [], "r1": []}
    plan = folders.run_reports(spark, *globs)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "content" not in plan


def test_registry_files(spark, place):
    (place / "one.json").write_text('{\n  "timestamp": "2024-01-02", "run_type": "x"\n}')
    (place / "two.json").write_text('{"run_id": "r2", "timestamp": "2024-01-03", "run_type": "y"}')
    (place / "bad.json").write_text("{")
    (place / "note.txt").write_text("no")
    schema = StructType().add("run_id", "string").add("timestamp", "string").add("run_type", "string")
    got = [(r.run_id, r.run_type, r.timestamp) for r in folders.registry(spark, f"{place}/*.json", schema).collect()]
    assert got == [("r2", "y", "2024-01-03"), ("one", "x", "2024-01-02"), ("bad", "invalid", "")]
    assert [r.run_id for r in folders.registry(spark, f"{place}/*.json", schema, invalid=False).collect()] == ["r2", "one"]


def test_adapter_files_later_ones_win(spark, place):
    entry = lambda path, **more: {"adapter_path": path, **more}
    files = {
        "promoted_adapters": {"adapters": [entry("x/a"), entry("b", status="old"), entry("b", status="new")]},
        "default_adapter": {"active": entry("y\\a")},
        "safe_adapters": {"adapters": [entry("c"), entry("z/a")]},
        "rejected_adapters": {"adapters": [entry("c")]},
        "other_adapters": {"adapters": [entry("d")]},
    }
    for name, x in files.items():
        (place / f"{name}.json").write_text(json.dumps(x))
    got = {(r.name, r.usable): (r.source, r.status) for r in folders.adapter_registry(spark, str(place), StructType().add("adapter_path", "string").add("status", "string")).collect()}
    assert got == {("a", True): ("safe", "safe_no_change"), ("b", True): ("promoted", "new"), ("c", True): ("safe", "safe_no_change"), ("c", False): ("rejected", "reject")}
    (place / "default_adapter.json").write_text('{"active": null}')
    assert folders.adapter_registry(spark, str(place), StructType().add("adapter_path", "string").add("status", "string")).count() == 4


def test_a_report_is_replaced_as_a_whole(spark, place):
    for text in ("one", "zwei"):
        folders.write_file(spark, spark.createDataFrame([(text,)], "value string"), f"{place}/r.json")
        assert [p.name for p in place.iterdir() if not p.name.startswith(".")] == ["r.json"] and (place / "r.json").read_text() == text + "\n"


def _sent(seed):
    """Streams of events with odd lines and the chunks they are cut into, at any byte."""
    r, texts, parts = random.Random(seed), {}, []
    for k in range(12):
        end, some = r.choice(["\n", "\r\n"]), ["data: é€", "data:x", "event: a", ": note", "id: 7", "retry: 5", "retry: soon", "data", "other: 1", "", "", "data:  two"]
        whole = end.join(r.choice(some) for _ in range(r.randint(0, 40))) + r.choice(["", end, end * 2])
        texts[f"s{k}"] = whole
        raw, at, n = whole.encode(), 0, 0
        while at < len(raw) or n == 0:
            size = r.choice([0, 1, 1, 2, 3, 7, 30])
            parts.append((f"s{k}", n, bytearray(raw[at : at + size]), at + size >= len(raw)))
            at, n = at + size, n + 1
    return texts, parts


def _events(rows, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r.stream, []).append((r.event, r.data, r.last_id, r.retry))
    return out


SENT = "stream string, n long, chunk binary, last boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_cut_anywhere_equal_whole_texts(spark, seed):
    texts, parts = _sent(seed)
    whole = stream_events(spark.createDataFrame(list(texts.items()), "stream string, text string"), "stream", "text")
    chunked = chunks.events_of_chunks(spark.createDataFrame(parts + parts[:9], SENT).repartition(5), "stream", "n", "chunk")
    assert _events(chunked.collect(), lambda r: (r.at, r.n)) == _events(whole.collect(), lambda r: r.n)
    assert chunks.events_of_chunks(spark.createDataFrame([], SENT), "stream", "n", "chunk").collect() == []


def test_stream_of_chunks_over_a_restart(spark, place, rocks):
    """Chunks come late, early and twice; the query is stopped and goes on from its checkpoint."""
    texts, parts = _sent(3)
    random.Random(5).shuffle(parts)
    for k in range(4):
        spark.createDataFrame(parts[k::4] + (parts[:7] if k == 2 else []), SENT).coalesce(1).write.parquet(f"{place}/part{k}")
    seen = f"{place}/seen"
    for upto in (2, 4):
        for k in range(upto - 2, upto):
            spark.read.parquet(f"{place}/part{k}").write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(SENT).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        found = chunks.events_of_chunks(stream, "stream", "n", "chunk", "last")
        q = found.writeStream.format("json").option("path", seen).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    whole = stream_events(spark.createDataFrame(list(texts.items()), "stream string, text string"), "stream", "text")
    got = spark.read.schema("stream string, at long, n int, event string, data string, last_id string, retry long").json(seen)
    assert _events(got.collect(), lambda r: (r.at, r.n)) == _events(whole.collect(), lambda r: r.n)


def test_sinks_of_a_stream_that_is_replayed(spark, small, place):
    """After a lost commit the last batch comes again: nothing is doubled, and the bests are those of the whole table."""
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_id", "value")
    events.repartition(4).write.parquet(f"{place}/in")
    to = [sinks.append_jsonl(f"{place}/log"), sinks.upsert_best(f"{place}/bests", ["user_id"], "value", "event_id")]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    sinks.run(stream, f"{place}/checkpoint", *to).awaitTermination(240)
    last = max(int(p.name) for p in (place / "checkpoint/commits").iterdir() if p.name.isdigit())
    (place / f"checkpoint/commits/{last}").unlink()
    (place / f"checkpoint/commits/.{last}.crc").unlink(missing_ok=True)
    sinks.run(stream, f"{place}/checkpoint", *to).awaitTermination(240)
    logged = sinks.appended(spark, f"{place}/log", events.schema)
    assert logged.select("batch_id").distinct().count() == last + 1
    assert sorted(map(tuple, logged.drop("batch_id").collect())) == sorted(map(tuple, events.collect()))
    wanted = {r.user_id: (r.b["value"], r.b["event_id"]) for r in events.groupBy("user_id").agg(F.max(F.struct("value", "event_id")).alias("b")).collect()}
    assert {r.user_id: (r.value, r.event_id) for r in sinks.best_table(spark, f"{place}/bests").collect()} == wanted


def test_staging_without_a_checkpoint_setting(spark, monkeypatch):
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: default[0] if key == "spark.checkpoint.dir" and default else real(key, *default))
    assert tables.shared_dir(spark) == tables.shared_dir(spark)
    assert sorted(r.id for r in tables.staged(spark.range(3)).collect()) == [0, 1, 2]


def test_release_rules(spark):
    paths = ["a/b.c", "a/.git/x/y.c", "a/.git/z.c", "top/runs/r1/x", "top/runs", "x/top/runs/k", ".git", "q.TMP", "a\\cache\\m.c", "", "cache.c"]
    df = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, k int")
    taken, left = listings.released(df, "path", (".git", "cache"), (".tmp",), {"top/runs": "runs stay"})
    assert sorted(r.path for r in taken.collect()) == ["a/b.c", "cache.c", "x/top/runs/k"] and taken.columns == ["path", "k"]
    assert {(r.path, r.reason) for r in left.collect()} == {("a/.git", "development or cache"), ("top/runs", "runs stay"), (".git", "development or cache"), ("q.TMP", "suffix .tmp"), ("a/cache", "development or cache")}


def test_report_index_reads_no_content(spark, place):
    for name in ("one/Benchmark_Summary.json", "one/deep/x.MD", "two/routing.jsonl", "one/skip.txt"):
        (place / name).parent.mkdir(parents=True, exist_ok=True)
        (place / name).write_text("abc")
    df = listings.report_index(spark, {"first": (f"{place}/one", ["t"]), "second": (f"file:{place}/two", [])})
    assert {(r.report_type, Path(r.path).name, r["size"], tuple(r.tags)) for r in df.collect()} == {
        ("first", "Benchmark_Summary.json", 3, ("benchmark", "summary", "t")), ("first", "x.MD", 3, ("t",)), ("second", "routing.jsonl", 3, ("routing",)),
    }
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan and "path:string" in scan
    (place / "two/routing.jsonl").touch()
    assert Path(listings.latest(listings.listing(spark, str(place))).first().path).name == "routing.jsonl"


def test_problem_files_appear_together_or_not_at_all(spark, place):
    schema = "task_id string, topic string, difficulty string, prompt string, solution string"
    rows = [("a/b", "t", "easy", "p1", "int x;"), ("a b", None, None, "p2", None), ("a_b", None, None, "p3", " "), ("a_b_2", None, None, "p4", ""), (None, None, None, "p5", None), ("empty", None, None, " ", None), ("..", None, None, "p6", None)]
    problems.write_problems(spark, spark.createDataFrame(rows, schema), f"{place}/out")
    names = {"a_b.md", "a_b_2.md", "a_b_3.md", "a_b_2~.md", "unnamed.md", "unnamed_2.md"}
    assert {p.name for p in (place / "out").iterdir()} == names
    assert (place / "out/a_b_3.md").read_text() == "# a_b\n\n## Problem\n\np3\n" and (place / "out/a_b_2.md").read_text().startswith("# a/b\n\n- Topic: t\n- Difficulty: easy\n\n## Problem")
    bad = spark.createDataFrame(rows, schema).withColumn("prompt", F.when(F.col("task_id") == "a_b_2", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("prompt")))
    with pytest.raises(Exception, match="no"):
        problems.write_problems(spark, bad, f"{place}/out")
    assert {p.name for p in (place / "out").iterdir()} == names
    problems.write_problems(spark, spark.createDataFrame(rows[:1], schema), f"{place}/out")
    assert {p.name for p in (place / "out").iterdir()} == {"a_b.md"}


def test_staged_items_come_in_lists(spark, small, tmp_path, monkeypatch):
    """Files don't grow one by one with the items, and a list in a file gives a row for each of its items."""
    from tessera.plans import folders as plans

    monkeypatch.setattr(plans, "_place", lambda spark, name: f"{tmp_path}/{name}")
    suppliers = spark.read.parquet(f"{small}/supplier.parquet").count()
    assert plans.staged_items(spark, small).count() == suppliers > 3
    assert len(list(tmp_path.glob("stages/stage=*/*.txt"))) == 3


def test_reports_are_written_by_many_tasks(spark, small, tmp_path, monkeypatch):
    from tessera.plans import folders as plans

    monkeypatch.setattr(plans, "_place", lambda spark, name: f"{tmp_path}/{name}")
    suppliers = spark.read.parquet(f"{small}/supplier.parquet").count()
    assert sum(r.files for r in plans.report_listing(spark, small).collect()) == suppliers
    assert len({p.name.split("-")[1] for p in tmp_path.glob("reports/kind=*/*.txt")}) > 1
