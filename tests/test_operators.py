import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import compare, retrieval
from tessera.sources import tables
from tessera.streaming import best


def test_diff_is_full_and_deltas_are_inner(spark):
    s = "id string, score long, accepted boolean"
    base = spark.createDataFrame([("a", 70, True), ("b", 10, False)], s)
    new = spark.createDataFrame([("b", 80, True), ("c", 5, False)], s)
    assert {r.id: r.change for r in compare.run_diff(base, new).collect()} == {"a": "newly_broken", "b": "newly_fixed", "c": "unchanged_fail"}
    assert [(r.id, r.delta) for r in compare.task_deltas(base, new).collect()] == [("b", 70)]


def test_score_rounds_half_to_even(spark):
    row = spark.range(1).select(T.total_score(F.lit(0.5), F.lit(0.5), F.lit(True), F.lit(0.25)).alias("s"), T.structure_score(F.lit("#include <x>\nint main() {}")).alias("t")).first()
    assert (row.s, row.t) == (8 + 8 + 40 + 8, 1.0)


def test_html_to_text(spark):
    row = spark.range(1).select(T.html_to_text(F.lit("<p>a &amp;lt; b\n c</p><br")).alias("x"), T.title(F.lit("<TITLE> A  &amp; B</TITLE>")).alias("t")).first()
    assert (row.x, row.t) == ("a < b c", "A & B")
    assert spark.range(1).select(T.title(F.lit("<div>\n\u00a0</div>\n<p>first &lt;line</p>\nnext")).alias("t")).first().t == "first <line"
    assert spark.range(1).select(T.collapse(F.lit("\u3000a\u00a0\u2003b\x85"))).first()[0] == "a b"


def test_markdown_passages(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n")], "id long, text string")
    got = [(r.passage, r.heading, r.text) for r in retrieval.split_markdown(df, "id", "text").orderBy("passage").collect()]
    assert got == [(0, "", "intro"), (1, "# A", "# A\nx"), (2, "## B", "## B\ny")]


def test_jsonl_round_trip_and_bad_lines(spark):
    path = tempfile.mkdtemp(prefix="tessera-")
    schema = StructType().add("id", "string").add("n", "long")
    tables.write_jsonl(spark.createDataFrame([("a", 1), ("b", None)], schema), f"{path}/x")
    assert tables.read_jsonl(spark, f"{path}/x", schema).count() == 2
    with open(f"{path}/bad.jsonl", "w") as f:
        f.write('{"id": "a", "n": 1}\n{oops\n')
    got = {r.id: r._json_error for r in tables.read_jsonl_permissive(spark, f"{path}/bad.jsonl", schema).collect()}
    assert got == {"a": None, None: "{oops"}


def test_upsert(spark):
    s = "name string, v long"
    out = tables.upsert(spark.createDataFrame([("A ", 1), ("b", 2)], s), spark.createDataFrame([("a", 9)], s), "name")
    assert sorted((r.name, r.v) for r in out.collect()) == [("a", 9), ("b", 2)]


def test_stream_equals_batch(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    path = tempfile.mkdtemp(prefix="tessera-")
    events.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = best.start(best.best_so_far(stream, "user_id", "value", "event_id"), "bests", f"{path}/cp", "complete")
    q.awaitTermination(120)
    want = sorted(map(tuple, best.best_so_far(events, "user_id", "value", "event_id").collect()))
    assert sorted(map(tuple, spark.table("bests").collect())) == want
