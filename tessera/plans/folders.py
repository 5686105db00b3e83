"""Queries over files that Spark writes from the tables and reads back: numbered lines, runs, registries, stages, streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.plans.registry import query
from tessera.sources import folders, lines, listings, problems
from tessera.sources.tables import EVAL_SQL, eval_results, shared_dir, table
from tessera.streaming import chunks, sinks


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_DAY = "strftime(ts, '%Y%m%d')"


def _event_lines(spark, sf_dir):
    """A file of JSON lines for each day, with blank and broken lines, in the order of events."""
    object_ = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("kind"), "value").alias("what")))
    text = F.when(F.col("event_id") % 13 == 5, "").when(F.col("event_id") % 11 == 3, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", oops"))).otherwise(object_)
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), "event_id", text.alias("value"))
    path = _place(spark, "events")
    rows.repartition("day").sortWithinPartitions("day", "event_id").drop("event_id").write.partitionBy("day").text(path)
    return path


@query(f"""SELECT day, n AS line, CASE WHEN event_id % 11 <> 3 THEN event_id END AS event_id, CASE WHEN event_id % 11 <> 3 THEN event_type END AS kind, CASE WHEN event_id % 11 = 3 THEN '{{"event_id": ' || event_id || ', oops' END AS bad
FROM (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY {_DAY} ORDER BY event_id) AS n FROM events) WHERE event_id % 13 <> 5""")
def numbered_json_lines(spark, sf_dir):
    schema = StructType().add("event_id", "long").add("what", StructType().add("kind", "string").add("value", "double"))
    rows = lines.read_permissive(spark, f"{_event_lines(spark, sf_dir)}/day=*", schema)
    return rows.select(F.regexp_extract("file", "day=([0-9]+)", 1).alias("day"), F.col("_line").alias("line"), "event_id", "what.kind", F.col("_json_error").alias("bad"))


def _runs(spark, sf_dir):
    """Folders of runs: a report each, some broken, some without a model; results of two thirds of them."""
    r = eval_results(spark, sf_dir)
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    runs = r.groupBy("run_id", "model", "stamp").agg(
        F.count_if("accepted").alias("accepted"), F.avg(F.coalesce("score", F.lit(0))).alias("average_score"), F.struct(share("compile_passed").alias("compile_pass_rate"), share("runtime_passed").alias("runtime_pass_rate")).alias("rates")
    )
    day = F.substring("run_id", -2, 2).cast("int")
    meta = F.struct(F.when(day % 4 > 0, F.col("model")).alias("model"), F.lit("strict_v2").alias("prompt_profile"), (day * 10).alias("max_tokens"), (day / 16).alias("temperature"), (day % 2 == 0).alias("model_override_valid"))
    whole = F.to_json(F.struct(F.col("stamp").alias("timestamp"), F.when(day % 4 == 0, F.concat(F.lit("old_"), "model")).alias("model"), "accepted", "average_score", "rates", meta.alias("meta")))
    path = _place(spark, "runs")
    reports = runs.select("run_id", F.when(day % 7 == 0, '{"accepted": 1,').otherwise(whole).alias("value"))
    reports.write.partitionBy("run_id").option("maxRecordsPerFile", 1).text(f"{path}/reports")
    r.where(day % 3 > 0).select("run_id", F.to_json(F.struct("id", "score", "topic")).alias("value")).repartition("run_id").write.partitionBy("run_id").text(f"{path}/results")
    return f"{path}/reports/*/*.txt", f"{path}/results/*/*.txt"


_RUNS = f"""{EVAL_SQL}, g AS (SELECT run_id, right(run_id, 2)::INT AS day, CASE WHEN right(run_id, 2)::INT % 4 > 0 THEN model ELSE 'old_' || model END AS model, stamp, count(*) FILTER (accepted) AS accepted, avg(coalesce(score, 0)) AS score,
  avg(coalesce(compile_passed, false)::INT::DOUBLE) AS c, avg(coalesce(runtime_passed, false)::INT::DOUBLE) AS t, count(*) AS n, sum(coalesce(score, 0))::BIGINT AS total FROM r GROUP BY ALL)"""


@query(f"""{_RUNS} SELECT run_id, model, stamp AS timestamp, accepted, round_even(score, 1) AS avg_score, round_even(c, 3) AS compile_rate, round_even(t, 3) AS runtime_rate, day % 3 > 0 AS has_results FROM g WHERE day % 7 <> 0""")
def folder_runs(spark, sf_dir):
    return folders.run_reports(spark, *_runs(spark, sf_dir))


@query(f"""{_RUNS} SELECT run_id, model, 'strict_v2' AS prompt_profile, (day * 10)::BIGINT AS max_tokens, day / 16 AS temperature, day % 2 = 0 AS model_override_valid, CASE WHEN day % 3 > 0 THEN n ELSE 0 END AS results, CASE WHEN day % 3 > 0 THEN total ELSE 0 END AS total
FROM g WHERE day % 7 <> 0""")
def folder_results(spark, sf_dir):
    runs = folders.run_results(spark, *_runs(spark, sf_dir))
    total = F.aggregate("results", F.lit(0).cast("bigint"), lambda s, x: s + x["score"])
    return runs.withColumn("total", total).withColumn("results", F.size("results").cast("bigint"))


@query(f"""{_RUNS} SELECT CASE WHEN day % 7 <> 0 THEN run_id END AS run_id, CASE WHEN day % 7 <> 0 THEN 'baseline' ELSE 'invalid' END AS run_type, CASE WHEN day % 7 <> 0 THEN stamp ELSE '' END AS timestamp, day % 7 = 0 AS bad,
CASE WHEN day % 7 <> 0 THEN accepted END AS accepted FROM g""")
def registry_entries(spark, sf_dir):
    r = eval_results(spark, sf_dir).groupBy("run_id", "stamp").agg(F.count_if("accepted").alias("accepted"))
    entry = F.to_json(F.struct("run_id", F.col("stamp").alias("timestamp"), F.lit("baseline").alias("run_type"), "accepted"))
    path = _place(spark, "registry")
    r.select(F.when(F.substring("run_id", -2, 2).cast("int") % 7 == 0, '["not", 1').otherwise(entry)).write.option("maxRecordsPerFile", 1).text(path)
    schema = StructType().add("run_id", "string").add("timestamp", "string").add("run_type", "string").add("accepted", "long")
    bad = F.col("error").isNotNull()
    return folders.registry(spark, f"{path}/*.txt", schema).select(F.when(~bad, F.col("run_id")).alias("run_id"), "run_type", "timestamp", bad.alias("bad"), "accepted")


@query(f"""{_RUNS}, f AS (SELECT r.run_id, id, score FROM r WHERE accepted IS NOT TRUE) SELECT run_id, id, score FROM f WHERE right(run_id, 2)::INT % 5 <> 0""")
def folder_failures(spark, sf_dir):
    failed = eval_results(spark, sf_dir).where("accepted IS NOT TRUE").select("run_id", F.to_json(F.struct("id", "score")).alias("value"))
    broken = failed.select("run_id").distinct().where(F.substring("run_id", -2, 2).cast("int") % 5 == 0).withColumn("value", F.lit("{oops"))
    path = _place(spark, "failures")
    failed.unionByName(broken).repartition("run_id").write.partitionBy("run_id").text(path)
    return folders.failed_cases(spark, f"{path}/*/*.txt", StructType().add("id", "string").add("score", "long"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_suppkey % 40 AS name, ['promoted', 'safe', 'ablation', 'rejected'][1 + s_suppkey % 4] AS source, CASE WHEN s_suppkey % 6 = 0 THEN 'own' END AS own FROM supplier),
a AS (SELECT *, source IN ('promoted', 'safe') AS usable, CASE source WHEN 'promoted' THEN 0 WHEN 'safe' THEN 2 WHEN 'ablation' THEN 3 ELSE 4 END AS rank FROM p UNION ALL SELECT 0, 7, 'default', NULL, true, 1)
SELECT 'a' || name AS name, usable, source, coalesce(own, CASE source WHEN 'promoted' THEN 'promote' WHEN 'default' THEN 'promote' WHEN 'safe' THEN 'safe_no_change' WHEN 'ablation' THEN 'ablation_only' ELSE 'reject' END) AS status, k AS seed
FROM a QUALIFY row_number() OVER (PARTITION BY name, usable ORDER BY rank DESC, k DESC) = 1""")
def adapter_lists(spark, sf_dir):
    name = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "x\\y\\").otherwise("out/"), F.lit("a"), (F.col("s_suppkey") % 40).cast("string"))
    entry = F.struct(name.alias("adapter_path"), F.when(F.col("s_suppkey") % 6 == 0, "own").alias("status"), F.col("s_suppkey").alias("seed"))
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("k"), "s_suppkey", entry.alias("e"))
    path = _place(spark, "adapters")
    for k, source in enumerate(("promoted", "safe", "ablation", "rejected")):
        listed = rows.where(F.col("k") == k).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "e"))).alias("l"))
        folders.write_file(spark, listed.select(F.to_json(F.struct(F.transform("l", lambda x: x["e"]).alias("adapters")))), f"{path}/{source}_adapters.json")
    folders.write_file(spark, spark.range(1).select(F.lit('{"active": {"adapter_path": "a7", "seed": 0}}')), f"{path}/default_adapter.json")
    return folders.adapter_registry(spark, path, StructType().add("adapter_path", "string").add("status", "string").add("seed", "long")).drop("adapter_path")


STAGES = ("inbox", "in_review", "approved")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'inbox' WHEN s_suppkey % 3 = 0 THEN 'in_review' ELSE 'approved' END AS stage, 1 + (s_suppkey % 2 = 0)::INT + (s_suppkey % 3 = 0)::INT AS stages FROM supplier")
def staged_items(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    of = {"inbox": F.col("s_suppkey") % 2 == 0, "in_review": F.col("s_suppkey") % 3 == 0, "approved": F.lit(True)}
    places = F.filter(F.array(*[F.when(of[x], x) for x in STAGES]), lambda x: x.isNotNull())
    path = _place(spark, "stages")
    # some 1,000 items in each file, so that files grow with the items' bytes and not one by one
    part = F.pmod(F.xxhash64("s_suppkey"), F.lit(s.count() // 1000 + 1))
    listed = s.select(F.explode(places).alias("stage"), part.alias("part"), F.struct(F.col("s_suppkey").alias("id"), "s_name").alias("item")).groupBy("stage", "part").agg(F.collect_list("item").alias("items"))
    listed.select("stage", F.to_json("items", {"pretty": "true"}).alias("value")).write.partitionBy("stage").option("maxRecordsPerFile", 1).text(path)
    items = folders.staged_items(spark, path, [f"stage={x}" for x in STAGES], StructType().add("id", "long").add("s_name", "string"), "*.txt")
    n = items.groupBy("id").agg(F.count("*").cast("int").alias("stages"))
    return folders.first_stage(items, STAGES, "id").join(n, "id").select("id", F.col("_stage").alias("stage"), "stages")


_STREAM = """WITH b AS (SELECT conv_id, turn, 'event: ' || role || chr(10) || ': comment' || chr(10) || 'id:' || turn || chr(10) || CASE WHEN turn % 2 = 0 THEN 'retry: ' || turn * 10 ELSE 'retry: soon' END || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') AS b FROM conversations),
s AS (SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN string_agg(b, chr(10) || chr(10) || chr(10) ORDER BY turn) ELSE string_agg(b, chr(10) || chr(10) ORDER BY turn) END AS t FROM b GROUP BY conv_id),
c AS (SELECT conv_id, string_split(CASE WHEN conv_id % 3 = 1 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END, chr(10)) AS l FROM s),
u AS (SELECT conv_id, unnest(range(len(l))) AS i, regexp_replace(unnest(l), chr(13) || '$', '') AS x FROM c),
e AS (SELECT conv_id, i, split_part(x, ':', 1) AS f, regexp_replace(CASE WHEN contains(x, ':') THEN substr(x, length(split_part(x, ':', 1)) + 2) ELSE '' END, '^ ', '') AS v, count(*) FILTER (x = '') OVER (PARTITION BY conv_id ORDER BY i) AS g FROM u),
a AS (SELECT conv_id, g, arg_max(v, i) FILTER (f = 'event') AS event, coalesce(string_agg(v, chr(10) ORDER BY i) FILTER (f = 'data'), '') AS data, arg_max(v, i) FILTER (f = 'id') AS last_id, arg_max(v, i) FILTER (f = 'retry') AS r,
  count(*) FILTER (f IN ('event', 'data', 'id', 'retry')) AS n FROM e GROUP BY conv_id, g)"""


def _chunks(spark, sf_dir, size: int = 97):
    """Conversations as event streams, cut into chunks of so many bytes."""
    retry = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("retry: "), (F.col("turn") * 10).cast("string"))).otherwise("retry: soon")
    block = F.concat_ws("\n", F.concat(F.lit("event: "), F.col("role")), F.lit(": comment"), F.concat(F.lit("id:"), F.col("turn").cast("string")), retry, F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\ndata: "))))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("t"))
    text = F.array_join("t.b", "\n\n")
    text = F.when(F.col("conv_id") % 2 == 1, F.array_join("t.b", "\n\n\n")).otherwise(text)
    sent = F.when(F.col("conv_id") % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text).cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("s") - 1) / size).cast("int")), lambda i: F.substring(F.col("s"), i * size + 1, F.lit(size)))
    return turns.select("conv_id", sent.alias("s")).select("conv_id", F.posexplode(cut).alias("n", "chunk"))


@query(f"{_STREAM} SELECT conv_id::VARCHAR AS stream, event, data, last_id, CASE WHEN regexp_full_match(r, '[0-9]+') THEN r::BIGINT END AS retry FROM a WHERE n > 0")
def chunked_events(spark, sf_dir):
    return chunks.events_of_chunks(_chunks(spark, sf_dir), "conv_id", "n", "chunk").drop("at", "n")


@query("SELECT user_id, event_id, value, event_id % 3 AS batch_id FROM events")
def appended_attempts(spark, sf_dir):
    e, path = table(spark, sf_dir, "events").select("user_id", "event_id", "value"), _place(spark, "appended")
    write = sinks.append_jsonl(path)
    for batch_id in (0, 1, 1, 2, 0):  # batches that come again change nothing
        write(e.where(F.col("event_id") % 3 == batch_id), batch_id)
    return sinks.appended(spark, path, e.schema)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id DESC) = 1")
def upserted_bests(spark, sf_dir):
    e, path = table(spark, sf_dir, "events").select("user_id", "event_id", "value"), _place(spark, "bests")
    write = sinks.upsert_best(path, ["user_id"], "value", "event_id")
    for batch_id in (0, 1, 1, 2, 2):
        write(e.where(F.col("event_id") % 3 == batch_id), batch_id)
    return sinks.best_table(spark, path)


_PATHS = """SELECT CASE page_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/cache/deep/' WHEN 2 THEN 'runs/old/' WHEN 3 THEN 'src\\a/' WHEN 4 THEN '' ELSE 'tests/.git/' END || 'p' || page_id || CASE page_id % 5 WHEN 0 THEN '.PYC' WHEN 1 THEN '.tmp' ELSE '.md' END AS path FROM pages"""


@query(f"""WITH p AS (SELECT path, replace(path, chr(92), '/') AS q FROM ({_PATHS.replace(chr(92) * 2, chr(92))})),
r AS (SELECT *, CASE WHEN q LIKE 'src/cache/%' THEN 'src/cache' WHEN q LIKE 'runs/old/%' THEN 'runs/old' WHEN q LIKE 'tests/.git/%' THEN 'tests/.git' WHEN q LIKE '%.PYC' OR q LIKE '%.tmp' THEN q END AS w,
  CASE WHEN q LIKE 'runs/old/%' THEN 'run history' WHEN q LIKE 'src/cache/%' OR q LIKE 'tests/.git/%' THEN 'development or cache' WHEN q LIKE '%.PYC' THEN 'suffix .pyc' ELSE 'suffix .tmp' END AS why FROM p)
SELECT DISTINCT w AS path, why AS reason FROM r WHERE w IS NOT NULL UNION ALL SELECT path, NULL FROM r WHERE w IS NULL""")
def release_paths(spark, sf_dir):
    k = F.col("page_id") % 6
    folder = F.when(k == 0, "src/").when(k == 1, "src/cache/deep/").when(k == 2, "runs/old/").when(k == 3, "src\\a/").when(k == 4, "").otherwise("tests/.git/")
    ending = F.when(F.col("page_id") % 5 == 0, ".PYC").when(F.col("page_id") % 5 == 1, ".tmp").otherwise(".md")
    files = table(spark, sf_dir, "pages").select(F.concat(folder, F.lit("p"), F.col("page_id").cast("string"), ending).alias("path"))
    taken, left = listings.released(files, "path", (".git", "cache"), (".pyc", ".tmp"), {"runs/old": "run history"})
    return left.unionByName(taken.withColumn("reason", F.lit(None).cast("string")))


@query("SELECT 'kind' || s_nationkey % 3 AS report_type, 'every,tag' || s_nationkey % 3 AS tags, count(*) AS files, sum(octet_length(encode(s_name)) + 1)::BIGINT AS bytes FROM supplier GROUP BY ALL")
def report_listing(spark, sf_dir):
    path = _place(spark, "reports")
    kind = F.concat(F.lit("kind"), (F.col("s_nationkey") % 3).cast("string"))
    # a file for each report takes most of the time, so all cores write, and each puts its own in place
    names = table(spark, sf_dir, "supplier").select(kind.alias("kind"), "s_name").repartition(4 * spark.sparkContext.defaultParallelism)
    names.write.partitionBy("kind").options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    roots = {f"kind{k}": (f"{path}/kind=kind{k}", (f"tag{k}", "every")) for k in range(3)}
    found = listings.report_index(spark, roots, ("txt",))
    return found.groupBy("report_type", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("""WITH p AS (SELECT item_id, 'item ' || item_id // 2 AS task_id, text FROM benchmark WHERE trim(text) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY task_id, text) AS n FROM p)
SELECT 'item_' || item_id // 2 || '~' || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.md' AS name, '# ' || task_id || chr(10) || chr(10) || '- Topic: benchmark' || chr(10) || chr(10) || '## Problem' || chr(10) || chr(10) || trim(text) || chr(10) AS text FROM n""")
def problem_files(spark, sf_dir):
    """Written twice, and read back."""
    b = table(spark, sf_dir, "benchmark").repartition(3, "item_id").sortWithinPartitions("item_id")
    rows = b.select(F.concat(F.lit("item "), F.floor(F.col("item_id") / 2).cast("string")).alias("task_id"), F.lit("benchmark").alias("topic"), F.lit(None).cast("string").alias("difficulty"), F.col("text").alias("prompt"), F.lit("").alias("solution"))
    path = _place(spark, "problems")
    problems.write_problems(spark, rows.limit(3), path)
    problems.write_problems(spark, rows, path)
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("name"), F.col("value").alias("text"))
