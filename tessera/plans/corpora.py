"""Queries that build and keep record sets, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.plans.registry import query
from tessera.sources.tables import EVAL_SQL, eval_results, table


@query("SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1') OR starts_with(source, 'src7')")
def id_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(corpus.id_matches(F.col("source"), ["src1", "src7"])).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', coalesce(lang, ''), coalesce(text, ''))), 'license') OR contains(lower(concat_ws(' ', coalesce(lang, ''), coalesce(text, ''))), 'water')")
def keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(corpus.any_word(["License", "water"], F.col("lang"), F.col("text"))).select("doc_id")


@query("SELECT event_id FROM events WHERE contains(lower(event_type || ' ' || user_id || ' ' || event_id), '77')")
def row_search(spark, sf_dir):
    return corpus.row_contains(table(spark, sf_dir, "events").select("event_id", "user_id"), "77").select("event_id")


@query("SELECT doc_id AS id, CASE WHEN quality IS NOT NULL THEN 'labels' ELSE 'documents' END AS kind FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS quality FROM labels) USING (doc_id)")
def prompt_index(spark, sf_dir):
    one = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("id"), F.lit(name).alias("kind"))
    return corpus.first_of_sources([one("labels"), one("documents")], "id")


@query(f"{EVAL_SQL} SELECT run_id, id, text FROM r JOIN (SELECT * FROM benchmark) b ON item_id = r.seq % 60 WHERE NOT coalesce(accepted, false)")
def failures_with_prompts(spark, sf_dir):
    failed = eval_results(spark, sf_dir).where(~F.coalesce("accepted", F.lit(False))).withColumn("item_id", F.col("seq") % 60)
    return corpus.with_prompts(failed, table(spark, sf_dir, "benchmark"), "item_id")[0].select("run_id", "id", "text")


@query(f"{EVAL_SQL} SELECT count(*) AS skipped FROM r WHERE NOT coalesce(accepted, false) AND seq % 60 NOT IN (SELECT item_id FROM benchmark)")
def failures_without_prompts(spark, sf_dir):
    failed = eval_results(spark, sf_dir).where(~F.coalesce("accepted", F.lit(False))).withColumn("item_id", F.col("seq") % 60)
    return corpus.with_prompts(failed, table(spark, sf_dir, "benchmark"), "item_id")[1].agg(F.count("*").alias("skipped"))


@query("SELECT doc_id, 'labels' AS kind FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def add_absent(spark, sf_dir):
    one = lambda name: table(spark, sf_dir, name).select("doc_id", F.lit(name).alias("kind"))
    return corpus.add_absent(one("labels"), one("documents"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE coalesce(lang, '') END AS value FROM documents LEFT JOIN labels USING (doc_id)")
def golden_override(spark, sf_dir):
    better = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("value"))
    return corpus.override(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("value")), better, "doc_id", "value")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.doc_id % 3 <> 0 THEN 'kept' WHEN l.doc_id IS NULL THEN 'failed' ELSE 'filled' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY state")
def filled_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, "own").otherwise(" ").alias("out"))
    made = table(spark, sf_dir, "labels").select("doc_id", F.lit("made").alias("out"))
    return corpus.fill_missing(rows, made, "doc_id", "out").groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(quality, 0)::DOUBLE AS quality_score, coalesce(toxic, 0)::DOUBLE AS toxic_score, round_even(0.7 * coalesce(quality, 0) + 0.3 * coalesce(toxic, 0), 3)::DOUBLE AS total FROM documents d LEFT JOIN labels USING (doc_id)")
def record_scores(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    reports = {c: labels.select("doc_id", F.col(c).cast("double").alias("score")) for c in ("quality", "toxic")}
    return corpus.scored(table(spark, sf_dir, "documents").select("doc_id"), reports, "doc_id", {"quality": 0.7, "toxic": 0.3})


def _policy(spark):
    policy = spark.createDataFrame([("click", ["a1", "a2"], ["promoted"]), ("view", ["a3", "a2"], None), ("purchase", ["a4", "a9"], ["promoted", "safe"])], "topic string, allowed array<string>, statuses array<string>")
    adapters = spark.createDataFrame([("a1", "promoted", True), ("a2", "promoted", False), ("a3", "ablation", False), ("a4", "rejected", False)], "name string, status string, blocked boolean")
    return policy, adapters


@query(f"{EVAL_SQL} SELECT topic, CASE topic WHEN 'click' THEN 'a2' WHEN 'view' THEN 'a3' ELSE 'base' END AS adapter, count(*) AS n FROM r GROUP BY ALL")
def routing(spark, sf_dir):
    return corpus.routed(eval_results(spark, sf_dir).select("topic"), *_policy(spark)).groupBy("topic", "adapter").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT n_name AS topic, unnest(['a' || n_nationkey, 'a' || n_nationkey * 3, 'a' || n_nationkey * 7 % 50]) AS name FROM nation), a AS (SELECT 'a' || s_suppkey AS name, s_acctbal < 3000 AS blocked FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT topic, name, CASE WHEN blocked THEN 'blocked' WHEN blocked IS NULL THEN 'unknown' ELSE 'ok' END AS state FROM p LEFT JOIN a USING (name)""")
def routing_audit(spark, sf_dir):
    name = lambda k: F.concat(F.lit("a"), k.cast("string"))
    n = F.col("n_nationkey")
    policy = table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"), F.array(name(n), name(n * 3), name(n * 7 % 50)).alias("allowed"))
    adapters = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(name(F.col("s_suppkey")).alias("name"), (F.col("s_acctbal") < 3000).alias("blocked"))
    return corpus.routing_audit(policy, adapters)


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dangling_references(spark, sf_dir):
    return corpus.dangling(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("""SELECT path, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'preserved' ELSE 'deleted' END WHEN id % 7 = 0 THEN 'added' WHEN id % 3 = 0 THEN 'modified' ELSE 'unchanged' END AS action
FROM (SELECT page_id AS id, 'p/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.keep' ELSE '' END AS path FROM pages) WHERE NOT (id % 5 = 0 AND id % 7 = 0)""")
def sync_plan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".keep").otherwise("")).alias("path"), F.length("html").alias("size"))
    source = p.where("page_id % 5 <> 0").select("path", "size", F.lit(2).alias("mtime"))
    target = p.where("page_id % 7 <> 0").select("path", (F.col("size") + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)).alias("size"), F.lit(2).alias("mtime"))
    return corpus.sync_plan(source, target, F.col("path").endswith(".keep"))


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH p AS (SELECT item_id, unnest({_WORDS("text")}) AS word FROM benchmark), c AS (SELECT p_name AS name, p_brand AS kind, unnest({_WORDS("p_name")}) AS word FROM (SELECT DISTINCT p_name, p_brand FROM part)),
h AS (SELECT item_id, kind, name, count(*) AS score FROM p JOIN c USING (word) GROUP BY ALL) SELECT item_id, kind, name, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, name) AS rank FROM h QUALIFY rank <= 5""")
def catalogue_matches(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind")).distinct()
    return corpus.catalogue_matches(table(spark, sf_dir, "benchmark"), "item_id", "text", parts)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 7 WHEN 'de' THEN 3 ELSE 2 END")
def quota_sample(spark, sf_dir):
    return corpus.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 7, "de": 3}, 2)


@query("SELECT doc_id, copy::INT AS copy FROM documents, range(1, 4) t(copy) WHERE copy <= CASE WHEN lang = 'fr' THEN 3 ELSE 1 END")
def oversample(spark, sf_dir):
    return corpus.oversampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.when(F.col("lang") == "fr", 3).otherwise(1)).select("doc_id", "copy")


@query("SELECT event_id FROM events QUALIFY user_id % 4 = 0 OR row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def superseded_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("key"))
    return corpus.superseded(e, "key", "event_id").select("event_id")


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 99 END::INT AS priority FROM documents")
def level_priority(spark, sf_dir):
    return corpus.by_level(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ("de", "en")).select("doc_id", "priority")


@query("""SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS rank FROM (SELECT array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:6], ' ') AS category, count(*) AS n FROM conversations GROUP BY 1) QUALIFY rank <= 10""")
def top_categories(spark, sf_dir):
    return corpus.top_categories(table(spark, sf_dir, "conversations"), "text")


@query("SELECT lang, source, n, round_even(n / (SELECT count(*) FROM documents), 3) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ()))")
def dashboard(spark, sf_dir):
    return corpus.dashboard(table(spark, sf_dir, "documents"), "lang", "source")


@query("""SELECT count(*) AS records, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS prompts, count(DISTINCT doc_id) < count(*) AS repeated_ids, count(DISTINCT text) < count(*) AS repeated_prompts,
(SELECT count(DISTINCT n) = 1 FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS balanced FROM documents""")
def validation_summary(spark, sf_dir):
    return corpus.validation_summary(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query("SELECT source, sha256(string_agg(path || chr(0) || sha || chr(10), '' ORDER BY path)) AS digest FROM (SELECT source, doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS sha FROM documents) GROUP BY source")
def manifest_digests(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return corpus.manifest_digest(files, "source")


@query("""WITH i AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'agent_verified' WHEN 1 THEN 'human_verified' ELSE 'draft' END AS level, CASE WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'approved' END AS status, CASE doc_id % 5 WHEN 0 THEN 'submit' WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'promote' END AS action FROM documents),
o AS (SELECT *, coalesce(CASE action WHEN 'submit' THEN level = 'agent_verified' AND status = 'candidate' WHEN 'promote' THEN level = 'human_verified' ELSE action IS NOT NULL END, false) AS allowed FROM i)
SELECT id, allowed, CASE WHEN allowed THEN CASE action WHEN 'submit' THEN 'in_review' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'archive' ELSE 'golden' END ELSE status END AS status,
CASE WHEN allowed AND action = 'approve' THEN 'human_verified' WHEN allowed AND action = 'promote' THEN 'golden' ELSE level END AS level, allowed::INT AS steps FROM o""")
def life_cycle(spark, sf_dir):
    level = F.when(F.col("doc_id") % 3 == 0, "agent_verified").when(F.col("doc_id") % 3 == 1, "human_verified").otherwise("draft")
    empty = F.array().cast("array<struct<action:string,from_status:string,to_status:string>>")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), level.alias("level"), F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("approved").alias("status"), empty.alias("history"))
    actions = items.where("id % 5 <> 4").select("id", F.get(F.array(*map(F.lit, corpus.STEPS)), (F.col("id") % 5).cast("int")).alias("action"))
    return corpus.stepped(items, actions).select("id", "allowed", "status", "level", F.size("history").alias("steps"))


@query("SELECT event_id, event_type || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS run_name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def unique_run_ids(spark, sf_dir):
    return corpus.unique_ids(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "run_name")


@query("""SELECT conv_id, sum(t)::BIGINT AS tokens, round_even(sum(t * CASE role WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 15.0 ELSE 0 END / 1e6), 6) AS cost FROM (SELECT conv_id, role, octet_length(encode(coalesce(text, ''))) // 4 + 1 AS t FROM conversations) GROUP BY conv_id""")
def session_costs(spark, sf_dir):
    from tessera.functions.text import message_tokens

    usage = table(spark, sf_dir, "conversations").select("conv_id", "role", message_tokens(F.col("text")).alias("tokens"))
    return corpus.cost(usage, spark.createDataFrame([("user", 3.0), ("assistant", 15.0)], "role string, per_million double"), "conv_id", "role")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
o AS (SELECT * FROM l WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY pos) = 1),
u AS (SELECT *, row_number() OVER w AS n, sum(length(line) + 1) OVER w AS used FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos::INT AS pos, line FROM u WHERE n <= 24 AND used <= 1200""")
def summary_compression(spark, sf_dir):
    return corpus.compressed(table(spark, sf_dir, "documents"), "doc_id", "text", 24, 1200)


@query("SELECT a.doc_id AS doc_id, levenshtein(a.lang || a.source, b.source)::INT AS distance FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def edit_distances(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("next"))
    return d.join(after, "doc_id").select("doc_id", F.levenshtein(F.concat("lang", "source"), "next").alias("distance"))
