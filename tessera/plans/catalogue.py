"""All queries by name, with the SQL twins that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedup, packaging, retrieval
from tessera.plans import corpora, evaluation, folders, programs, records, reviews, searches, sessions  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, query  # noqa: F401
from tessera.sources.tables import table
from tessera.streaming import best


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS first_seq FROM events GROUP BY ALL")
def dedup_last_value(spark, sf_dir):
    return dedup.last_value_first_place(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "first_seq")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def dedup_best_first(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("value"), "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id > first")
def duplicate_texts(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return dedup.duplicates(keyed, "key", "doc_id").select("doc_id", F.col("first_line").alias("first"))


@query("""SELECT user_id, event_id, value, best, coalesce(value >= before, true) AS is_best FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best,
max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)""")
def running_best(spark, sf_dir):
    return dedup.running_best(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, max(value) AS best, max(event_id) FILTER (value = m) AS seq, count(*) AS attempts FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def best_attempts(spark, sf_dir):
    return best.best_so_far(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'), lambda x: lower(x))"
_POSTINGS = f"WITH t AS (SELECT doc_id AS passage, unnest({_TOKENS}) AS token FROM documents), i AS (SELECT passage, token, count(*) AS tf FROM t GROUP BY ALL)"


@query(f"{_POSTINGS} SELECT token, count(*) AS df FROM i GROUP BY token")
def document_frequency(spark, sf_dir):
    return retrieval.token_frequency(table(spark, sf_dir, "documents"), "text")


@query(f"""{_POSTINGS}, q AS (SELECT item_id AS query, token, count(*) AS weight FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM i GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT query, passage, round_even(sum(weight * (ln((n + 1) / (df + 0.5)) + 1) * tf / (tf + 1.2::DOUBLE)), 4) AS score FROM q JOIN i USING (token) JOIN f USING (token), n GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank, passage, score FROM s WHERE score > 0 QUALIFY rank <= 5""")
def search_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return retrieval.search(retrieval.postings(docs, "doc_id", "text"), docs.count(), table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""{_POSTINGS}, b AS (SELECT item_id AS query, lower(split_part(text, ' ', 1)) AS first, CASE WHEN item_id % 3 = 0 THEN left(split_part(text, ' ', 2), 2) ELSE text END AS text FROM benchmark),
t2 AS (SELECT query, unnest({_TOKENS}) AS token FROM b), q AS (SELECT query, token, count(*) AS weight FROM t2 GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM i GROUP BY token), n AS (SELECT count(*) AS n FROM documents), p AS (SELECT doc_id AS passage, lower(source || '_' || lang || left(text, 3)) AS file, lower(left(text, 20)) AS heading FROM documents),
s AS (SELECT query, passage, weight * (ln((n + 1) / (df + 0.5)) + 1) * tf / (tf + 1.2::DOUBLE) AS x FROM q JOIN i USING (token) JOIN f USING (token), n
  UNION ALL SELECT query, passage, 0.8 FROM q JOIN p ON contains(file, token) UNION ALL SELECT query, passage, 0.6 FROM q JOIN p ON contains(heading, token) UNION ALL SELECT query, passage, 2 FROM b JOIN p ON contains(file, lower(b.text)) WHERE b.text <> ''),
r AS (SELECT query, passage, round_even(sum(x), 4) AS score FROM s GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, passage) AS rank, passage, score FROM r WHERE score > 0 QUALIFY rank <= 5""")
def search_named_passages(spark, sf_dir):
    """Half of the queries are short and stand in file names."""
    docs = table(spark, sf_dir, "documents")
    names = docs.select(F.col("doc_id").alias("passage"), F.lower(F.concat("source", F.lit("_"), "lang", F.substring("text", 1, 3))).alias("file"), F.lower(F.substring("text", 1, 20)).alias("heading"))
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.substring(word(2), 1, 2)).otherwise(F.col("text")).alias("text"))
    return retrieval.search(retrieval.postings(docs, "doc_id", "text"), docs.count(), queries, "item_id", "text", names=names)


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 6000")
def pack_context(spark, sf_dir):
    return retrieval.pack_context(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 6000).select("source", "doc_id", "used")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_user_text(spark, sf_dir):
    return packaging.latest_user_text(table(spark, sf_dir, "conversations"))


_TURN_TOKENS = "(octet_length(encode(coalesce(text, ''))) // 4 + 1)::BIGINT"


@query(f"""WITH t AS (SELECT *, {_TURN_TOKENS} AS tokens FROM conversations),
x AS (SELECT *, count(*) OVER w AS n, sum(tokens) OVER w AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, role, tokens, CASE WHEN n > 4 AND total >= 200 THEN n - 4 ELSE 0 END AS removed FROM x WHERE NOT (n > 4 AND total >= 200) OR back <= 4""")
def compact_conversations(spark, sf_dir):
    return packaging.compact(table(spark, sf_dir, "conversations"))


@query(f"SELECT conv_id, turn, {_TURN_TOKENS} AS tokens, (sum({_TURN_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS total FROM conversations")
def usage_totals(spark, sf_dir):
    return packaging.usage_totals(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    chat = packaging.chat(table(spark, sf_dir, "conversations"))
    return chat.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@query("SELECT CASE WHEN year(o_orderdate) = 1997 THEN 'val' WHEN year(o_orderdate) = 1998 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def year_split(spark, sf_dir):
    label = packaging.split_label(F.year("o_orderdate"), [1997], [1998])
    return table(spark, sf_dir, "orders").groupBy(label.alias("split")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'text empty' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'invalid lang' END,
CASE WHEN n_chars < 200 THEN 'too short' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents""")
def validate_records(spark, sf_dir):
    rules = [("text empty", F.trim(F.coalesce("text", F.lit(""))) == ""), ("invalid lang", F.col("lang").isNull() | ~F.col("lang").isin("en", "de", "fr")), ("too short", F.col("n_chars") < 200)]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(packaging.issues(rules), "; ").alias("issues"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) OR d.lang = 'en'")
def accepted_or_english(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return packaging.accepted_or(table(spark, sf_dir, "documents"), good, "doc_id", F.col("lang") == "en").select("doc_id")


def _entities(x: str) -> str:
    for entity, sign in T.ENTITIES:
        x = f"replace({x}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, {_entities("replace(regexp_replace(html, '<[^>]*(>|\\z)', '', 'g'), '>', '')")} AS text,
nullif({_entities("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '') AS title FROM pages""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"), T.title(F.col("html")).alias("title"))


_GEOMETRY = "'\\b(triangle|area|coordinates?)\\b|geometry|heron|collinear'"


@query(f"""WITH b AS (SELECT item_id, text, lower(replace(text, '-', '_')) AS low, list_filter(['How', 'many', 'total'], lambda w: contains(lower(text), lower(w))) AS found FROM benchmark)
SELECT item_id, CASE WHEN length(text) > 40 THEN rtrim(text[:40]) || '…' ELSE text END AS preview, greatest(1, length(text) // 5)::BIGINT AS tokens, greatest(1, length(text) // 4)::BIGINT AS code_tokens, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
CASE WHEN item_id % 10 = 3 THEN 'game_simulation' WHEN regexp_matches(low, {_GEOMETRY}) THEN 'geometry' WHEN regexp_matches(low, 'game_simulation|game simulation|guess|points|win|srand|random') THEN 'game_simulation'
WHEN regexp_matches(low, 'pattern|stars|pyramid|diamond|rows') THEN 'pattern_generation' WHEN regexp_matches(low, 'series|sum|factorial|term_i|rational') THEN 'series_calculation' ELSE 'unknown' END AS topic,
array_to_string(found, ',') AS found, round_even(len(found) / 3, 3) AS keyword_score FROM b""")
def text_functions(spark, sf_dir):
    x, words = F.col("text"), F.array(*map(F.lit, ("How", "many", "total")))
    topic = T.topic_of(x, F.when(F.col("item_id") % 10 == 3, "Guessing game"))
    return table(spark, sf_dir, "benchmark").select(
        "item_id", T.preview(x, 40).alias("preview"), T.estimated_tokens(x).alias("tokens"), T.estimated_tokens(x, F.lit("code")).alias("code_tokens"), T.slug(x).alias("slug"), topic.alias("topic"),
        F.array_join(T.keywords_found(x, words)[0], ",").alias("found"), T.keyword_score(x, words).alias("keyword_score"),
    )


@query(f"""WITH f AS (SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS name, CASE WHEN doc_id % 2 = 0 THEN '# Part ' || coalesce(lang, '') || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, name, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM f),
h AS (SELECT *, starts_with(ltrim(line, ' ' || chr(9)), '#') AS head FROM l),
g AS (SELECT *, CASE WHEN ends_with(name, '.md') THEN sum((head AND pos > 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) ELSE pos // 40 END AS passage FROM h),
t AS (SELECT doc_id, passage, string_agg(line, chr(10) ORDER BY pos) AS text FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS passages FROM t WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id""")
def file_passages(spark, sf_dir):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt"))
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Part "), F.coalesce("lang", F.lit("")), F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    files = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), text.alias("text"))
    return retrieval.passages_of(files, "doc_id", "name", "text").groupBy("doc_id").agg(F.count("*").alias("passages"))
