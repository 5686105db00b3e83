"""Queries of text search, listings and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import files
from tessera.plans.registry import query
from tessera.sources.tables import table
from tessera.streaming import best

_LINES = "(CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END)"
_L = f"SELECT doc_id, {_LINES} AS l FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS l0 FROM documents)"


@query(f"SELECT doc_id, array_to_string(l[3:7], chr(10)) AS content, 3 AS start_line, len(l[3:7]) AS lines, len(l) AS total_lines FROM ({_L})")
def line_windows(spark, sf_dir):
    return files.line_window(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 5)


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'licen[sc]e|[Pp]rice')) AS matches FROM documents WHERE regexp_matches(coalesce(text, ''), 'licen[sc]e|[Pp]rice')")
def match_counts(spark, sf_dir):
    return files.matching(table(spark, sf_dir, "documents"), "doc_id", "text", "licen[sc]e|[Pp]rice")


@query(f"""WITH x AS (SELECT doc_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM ({_L})), m AS (SELECT doc_id, line AS match FROM x WHERE regexp_matches(content, '(?i)licen[sc]e|password'))
SELECT doc_id, match::INT AS match, line::INT AS line, content FROM m JOIN x USING (doc_id) WHERE line BETWEEN match - 1 AND match + 2""")
def text_search(spark, sf_dir):
    return files.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "(?i)licen[sc]e|password", 1, 2)


@query("""SELECT path, rank, (SELECT count(*) > 20 FROM pages WHERE page_id % 3 <> 0) AS truncated FROM (SELECT 'a/b' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.md' END AS path, page_id % 3 AS k,
row_number() OVER (ORDER BY length(html) DESC, 'a/b' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.md' END) AS rank FROM pages WHERE page_id % 3 <> 0) WHERE rank <= 20""")
def newest_files(spark, sf_dir):
    path = F.concat(F.lit("a/b"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".md"))
    listing = table(spark, sf_dir, "pages").select(path.alias("path"), F.length("html").alias("mtime"))
    return files.newest(listing, "path", "mtime", "a/*.md", 20).select("path", "rank", "truncated")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 250 OFFSET 7")
def result_page(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", (-F.col("value")).alias("_v"))
    return files.page_of(e, ["_v", "event_id"], 7).drop("_v")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, role AS event, replace(text, chr(10), ' ') AS data, turn::VARCHAR AS last_id, CASE WHEN turn % 2 = 0 THEN turn * 10 END::BIGINT AS retry FROM conversations")
def stream_events(spark, sf_dir):
    retry = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("retry: "), (F.col("turn") * 10).cast("string"))).otherwise("retry: soon")
    block = F.concat_ws("\n", F.concat(F.lit("event: "), F.col("role")), F.lit(": comment"), F.concat(F.lit("id:"), F.col("turn").cast("string")), retry, F.concat(F.lit("data: "), F.translate("text", "\n", " ")))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("t"))
    return files.stream_events(turns.select("conv_id", F.array_join("t.b", "\n\n\n").alias("stream")), "conv_id", "stream")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return best.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("window.start").alias("start"), "event_type", "n")
