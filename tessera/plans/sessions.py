"""Queries of catalogue search, routing, sessions, summaries under a budget and sign-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search, sessions
from tessera.plans.registry import query
from tessera.sources.tables import table

_ENTRIES = "SELECT replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_partkey % 9 = 0 THEN 'Tool' ELSE '' END AS name, p_type || ', ' || p_brand AS d, p_partkey, p_name, p_type, p_brand FROM part"
_QUERIES = """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'select: ' || upper(name) || ', nothing,' || replace(name, '_', '-') WHEN 1 THEN '+' || split_part(p_name, ' ', 1) || ' ' || p_type || ' +'
WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || p_brand || '  -- ' ELSE substr(p_name, 2, 4) || ' ' || p_partkey END AS query FROM supplier JOIN e ON p_partkey = s_suppkey"""


def _entries(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 9 == 0, "Tool").otherwise(""))
    return p.select(name.alias("name"), F.concat_ws(", ", "p_type", "p_brand").alias("d"), "p_partkey", "p_name", "p_type", "p_brand")


def _queries(spark, sf_dir):
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    k = F.col("s_suppkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("select: "), F.upper("name"), F.lit(", nothing,"), F.replace("name", F.lit("_"), F.lit("-"))))
        .when(k == 1, F.concat(F.lit("+"), word(1), F.lit(" "), "p_type", F.lit(" +")))
        .when(k == 2, F.concat(word(2), F.lit(" "), "p_brand", F.lit("  -- ")))
        .otherwise(F.concat(F.substring("p_name", 2, 4), F.lit(" "), F.col("p_partkey").cast("string")))
    )
    return table(spark, sf_dir, "supplier").join(_entries(spark, sf_dir), F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", text.alias("query"))


_CANON = lambda x: f"regexp_replace(lower(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')), 'tool$', '')"


@query(f"""WITH e AS ({_ENTRIES}), q AS ({_QUERIES}), c AS (SELECT name, lower(name) AS low, {_CANON("name")} AS c, lower(name) || ' ' || lower(d) || ' ' || {_CANON("name")} AS txt,
  {_CANON("name")} || ' ' || array_to_string(list_transform(list_filter(string_split_regex(d, '[\\s,]+'), lambda w: w <> ''), lambda w: {_CANON("w")}), ' ') AS plain FROM e),
w AS (SELECT s_suppkey, unnest(list_filter(string_split_regex(trim(lower(query)), '\\s+'), lambda w: w NOT IN ('', '+'))) AS w FROM q WHERE NOT starts_with(query, 'select:')),
t AS (SELECT s_suppkey, regexp_replace(w, '^[+]', '') AS t, starts_with(w, '+') AS must, {_CANON("regexp_replace(w, '^[+]', '')")} AS k FROM w),
s AS (SELECT s_suppkey, name, sum(2 * contains(txt, t)::INT + 8 * (low = t)::INT + 4 * contains(low, t)::INT + CASE WHEN k = '' THEN 0 ELSE 12 * (c = k)::INT + 3 * contains(plain, k)::INT END) AS score, bool_and(NOT must OR contains(txt, t)) AS ok FROM t, c GROUP BY ALL),
r AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, name) AS rank, name, score::BIGINT AS score FROM s WHERE ok AND score > 0 QUALIFY rank <= 5),
l AS (SELECT s_suppkey, unnest(string_split(substr(query, 8), ',')) AS x, unnest(range(len(string_split(query, ',')))) AS pos FROM q WHERE starts_with(query, 'select:')),
n AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY pos) AS rank, name, NULL::BIGINT AS score FROM l JOIN c ON c.c = {_CANON("x")} AND c.c <> '')
SELECT * FROM r UNION ALL SELECT * FROM n WHERE rank <= 5""")
def catalogue_search(spark, sf_dir):
    return search.search(_queries(spark, sf_dir), "s_suppkey", "query", _entries(spark, sf_dir), "name", "d")


@query(f"""WITH e AS ({_ENTRIES}), q AS ({_QUERIES}), w AS (SELECT DISTINCT s_suppkey, unnest(string_split_regex(lower(replace(replace(query, '/', ' '), '-', ' ')), '\\s+')) AS w FROM q),
h AS (SELECT s_suppkey, CASE WHEN p_partkey % 3 = 0 THEN 'tool' ELSE 'command' END AS kind, name, count(*) AS score FROM w JOIN e ON w <> '' AND contains(lower(name || ' ' || d), w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, kind ORDER BY score DESC, name) = 1 AS head FROM h)
SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY head DESC, CASE WHEN head THEN kind END NULLS LAST, score DESC, kind, name) AS rank, kind, name, score FROM k QUALIFY rank <= 5""")
def catalogue_routes(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "tool").otherwise("command")
    entries = _entries(spark, sf_dir).select(kind.alias("kind"), "name", F.lower(F.concat_ws(" ", "name", "d")).alias("text"))
    return search.route(_queries(spark, sf_dir), "s_suppkey", "query", entries)


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n, role, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) WHEN 2 THEN role || chr(10) || text ELSE '' END AS text FROM conversations""")
def session_messages(spark, sf_dir):
    """Sessions of even conversations as one object, of odd ones as JSON lines; contents as text and as lists of blocks."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")
    t, k = quoted("text"), F.col("turn") % 4
    content = (
        F.when(k == 0, t)
        .when(k == 1, F.concat(F.lit('[{"type": "text", "text": '), t, F.lit('}, {"type": "image", "text": "no"}, 7, {"type": "text"}]')))
        .when(k == 2, F.concat(F.lit('[{"type": "tool_result", "content": '), quoted("role"), F.lit('}, {"type": "tool_result", "content": [{"type": "text", "text": '), t, F.lit('}, {"type": "other"}]}]')))
        .otherwise(F.lit('{"type": "text"}'))
    )
    message = F.concat(F.lit('{"role": '), quoted("role"), F.lit(', "content": '), content, F.lit("}"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", message.alias("m")))).alias("t"))
    object_ = F.concat(F.lit('{"version": 1, "messages": ['), F.array_join("t.m", ",\n"), F.lit("]}"))
    lines = F.concat(F.lit('{"type": "session_meta", "version": 1}\n\n'), F.array_join(F.transform("t.m", lambda m: F.concat(F.lit('{"type": "message", "message": '), m, F.lit("}"))), "\r\n"), F.lit('\n{"type": "compaction"}'))
    stored = turns.select("conv_id", F.when(F.col("conv_id") % 2 == 0, object_).otherwise(lines).alias("session"))
    return sessions.messages(stored, "conv_id", "session")


_CORE = " OR ".join(f"starts_with(l, '{c}')" for c in sessions.CORE)
_LIST = lambda x: f"replace(replace(coalesce({x}, ''), '. ', chr(10)), ',', ':' || chr(10) || '- ')"


@query(f"""WITH x AS (SELECT doc_id, {_LIST("text")} AS t FROM documents), y AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS pos, unnest(string_split(t, chr(10))) AS l0 FROM x),
z AS (SELECT doc_id, pos, trim(regexp_replace(l0, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS l1 FROM y),
c AS (SELECT doc_id, pos, CASE WHEN length(l1) <= 60 THEN l1 ELSE left(l1, 59) || '…' END AS l FROM z WHERE l1 <> ''),
o AS (SELECT *, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM c),
d AS (SELECT doc_id, pos, l, CASE WHEN l IN ('Summary:', 'Conversation summary:') OR {_CORE} THEN 0 WHEN ends_with(l, ':') THEN 1 WHEN starts_with(l, '- ') THEN 2 ELSE 3 END AS p FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) = 1),
r AS (SELECT doc_id, (SELECT count(*) FROM o WHERE o.doc_id = d.doc_id) - count(*) AS repeats, count(*) AS n_all, arg_min(l, pos) AS first,
  list_reduce([{{'n': 0::BIGINT, 'c': 0::BIGINT, 'o': []::STRUCT(pos BIGINT, l VARCHAR)[]}}] || list({{'n': 1::BIGINT, 'c': length(l)::BIGINT, 'o': [{{'pos': pos, 'l': l}}]}} ORDER BY p, pos),
    lambda a, b: CASE WHEN a.n < 8 AND a.c + b.c + a.n <= 260 THEN {{'n': a.n + 1, 'c': a.c + b.c, 'o': a.o || b.o}} ELSE a END).o AS chosen FROM d GROUP BY doc_id),
f AS (SELECT doc_id, repeats, n_all, CASE WHEN len(chosen) = 0 THEN [CASE WHEN length(first) <= 260 THEN first ELSE left(first, 259) || '…' END] ELSE list_transform(list_sort(chosen), lambda s: s.l) END AS ls FROM r),
g AS (SELECT *, n_all - len(ls) AS omitted, array_to_string(ls, chr(10)) AS s, '- … ' || (n_all - len(ls)) || ' additional line(s) omitted.' AS notice FROM f),
h AS (SELECT *, omitted > 0 AND len(ls) < 8 AND length(s) + 1 + length(notice) <= 260 AS fits FROM g)
SELECT doc_id, coalesce(CASE WHEN fits THEN s || chr(10) || notice ELSE s END, '') AS summary, coalesce(len(ls) + fits::INT, 0)::BIGINT AS lines, coalesce(repeats, 0)::BIGINT AS repeats, coalesce(omitted, 0)::BIGINT AS omitted FROM documents LEFT JOIN h USING (doc_id)""")
def prioritised_summaries(spark, sf_dir):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n")), F.lit(","), F.lit(":\n- "))
    return sessions.compressed(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text", 260, 8, 60)


@query("""WITH o AS (SELECT n_nationkey AS k, trim(CASE WHEN n_nationkey % 5 = 0 THEN ' ToDo ' ELSE n_name END) AS by_ FROM nation WHERE n_nationkey % 5 <> 0),
r AS (SELECT s_suppkey AS id, s_nationkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM supplier)
SELECT id, status, CASE WHEN status = 'approved' THEN coalesce((SELECT min(by_) FROM o WHERE o.k = r.k AND o.k NOT IN (3, 8)), (SELECT min(by_) FROM o WHERE o.k = 3)) END AS signed_by,
CASE WHEN status = 'approved' THEN 'human_verified' END AS tier FROM r""")
def signed_results(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    listed = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_suppkey").alias("scope_ids"))
    by = F.when(F.col("n_nationkey") % 5 == 0, " ToDo ").otherwise(F.col("n_name"))
    scope = F.when(F.col("n_nationkey") == 3, "all").when(F.col("n_nationkey") != 8, "ids")
    offs = table(spark, sf_dir, "nation").join(listed, "n_nationkey", "left").select(by.alias("signed_off_by"), scope.alias("scope"), F.when(F.col("n_nationkey") != 8, F.col("scope_ids")).alias("scope_ids"))
    results = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "rejected").otherwise("approved").alias("status"))
    return sessions.signed_off(results, offs)
