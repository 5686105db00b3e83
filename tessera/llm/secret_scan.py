"""Secret scan with corpus-wide ownership frequency.

Base patterns give spans in every text. Hashes of all candidates (base ones and further credential
shapes) are aggregated by distinct repositories and owners over the whole corpus: a value held by
many owners, or in very many repositories, is a copied example; one held by few looks live. Further
shapes become spans only where they look live. Spark expressions only: no user functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Base kinds in their fixed order: (kind, pattern, group that holds the secret, its least length).
#: Longest runs are matched first and the least length checked after, or put into the pattern where that gives the same spans.
BASE = [
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
#: Further shapes: published token prefixes, signed tokens; and long mixed strings.
EXTRA = [
    ("key", "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24,}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", None),
    ("mixed", "[A-Za-z0-9+_=-]{24,}", ("[0-9]", "[A-Z]", "[a-z]")),
]
#: First and last line of a private key block. The block is the secret as a whole, as first lines are the same in all keys.
KEY_LINE = "-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A value counts as an example from so many owners, or so many repositories, on; below both it looks live.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100
_MATCH = "array<struct<start:bigint,end:bigint,value:string>>"


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: start, end (code points) and value of the group. A split gives the text
    between matches, so a running sum of lengths gives the places."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_MATCH).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        match = F.struct(start.alias("start"), end.alias("end"), x["2"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(s["out"], match).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("0"), found.alias("1"), values.alias("2"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, state, step, lambda s: s["out"])).otherwise(F.array().cast(_MATCH))


def _span(m: Column, kind: str, rank: int, secret: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(secret, 256).alias("hash"))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, needs=()) -> Column:
    """Spans of the matches whose value is long enough and matches all of needs."""

    def good(m: Column) -> Column:
        ok = F.length(m["value"]) >= least
        for p in needs:
            ok = ok & m["value"].rlike(p)
        return ok

    return F.transform(F.filter(_matches(text, pattern, group), good), lambda m: _span(m, kind, rank, m["value"]))


def _key_blocks(text: Column) -> Column:
    """Spans from a BEGIN line to the END line that comes next, whatever lies between; a BEGIN line that another
    one follows starts none. Lines are found in one pass, so many BEGIN lines without an end cost no more."""
    lines = _matches(text, KEY_LINE, 1)
    pairs = F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end"), F.concat(x["value"], y["value"]).alias("value")))
    blocks = F.filter(pairs, lambda m: F.coalesce(m["value"] == "BEGINEND", F.lit(False)))
    return F.transform(blocks, lambda m: _span(m, "key", len(BASE), F.substring(text, m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _base and _extra: spans with the hash of their secret. Extra spans never overlap base ones."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_base", F.concat(*[_spans(t, k, i, p, g, n) for i, (k, p, g, n) in enumerate(BASE)]))
    extra = F.concat(*[_spans(t, "key", len(BASE), p, 0, 1, needs or ()) for _, p, needs in EXTRA], _key_blocks(t))
    free = F.filter(F.array_distinct(extra), lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn("_extra", free)


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: n_repos, n_owners. found: _hash, _repo, _owner."""
    return found.groupBy("_hash", "_owner", "_repo").count().groupBy("_hash").agg(F.count_distinct("_repo").alias("_n_repos"), F.count_distinct("_owner").alias("_n_owners"))


def example(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners >= EXAMPLE_OWNERS) | (n_repos >= EXAMPLE_REPOS)


def secret_scan(df: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """df without its text, with spans (array of start, rank, end, kind, hash, n_repos, n_owners), sorted.

    All base spans and, of the further shapes, those whose value looks live: fewer than EXAMPLE_OWNERS
    owners and fewer than EXAMPLE_REPOS repositories hold it, so a copy or two of a document don't hide its
    credentials. A null text is empty
    and has no spans; null owners count as one owner, null repositories as one. Repeated rows are
    scanned one by one; the same value in them counts once per repository. An empty table gives an
    empty one. Columns of df that start with an underscore as the inner ones do, or are named spans,
    are replaced. Equal spans of two further shapes count once.
    """
    keep = [c for c in df.columns if c not in (text, "spans", "_base", "_extra", "_rid", "_repo", "_owner")]
    null = F.lit("\x00")
    named = candidates(df, text).select(*keep, F.coalesce(F.col(repo).cast("string"), null).alias("_repo"), F.coalesce(F.col(owner).cast("string"), null).alias("_owner"), "_base", "_extra")
    rows = stage(named.withColumn("_rid", F.monotonically_increasing_id()), "secrets")
    each = rows.select("_rid", "_repo", "_owner", F.explode(F.concat("_base", "_extra")).alias("_s")).withColumn("_hash", F.col("_s.hash"))
    judged = each.join(ownership(each), "_hash").where((F.col("_s.rank") < len(BASE)) | ~example(F.col("_n_owners"), F.col("_n_repos")))
    span = F.struct("_s.start", "_s.rank", "_s.end", "_s.kind", "_s.hash", F.col("_n_repos").alias("n_repos"), F.col("_n_owners").alias("n_owners"))
    spans = judged.groupBy("_rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return rows.join(spans, "_rid", "left").select(*keep, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    s = F.col("spans")
    kind = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[kind(k).alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_text(F.filter(s, lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
        _text(s).alias("spans"),
        F.size(F.filter(s, lambda x: ~example(x["n_owners"], x["n_repos"]))).cast("long").alias("n_live"),
        F.size(F.filter(s, lambda x: example(x["n_owners"], x["n_repos"]))).cast("long").alias("n_example"),
    )


def _sql() -> str:
    kinds = [(k, i, p, g, n, ()) for i, (k, p, g, n) in enumerate(BASE)] + [("key", len(BASE), p, 0, 1, needs or ()) for _, p, needs in EXTRA]
    each = []
    for k, i, p, g, n, needs in kinds:
        p = p.replace("'", "''")
        ok = " AND ".join([f"length(v) >= {n}"] + [f"regexp_matches(v, '{x}')" for x in needs])
        each.append(
            f"SELECT r, source, doc_id, '{k}' AS kind, {i} AS rank, start, start + length(m) AS stop, sha256(v) AS hash FROM ("
            f"SELECT r, source, doc_id, m[j] AS m, v[j] AS v, length(array_to_string(p[:j], '')) + length(array_to_string(m[:j - 1], '')) AS start FROM ("
            f"SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT r, source, doc_id, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v FROM d WHERE regexp_matches(t, '{p}')))) WHERE {ok}"
        )
    each.append(
        f"SELECT r, source, doc_id, 'key' AS kind, {len(BASE)} AS rank, start, stop, sha256(substr(t, start + 1, stop - start)) AS hash FROM (SELECT *, lead(start + length(m)) OVER w AS stop, v || lead(v) OVER w AS ends FROM ("
        f"SELECT r, source, doc_id, t, m[j] AS m, v[j] AS v, length(array_to_string(p[:j], '')) + length(array_to_string(m[:j - 1], '')) AS start FROM ("
        f"SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT r, source, doc_id, t, string_split_regex(t, '{KEY_LINE}') AS p, regexp_extract_all(t, '{KEY_LINE}', 0) AS m, regexp_extract_all(t, '{KEY_LINE}', 1) AS v FROM d WHERE regexp_matches(t, '{KEY_LINE}'))"
        f")) WINDOW w AS (PARTITION BY r ORDER BY start)) WHERE ends = 'BEGINEND'"
    )
    text = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({' UNION '.join(each)}),
f AS (SELECT * FROM c WHERE rank < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM c b WHERE b.rank < {len(BASE)} AND b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
n AS (SELECT hash, count(DISTINCT coalesce(source, chr(0))) >= {EXAMPLE_OWNERS} OR count(DISTINCT coalesce(doc_id::VARCHAR, chr(0))) >= {EXAMPLE_REPOS} AS example FROM f GROUP BY 1),
s AS (SELECT f.*, example FROM f JOIN n USING (hash) WHERE rank < {len(BASE)} OR NOT example),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg({text}) FILTER (rank < {len(BASE)}) AS base, string_agg({text}) AS spans, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN a USING (r)"""


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL = {"op4_secret_scan": _sql()}
