"""Quality rules: a threshold table compiled into one Spark projection.

Counts per text come first (``text_counts``); ``RULES`` maps each ratio of those counts to the
closed range it must lie in, and ``compile_rules`` turns the table into one boolean expression.
No user function runs: everything stays in Spark's own expressions, row by row, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, words

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is was for on as by this are or from it at an not but which "
    "le la les de des du un une et en à que qui dans pour par sur est au aux avec "
    "der die das und ist zu den von mit ein eine nicht auf für im dem des sich als auch "
    "el los las y que del se por con para una su al lo como es"
).split()

#: (name, ratio as SQL over text_counts' columns, least, most); None: no limit. Checked for texts with words.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("shouted_word_ratio", "n_shouted / n_words", None, 0.3),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("repeated_word_ratio", "n_repeat_words / n_words", None, 0.5),
]
MIN_WORDS = 50


def _kept_apart(count: Column) -> Column:
    """The count, with a term that never adds anything: a filter on what follows from the counts isn't pushed below a
    projection that holds it, where every use of the words would split the text again."""
    return count + (F.monotonically_increasing_id() < 0).cast("int")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_shouted.

    A null text counts as empty; an empty one has zeros. Columns of df with these names are replaced
    (and so are its columns that start with ``_q_``). Repeated rows are counted one by one.
    Words covered by a repeated three-word window are found by sorting (hash, position) pairs, so a
    long text costs n log n.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"_q_w": words(F.col(text)), "_q_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))})
    w = F.col("_q_w")
    out = out.withColumn(
        "_q_h",
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    h = F.col("_q_h")
    out = out.withColumn(
        "_q_z",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    z = F.col("_q_z")
    out = out.withColumn("_q_p", F.filter(z, lambda x, i: ((i > 0) & (F.get(z, i - 1)["h"] == x["h"])) | F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False))))
    covered = F.array_distinct(F.flatten(F.transform(F.col("_q_p"), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.col("_q_lines")
    longest = max(len(x.encode()) for x in STOP_WORDS)
    count = {
        "n_words": _kept_apart(F.size(w)),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.size(covered), F.lit(0)),
        "n_stop_words": F.size(F.filter(w, lambda x: (F.octet_length(x) <= longest) & F.lower(x).isin(STOP_WORDS))),
        # a word that starts with a to z isn't in capitals: most words need no case mapping
        "n_shouted": F.size(F.filter(w, lambda x: ~((x >= "a") & (x < "{")) & (F.length(x) >= 2) & (x == F.upper(x)) & (x != F.lower(x)))),
    }
    return out.withColumns({k: v.cast("long") for k, v in count.items()}).drop(*[c for c in out.columns if c.startswith("_q_")])


def compile_rules(rules=RULES) -> Column:
    """True where every ratio lies in its range; a ratio over zero is null and passes."""
    ok = F.lit(True)
    for _, ratio, least, most in rules:
        x = F.expr("try_divide(" + ", ".join(f"cast({p} as double)" for p in ratio.split(" / ")) + ")")
        if least is not None:
            ok = ok & F.coalesce(x >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(x <= most, F.lit(True))
    return ok


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """df with text_counts' columns, base_failed (too short, or more than half repeated) and kept.

    Null and empty texts have no words: base_failed is true and kept false. Repeated rows are judged one by
    one; an empty table gives an empty one. Columns of df named base_failed or kept are replaced.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = text_counts(df, text).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    """The same in DuckDB; windows and lines are compared as text."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = [f"coalesce({r} >= {lo}, true)" for _, r, lo, _ in RULES if lo is not None] + [f"coalesce({r} <= {hi}, true)" for _, r, _, hi in RULES if hi is not None]
    rules = " AND ".join(x.replace(" / ", "::double / nullif(", 1).replace(" >=", ", 0) >=").replace(" <=", ", 0) <=") for x in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
        len(list_filter(w, lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) AS n_shouted
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM f"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": _sql()}
