"""Sessions kept as one JSON object or as JSON lines, contents that are text or lists of blocks, summaries under a budget, sign-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How core lines of a summary begin, and lines that are core as they are.
CORE = ("- Scope:", "- Current work:", "- Pending work:", "- Key files referenced:", "- Tools mentioned:", "- Recent user requests:", "- Previously compacted context:", "- Newly compacted context:")
TITLES = ("Summary:", "Conversation summary:")


def _texts(value: Column, kind: str = "text") -> Column:
    """Texts of the blocks of a list of blocks, null for other blocks."""
    blocks = F.try_variant_get(value, "$", "array<variant>")
    return F.transform(blocks, lambda b: F.when(F.try_variant_get(b, "$.type", "string") == kind, F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def flattened(content: Column) -> Column:
    """Text of a content (a variant): itself if it is text; of a list of blocks the texts of its text blocks and of what its
    tool results hold (text, or a list of text blocks), parted by line feeds; anything else is empty."""

    def of_block(b: Column) -> Column:
        kind, inner = F.try_variant_get(b, "$.type", "string"), F.try_variant_get(b, "$.content", "variant")
        nested = F.when(_is_text(inner), F.array(F.try_variant_get(b, "$.content", "string"))).otherwise(_texts(inner))
        return F.when(kind == "text", F.array(F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))).when(kind == "tool_result", nested)

    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.filter(F.coalesce(of_block(b), F.array().cast("array<string>")), lambda t: t.isNotNull()))
    return F.when(_is_text(content), F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(F.flatten(parts), "\n"), F.lit("")))


def messages(sessions: DataFrame, id_: str, text: str) -> DataFrame:
    """id_, n (from 0), role, text of each message of sessions, in either format.

    A text that is an object with messages is one session; any other is JSON lines, of which those of type message
    count. Blank lines are skipped. A line that isn't an object with a type gives a row with null role and text, so a broken
    session shows. A null text has no messages."""
    body = F.try_parse_json(F.col(text))
    listed = F.try_variant_get(body, "$.messages", "array<variant>")
    lines = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), lambda x: F.trim(x, F.lit(" \t\r")) != ""), F.try_parse_json)
    kind = lambda v: F.try_variant_get(v, "$.type", "string")
    of_lines = F.transform(F.filter(lines, lambda v: F.coalesce(kind(v) == "message", F.lit(True))), lambda v: F.try_variant_get(v, "$.message", "variant"))
    each = sessions.select(F.col(id_), F.posexplode(F.coalesce(listed, of_lines)).alias("n", "_m"))
    role = F.try_variant_get("_m", "$.role", "string")
    content = F.coalesce(F.try_variant_get("_m", "$.content", "variant"), F.try_variant_get("_m", "$.blocks", "variant"))
    return each.select(id_, "n", role.alias("role"), F.when(F.col("_m").isNotNull(), flattened(content)).alias("text"))


def _fitted(line: Column, most: int) -> Column:
    return F.when((F.length(line) <= most) | F.lit(most == 0), line).otherwise(F.concat(F.substring(line, 1, most - 1), F.lit("…")))


def compressed(rows: DataFrame, id_: str, text: str, max_chars: int = 1200, max_lines: int = 24, max_line_chars: int = 160) -> DataFrame:
    """id_, summary, lines, repeats (lines dropped as they came before), omitted of each text under a budget.

    Lines lose outer and repeated white space, are cut to max_line_chars, and count once whatever their case (of A to Z). They are
    tried by priority (core lines, headings that end with a colon, list items, others) and place; one that doesn't fit is
    passed over and later ones are tried still. The chosen ones stand in the text's order, and what was left out is told in a
    last line if it fits. Of a text in which no line fits the first is cut to max_chars. A text without lines has an
    empty summary."""
    spaces = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    clean = _fitted(F.trim(F.regexp_replace("_l", spaces, " ")), max_line_chars)
    each = rows.select(F.col(id_).alias("_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_at", "_l")).select("_id", "_at", clean.alias("_l")).where("_l <> ''")
    key = F.translate("_l", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = each.groupBy("_id", key.alias("_k")).agg(F.min(F.struct("_at", "_l")).alias("_f"), F.count("*").alias("_n"))
    line = F.col("_f._l")
    core = line.isin(*TITLES)
    for start in CORE:
        core = core | line.startswith(start)
    priority = F.when(core, 0).when(line.endswith(":"), 1).when(line.startswith("- "), 2).otherwise(3)
    whole = once.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(priority.alias("p"), F.col("_f._at").alias("at"), line.alias("l")))).alias("_ls"), F.sum(F.col("_n") - 1).alias("repeats"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("chars"), F.array().cast("array<struct<at:int,l:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < max_lines) & (s["chars"] + F.length(x["l"]) + s["n"] <= max_chars)
        taken = F.struct((s["n"] + 1).alias("n"), (s["chars"] + F.length(x["l"])).alias("chars"), F.array_append(s["out"], F.struct(x["at"].alias("at"), x["l"].alias("l"))).alias("out"))
        return F.when(fits, taken).otherwise(s)

    first = F.sort_array(F.transform("_ls", lambda x: F.struct(x["at"].alias("at"), x["l"].alias("l"))))[0]["l"]
    none = F.array().cast("array<string>") if not max_chars or not max_lines else F.array(_fitted(first, max_chars))
    chosen = F.transform(F.sort_array(F.aggregate("_ls", start, step)["out"]), lambda x: x["l"])
    out = whole.select("_id", "repeats", F.size("_ls").alias("_all"), F.when(F.size(chosen) == 0, none).otherwise(chosen).alias("_c"))
    out = out.withColumn("omitted", F.col("_all") - F.size("_c"))
    notice = F.concat(F.lit("- … "), F.col("omitted").cast("string"), F.lit(" additional line(s) omitted."))
    joined = F.array_join("_c", "\n")
    fits = (F.col("omitted") > 0) & (F.size("_c") < max_lines) & (F.length(joined) + 1 + F.length(notice) <= max_chars)
    told = out.select("_id", F.when(fits, F.array_append("_c", notice)).otherwise(F.col("_c")).alias("_c"), "repeats", "omitted")
    back = rows.select(F.col(id_)).join(told, F.col(id_) == F.col("_id"), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return back.select(id_, F.coalesce(F.array_join("_c", "\n"), F.lit("")).alias("summary"), number(F.size(F.coalesce("_c", F.array().cast("array<string>")))).alias("lines"), number(F.col("repeats")).alias("repeats"), number(F.col("omitted")).alias("omitted"))


#: Names that stand for no reviewer.
UNSIGNED = ("", "null", "none", "unsigned", "fill_in", "fill-in", "todo")


def signed_off(results: DataFrame, signoffs: DataFrame, id_: str = "id", status: str = "status") -> DataFrame:
    """results with tier and signed_by: approved rows that a sign-off covers are human_verified, others keep a null tier.

    signoffs: signed_off_by, scope (all, or anything else for the listed ids), scope_ids. One without a reviewer's name
    covers nothing; of several, one for the row's own id counts before one for all, and the first name by order. A scope is exploded
    into its keys, so rows meet it by one equi-join: each row by its id and by the key of all."""
    by = F.trim(F.coalesce("signed_off_by", F.lit("")))
    real = signoffs.where(~F.lower(by).isin(*UNSIGNED)).select(by.alias("_by"), F.when(F.col("scope") == "all", F.array(F.lit(None).cast("string"))).otherwise(F.transform("scope_ids", lambda x: x.cast("string"))).alias("_ids"))
    scopes = real.select("_by", F.explode("_ids").alias("_id")).groupBy(F.col("_id").isNull().alias("_all"), F.coalesce("_id", F.lit("")).alias("_key")).agg(F.min("_by").alias("_by"))
    keys = F.array(F.struct(F.lit(False).alias("_all"), F.col(id_).cast("string").alias("_key")), F.struct(F.lit(True).alias("_all"), F.lit("").alias("_key")))
    approved = results.where(F.col(status) == "approved").select(F.col(id_).alias("_row"), F.explode(keys).alias("_k")).select("_row", "_k._all", "_k._key").distinct()
    best = approved.join(scopes, ["_all", "_key"]).groupBy("_row").agg(F.min(F.struct("_all", "_by"))["_by"].alias("signed_by"))
    out = results.join(best, (F.col(id_) == F.col("_row")) & (F.col(status) == "approved"), "left").drop("_row")
    return out.withColumn("tier", F.when(F.col("signed_by").isNotNull(), "human_verified"))
