"""Search in and windows of text files, listings, and event streams, over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries a listing shows, and a search's default limit.
LISTED, LIMIT = 100, 250


def _lines(text: Column) -> Column:
    """Lines by line feeds, without carriage returns at their ends; a final line feed gives no empty line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", ""))
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def line_window(df: DataFrame, id_: str, text: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """id, content, start_line (from 1), lines, total_lines of a window of each text's lines."""
    lines = df.select(id_, _lines(F.col(text)).alias("_l"))
    part = F.slice("_l", offset + 1, limit if limit is not None else 2**31 - 1)
    return lines.select(id_, F.array_join(part, "\n").alias("content"), F.lit(offset + 1).cast("bigint").alias("start_line"), F.size(part).cast("bigint").alias("lines"), F.size("_l").cast("bigint").alias("total_lines"))


def matching(df: DataFrame, id_: str, text: str, pattern: str) -> DataFrame:
    """Texts with a match, and how many: id, matches (over the whole text, not by line)."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return df.select(id_, n.cast("bigint").alias("matches")).where("matches > 0")


def grep(df: DataFrame, id_: str, text: str, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """Lines that match, each with the lines around it: id, match (line from 1), line, content. Where matches lie
    close, their neighbours repeat. A text's lines stay in its row until they are picked."""
    lines = df.select(id_, _lines(F.col(text)).alias("_l"))
    hits = F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    each = lines.select(id_, "_l", F.explode(hits).alias("match"))
    around = F.sequence(F.greatest(F.lit(1), F.col("match") - before), F.least(F.size("_l"), F.col("match") + after))
    return each.select(id_, "match", F.explode(F.transform(around, lambda i: F.struct(i.alias("line"), F.get("_l", i - 1).alias("content")))).alias("x")).select(id_, "match", "x.line", "x.content")


def glob_pattern(glob: str) -> str:
    """A regular expression for a file name pattern with *, ** and ?."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "_/" else glob[i]), i + 1
    return f"^{out}\\z"


def newest(files: DataFrame, path: str, mtime: str, glob: str = "**/*", limit: int = LISTED) -> DataFrame:
    """The newest files that fit a pattern, with their rank; truncated tells whether there were more."""
    fits = files.where(F.col(path).rlike(glob_pattern(glob)))
    top = fits.orderBy(F.desc(mtime), path).limit(limit + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(mtime), path)).cast("bigint"))  # of limit + 1 rows
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("rank") <= limit)


def page_of(rows: DataFrame, order: list[str], offset: int = 0, limit: int = LIMIT) -> DataFrame:
    """Rows of a total order from an offset on; a limit of 0 takes all."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def stream_events(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Events of each event stream: id, n (from 0), event, data, last_id, retry.

    An empty line ends an event; lines that start with a colon are comments; data lines are joined by
    line feeds; of other fields the last counts. What the stream ends with is an event too. An event
    without any field isn't one."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, "\r\\z", ""))
    blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n(?:\n)+|^\n+", -1), lambda b: F.filter(F.split(b, "\n"), lambda x: (x != "") & ~x.startswith(":")))
    name = lambda x: F.substring_index(x, ":", 1)
    value = lambda x: F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, "^[^:]*: ?", "")).otherwise("")
    of = lambda b, field: F.transform(F.filter(b, lambda x: name(x) == field), value)
    last = lambda b, field: F.try_element_at(of(b, field), F.lit(-1))
    retry = lambda b: F.when(last(b, "retry").rlike("^[0-9]+\\z"), last(b, "retry").try_cast("bigint"))
    event = lambda b: F.struct(last(b, "event").alias("event"), of(b, "data").alias("d"), last(b, "id").alias("last_id"), retry(b).alias("retry"))
    real = F.filter(F.transform(blocks, event), lambda e: (F.size(e["d"]) > 0) | e["event"].isNotNull() | e["last_id"].isNotNull() | e["retry"].isNotNull())
    return df.select(id_, F.posexplode(real).alias("n", "e")).select(id_, "n", "e.event", F.array_join("e.d", "\n").alias("data"), "e.last_id", "e.retry")
