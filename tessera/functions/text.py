"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities and what they stand for, in the order of replacement.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
#: Points of each part of a score.
WEIGHTS = {"structure": 15, "keyword": 15, "compile": 40, "runtime": 30}


#: White space as Unicode has it, and line ends (a carriage return and line feed are one).
SPACES = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, and single CJK signs, in lower case. A to Z are lowered once, before."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit("[a-z0-9_]+|[\\x{4e00}-\\x{9fff}]"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+\\z", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def decode_entities(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def html_to_text(html: Column) -> Column:
    """Text without tags (an open one runs to the end), entities decoded, white space collapsed."""
    return collapse(decode_entities(F.replace(F.regexp_replace(html, "<[^>]*(>|\\z)", ""), F.lit(">"), F.lit(""))))


def title(html: Column) -> Column:
    """The page's title, else the first line with text of the page's text, else null."""
    found = collapse(decode_entities(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)))
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]*(>|\\z)", ""), ">", "")
    first = F.get(F.filter(F.transform(F.split(decode_entities(plain), LINE_ENDS, -1), collapse), lambda x: x != ""), 0)
    return F.coalesce(F.nullif(found, F.lit("")), first)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), f"{SPACES}+\\z", ""), F.lit("…"))).otherwise(text)


def estimated_tokens(text: Column, kind: Column | None = None) -> Column:
    """A token per five characters, of code (kind is code) per four, one at least."""
    chars = F.lit(5) if kind is None else F.when(kind == "code", 4).otherwise(5)
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars)).cast("bigint")


def message_tokens(text: Column) -> Column:
    """A token per four bytes, and one."""
    return (F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4) + 1).cast("bigint")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def keywords_found(text: Column, words: Column) -> tuple[Column, Column]:
    """Words (an array) that the text contains, in any case, and those it doesn't, in their order."""
    low = F.lower(text)
    has = lambda w: F.contains(low, F.lower(w))
    return F.filter(words, has), F.filter(words, lambda w: ~has(w))


def keyword_score(text: Column, words: Column) -> Column:
    """Share of the words that the text contains; 1 without words."""
    return F.when(F.size(words) == 0, 1.0).otherwise(F.bround(F.size(keywords_found(text, words)[0]) / F.size(words), 3))


def structure_score(code: Column) -> Column:
    """Share of four tests that source text passes: an include, a main, balanced braces, a closed end."""
    opens, closes = F.regexp_count(code, F.lit("\\{")), F.regexp_count(code, F.lit("\\}"))
    tests = [F.contains(code, F.lit("#include")), code.rlike(r"\bint\s+main\s*\("), (opens == closes) & (opens > 0), F.rtrim(code).endswith("}")]
    return sum((t.cast("int") for t in tests), F.lit(0)) / 4


def total_score(structure: Column, keyword: Column, compiled: Column, runtime: Column) -> Column:
    """Points of the four parts, each rounded half to even."""
    part = lambda name, x: F.bround(F.lit(WEIGHTS[name]) * x, 0)
    compile_points = F.when(compiled, WEIGHTS["compile"]).otherwise(0)
    return (part("structure", structure) + part("keyword", keyword) + compile_points + part("runtime", runtime)).cast("bigint")


#: Topics by what the topic field holds, then by patterns in the id, topic and prompt; the first that fits decides.
TOPIC_FIELDS = (
    ("geometry", "geometry"),
    ("game_simulation", "game_simulation|game simulation|guessing"),
    ("pattern_generation", "pattern_generation|pattern generation"),
    ("series_calculation", "series_calculation|series calculation"),
)
TOPIC_TEXTS = (
    ("geometry", "geometry|\\btriangle\\b|\\barea\\b|heron|collinear|\\bcoordinates?\\b"),
    ("game_simulation", "game_simulation|game simulation|guess|points|win|srand|random"),
    ("pattern_generation", "pattern_generation|pattern generation|pattern|stars|pyramid|diamond|rows"),
    ("series_calculation", "series_calculation|series calculation|series|sum|factorial|term_i|rational"),
)


def first_match(rules, text: Column) -> Column:
    """Name of the first rule whose pattern the text holds; null if none."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in rules])


def topic_of(prompt: Column, topic: Column | None = None, id_: Column | None = None) -> Column:
    """Topic by the topic field, else by id, topic and prompt together; hyphens count as underscores, missing ones as empty."""
    norm = lambda c: F.lower(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit("_"))) if c is not None else F.lit("")
    field = norm(topic)
    return F.coalesce(first_match(TOPIC_FIELDS, field), first_match(TOPIC_TEXTS, F.concat_ws(" ", norm(id_), field, norm(prompt))), F.lit("unknown"))
