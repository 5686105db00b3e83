"""Checks of C programs and of model answers that hold them, as Column expressions.

Regular expressions find what a check looks at; folds run over braces only, never over characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import LINE_ENDS, SPACES, strip

#: Weights of errors and warnings in a risk, least share of structure checks, penalty of an unsafe pattern.
ERROR_WEIGHT, WARNING_WEIGHT, LEAST_STRUCTURE, UNSAFE_COST = 0.35, 0.08, 0.625, 0.18
_COMMENT = "//[^\\n]*|/\\*[\\s\\S]*?(?:\\*/|\\z)"
_QUOTED = "\"[^\"\\\\]*(?:\\\\[\\s\\S][^\"\\\\]*)*(?:\"|\\z)|'(?:\\\\[\\s\\S]|[\\s\\S])?'?"
#: Comments, strings and character constants.
HIDDEN = f"{_COMMENT}|{_QUOTED}"
FENCE = "(?s)```(?:c|C)?\\s*\\n(.*?)```"
MAIN = "\\bint\\s+main\\s*\\("
SCANF = "\\bscanf\\s*\\(\\s*\"([^\"]*)\"([^)]*)\\)"
_EMPTY = "array<string>"


def places(text: Column, pattern: str) -> Column:
    """Start and end (from 0, end exclusive) of each match, in order."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("0"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("1"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["1"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(zipped, state, step, lambda s: s["out"])


def masked(code: Column, hidden: str = HIDDEN, keep_lines: bool = False) -> Column:
    """The code with comments, strings and character constants blanked, of the same length; with keep_lines, line feeds stay."""
    blank = (lambda x: F.regexp_replace(x, "[^\\n]", " ")) if keep_lines else (lambda x: F.repeat(F.lit(" "), F.length(x)))
    zipped = F.arrays_zip(F.split(code, hidden, -1).alias("0"), F.regexp_extract_all(code, F.lit(hidden), F.lit(0)).alias("1"))
    return F.array_join(F.transform(zipped, lambda x: F.concat(x["0"], F.coalesce(blank(x["1"]), F.lit("")))), "")


def balanced(text: Column, opens: str, closes: str) -> Column:
    """Whether no bracket closes before it opens and all are closed."""
    signs = F.regexp_extract_all(text, F.lit(f"[{opens}{closes}]"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == opens.strip("\\"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(s["low"], depth).alias("low"))

    return F.aggregate(signs, state, step, lambda s: (s["depth"] == 0) & (s["low"] == 0))


def _closed(text: Column, first: bool) -> Column:
    """Where (end exclusive) a brace closes to depth 0, the first or the last time; 0 if never."""
    zipped = F.arrays_zip(F.split(text, "[{}]", -1).alias("0"), F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0)).alias("1"))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["0"]) + 1
        depth = s["depth"] + F.when(x["1"] == "{", 1).when(x["1"] == "}", -1).otherwise(0)
        here = (x["1"] == "}") & (depth == 0) & (at > 1)
        if first:
            here = here & (s["end"] == 0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(here, at).otherwise(s["end"]).alias("end"))

    return F.aggregate(zipped, state, step, lambda s: s["end"])


def extracted(answer: Column) -> tuple[Column, Column]:
    """The program in an answer and how it was found: in a fence, from the first include to the last brace that closes, or none."""
    fenced = answer.rlike(FENCE)
    tail = F.substr(answer, F.locate("#include", answer))
    end = _closed(tail, first=False)
    looks = F.contains(answer, F.lit("#include")) & F.contains(answer, F.lit("int main")) & (end > 0)
    code = F.when(fenced, strip(F.regexp_extract(answer, FENCE, 1))).when(looks, strip(F.substr(tail, F.lit(1), end))).otherwise(strip(answer))
    return code, F.when(fenced, "fence").when(looks, "heuristic").otherwise("none")


def extracted_strict(answer: Column) -> Column:
    """As extracted, but a fence counts only if it holds an include and a main."""
    fence = strip(F.regexp_extract(answer, FENCE, 1))
    return F.when(answer.rlike(FENCE) & F.contains(fence, F.lit("#include")) & fence.rlike(MAIN), fence).otherwise(extracted(F.regexp_replace(answer, "```(?:c|C)?", ""))[0])


def code_and_prose(answer: Column) -> tuple[Column, Column]:
    """What the first fence holds and what stands outside of it; without one, what follows the first include."""
    fenced = answer.rlike(FENCE)
    parts = F.split(answer, FENCE, 2)
    looks = F.contains(answer, F.lit("#include")) & F.contains(answer, F.lit("int main"))
    at = F.locate("#include", answer)
    code = F.when(fenced, F.regexp_extract(answer, FENCE, 1)).when(looks, F.substr(answer, at)).otherwise("")
    return code, F.when(fenced, F.concat(F.get(parts, 0), F.get(parts, 1))).when(looks, F.substr(answer, F.lit(1), at - 1)).otherwise(answer)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final end gives no empty line."""
    lines = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def markdown_lines(prose: Column) -> Column:
    """Headings, list items, quotes and rules outside fences. A fence line turns the inside on and off, so a line is
    outside when an even number of them stands before it."""
    state = F.struct(F.lit(0).alias("fences"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        x = strip(line)
        fence = x.startswith("```")
        hit = ~fence & (s["fences"] % 2 == 0) & x.rlike(f"^#{{1,6}}{SPACES}|^[*+-]{SPACES}|^>{SPACES}|^---+\\z")
        return F.struct((s["fences"] + fence.cast("int")).alias("fences"), (s["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(lines_of(prose), state, step, lambda s: s["n"])


def truncated(code: Column) -> Column:
    return ~F.regexp_replace(code, f"{SPACES}+\\z", "").endswith("}") | (F.regexp_count(code, F.lit("\\{")) != F.regexp_count(code, F.lit("\\}")))


#: Scripts that mark an answer as not in a Latin script.
CJK = "[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{ac00}-\\x{d7a3}]"


def shape(answer: Column, error: Column) -> dict[str, Column]:
    """Columns that describe an answer: flags, sizes and ratios."""
    raw = F.coalesce(answer, F.lit(""))
    code, prose = code_and_prose(raw)
    program, method = extracted(raw)
    n, md = F.length(raw), markdown_lines(prose)
    rows = F.size(F.filter(lines_of(prose), lambda x: strip(x) != ""))
    ratio = lambda a, b, none: F.when(b > 0, F.bround(a / b, 3)).otherwise(none)
    return {
        "timed_out": F.coalesce(F.lower(error).rlike("timeout|timed out"), F.lit(False)),
        "empty": strip(raw) == "",
        "has_fence": raw.rlike("```(?:c|C)?"),
        "extract_method": method,
        "truncated": F.when(program == "", True).otherwise(truncated(program)),
        "has_cjk": raw.rlike(CJK),
        "total_chars": n,
        "code_chars": F.length(code),
        "prose_chars": F.length(prose),
        "code_ratio": ratio(F.length(code), n, 0.0),
        "prose_ratio": ratio(F.length(prose), n, 1.0),
        "md_lines": md,
        "prose_lines": rows,
        "md_ratio": ratio(md, rows, 0.0),
    }


def literals(code: Column) -> Column:
    """What the code's string constants hold, joined by spaces, in lower case."""
    return F.lower(F.array_join(F.regexp_extract_all(code, F.lit("\"([^\"\\\\]*(?:\\\\.[^\"\\\\]*)*)\""), F.lit(1)), " "))


def declared(code: Column) -> Column:
    """Simple declarations: array of name and type; a type ends in [] for arrays."""
    m = masked(code)
    pattern = "\\b(int|float|double|char|long|unsigned|short)\\s+(\\*?\\s*\\w+)\\s*(\\[[^\\]]*\\])?\\s*(?:=|;|,|\\))"
    group = lambda k: F.regexp_extract_all(m, F.lit(pattern), F.lit(k))
    both = F.arrays_zip(group(1).alias("0"), group(2).alias("1"), group(3).alias("2"))
    return F.transform(both, lambda x: F.struct(F.trim(F.ltrim(x["1"], F.lit("*"))).alias("name"), F.concat(x["0"], F.when(x["2"] != "", "[]").otherwise("")).alias("type")))


def type_of(name: Column, known: Column) -> Column:
    """Type of the last declaration of a name, or null."""
    return F.try_element_at(F.filter(known, lambda v: v["name"] == name), F.lit(-1))["type"]


def scanf_arguments(code: Column) -> Column:
    """Each conversion of a scanf call with its argument's name: array of spec and name."""
    group = lambda k: F.regexp_extract_all(code, F.lit(SCANF), F.lit(k))

    def call(x: Column) -> Column:
        specs = F.regexp_extract_all(x["0"], F.lit("%[^%\\s*]"), F.lit(0))
        names = F.transform(F.filter(F.transform(F.split(x["1"], ","), F.trim), lambda a: a != ""), lambda a: F.regexp_replace(a, "[\\[\\]&* ]", ""))
        n = F.least(F.size(specs), F.size(names))
        return F.arrays_zip(F.slice(specs, 1, n).alias("spec"), F.slice(names, 1, n).alias("name"))

    return F.flatten(F.transform(F.arrays_zip(group(1).alias("0"), group(2).alias("1")), call))


def _when(test: Column, message) -> Column:
    return F.when(test, F.array(F.lit(message))).otherwise(F.array().cast(_EMPTY))


def static_checks(code: Column) -> tuple[Column, Column]:
    """Errors and warnings as arrays of names; those of a variable end in its name.

    A d conversion is wrong into a float or double, also an array of floats, but not an array of doubles."""
    m, known = masked(code), declared(code)
    args = F.transform(scanf_arguments(code), lambda x: F.struct(x["spec"].alias("spec"), x["name"].alias("name"), type_of(x["name"], known).alias("type")))
    named = lambda head, name: F.concat(F.lit(head + ":"), name)
    wrong = lambda x: (
        F.when((x["spec"] == "%s") & x["type"].isNotNull() & (x["type"] != "char[]"), named("scanf_s_type", x["name"]))
        .when(x["spec"].isin("%d", "%i") & (F.contains(x["type"], F.lit("float")) | (x["type"] == "double")), named("scanf_d_float", x["name"]))
        .when((x["spec"] == "%f") & (x["type"] == "int"), named("scanf_f_int", x["name"]))
    )
    has = lambda pattern: code.rlike(pattern)
    include = lambda h: F.contains(code, F.lit(f"#include <{h}>")) | F.contains(code, F.lit(f'#include "{h}"'))
    compared = F.flatten(F.transform(F.array(*[F.regexp_extract_all(m, F.lit("\\bstrcmp\\s*\\(\\s*([^,)]+),\\s*([^)]+)\\)"), F.lit(k)) for k in (1, 2)]), lambda x: x))
    compared = F.transform(compared, lambda a: F.regexp_replace(F.ltrim(F.trim(a), F.lit("&")), "[\\[\\] *]", ""))
    ints = F.filter(compared, lambda v: type_of(v, known) == "int")
    errors = F.concat(
        _when(F.contains(code, F.lit("```")), "markdown_fence"),
        F.array_compact(F.transform(args, wrong)),
        F.when(F.contains(code, F.lit("strcmp")), F.transform(ints, lambda v: named("strcmp_int", v))).otherwise(F.array().cast(_EMPTY)),
    )
    start = F.get(places(m, MAIN + "[^)]*\\)\\s*\\{"), 0)["end"]
    unknown = F.transform(F.filter(args, lambda x: (x["spec"] == "%s") & x["type"].isNull()), lambda x: named("scanf_s_unknown", x["name"]))
    single = F.filter(args, lambda x: (x["spec"] == "%s") & (x["type"] == "char"))

    def endless(p: Column) -> Column:
        tail = F.substr(code, p["end"] + 1)
        body = F.substr(tail, F.locate("{", tail))
        end = _closed(body, first=True)
        return (F.locate("{", tail) > 0) & ~F.when(end > 0, F.substr(body, F.lit(1), end)).otherwise(body).rlike("\\b(break|return|exit)\\b")

    loops = F.filter(places(m, "\\bwhile\\s*\\(\\s*1\\s*\\)"), endless)
    rand = has("\\brand\\s*\\(")
    warnings = F.concat(
        unknown,
        _when(F.contains(code, F.lit("strcmp")) & ~include("string.h"), "strcmp_without_header"),
        _when(F.coalesce(~F.contains(F.substr(code, start + 1), F.lit("return")), F.lit(False)), "main_without_return"),
        _when(rand & ~has("\\bsrand\\s*\\("), "rand_without_srand"),
        _when(rand & has("\\bsrand\\s*\\(") & ~has("\\btime\\s*\\("), "srand_without_time"),
        _when(has("\\btime\\s*\\(") & ~include("time.h"), "time_without_header"),
        F.transform(loops, lambda _: F.lit("endless_loop")),
        _when(m.rlike("\\w+\\s*\\[\\s*\\w+\\s*-\\s*1\\s*\\]") & m.rlike("for\\s*\\([^;]*=\\s*0\\s*;"), "index_below_zero"),
        F.transform(single, lambda x: named("scanf_s_char", x["name"])),
        _when(rand & has("rand\\s*\\(\\s*\\)\\s*%") & ~has("(?i)\\b(seen|used|chosen|picked)\\s*\\[") & ~has("(?i)\\bsort\\b"), "repeated_random"),
        _when(m.rlike("\\bif\\s*\\(\\s*0\\s*\\)"), "if_zero"),
        _when(m.rlike("\\bwhile\\s*\\(\\s*0\\s*\\)"), "while_zero"),
    )
    return errors, warnings


def risk(errors: Column, warnings: Column) -> Column:
    return F.least(F.lit(1.0), F.bround(F.size(errors) * ERROR_WEIGHT + F.size(warnings) * WARNING_WEIGHT, 6))


def semantic_verdict(errors: Column, warnings: Column, most: int | None = None) -> Column:
    """rejected on an error, or on more warnings than allowed; else accepted."""
    bad = F.size(errors) > 0
    return F.when(bad if most is None else bad | (F.size(warnings) > most), "rejected").otherwise("accepted")


#: Named checks of a program's structure, in order: (name, blocking, passes(code, masked code)).
STRUCTURE = (
    ("has_include", True, lambda c, m: F.contains(c, F.lit("#include"))),
    ("has_main", True, lambda c, m: c.rlike(MAIN)),
    ("balanced_braces", True, lambda c, m: balanced(m, "{", "}")),
    ("balanced_parens", True, lambda c, m: balanced(m, "(", ")")),
    ("not_truncated", True, lambda c, m: c.rlike(f"[}};]{SPACES}*\\z")),
    ("no_placeholders", False, lambda c, m: ~c.rlike("(?i)\\bTODO\\b|\\bFIXME\\b|\\bXXX\\b|\\.\\.\\.|<your code here>|<fill in>")),
    ("has_control_flow", False, lambda c, m: c.rlike("\\b(for|while|if)\\s*\\(")),
    ("scanf_format", False, lambda c, m: ~F.exists(_scanf_counts(c), lambda x: (x["specs"] > 0) & (x["specs"] != x["args"]))),
)


def _scanf_counts(code: Column) -> Column:
    call = "(?s)\\bscanf\\s*\\(\\s*\"([^\"]*)\"(.*?)\\);"
    group = lambda k: F.regexp_extract_all(code, F.lit(call), F.lit(k))
    count = lambda x: F.struct(F.regexp_count(x["0"], F.lit("%[^%\\s]")).alias("specs"), F.size(F.filter(F.split(x["1"], ","), lambda a: F.trim(a) != "")).alias("args"))
    return F.transform(F.arrays_zip(group(1).alias("0"), group(2).alias("1")), count)


def structure(code: Column, checks=STRUCTURE) -> tuple[Column, Column, Column]:
    """Names of the failed checks in order, the share that passed, and whether the code stands: no blocking check
    failed and enough passed."""
    m = masked(code)
    ok = {name: test(code, m) for name, _, test in checks}
    failed = F.array_compact(F.array(*[F.when(~x, name) for name, x in ok.items()]))
    score = F.lit(len(checks)) - F.size(failed)
    blocked = F.exists(failed, lambda x: x.isin([n for n, b, _ in checks if b]))
    return failed, F.bround(score / len(checks), 3), ~blocked & (score / len(checks) >= LEAST_STRUCTURE)


def normalised_output(text: Column) -> Column:
    """A model's output without terminal codes, carriage returns and spinner lines."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\x1b\\[[0-9;?]*[A-Za-z]", ""), "\\r\\n?", "\n")
    return strip(F.regexp_replace(plain, "(?m)^[ \\t]*[\\x{2800}-\\x{28ff}][^\\n]*\\n?", ""))


def last_number(output: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(output, F.lit("-?\\d+\\.?\\d*"), F.lit(0)), F.lit(-1)).cast("double")


def without_fences(text: Column) -> Column:
    """What a fence around the whole text holds, else the text."""
    return strip(F.regexp_replace(strip(text), "^```[A-Za-z]*[ \\t]*\\n|\\n?```\\z", ""))
