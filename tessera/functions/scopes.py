"""Checks of reference programs and of answers that hold one: scopes of functions, foreign syntax, what must be there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.code import balanced, masked
from tessera.functions.text import strip
from tessera.operators.records import issues, unsafe

#: A function's head with its opening brace, a main without arguments, any main.
FUNCTION = "\\b(?:int|void|double|float|char|long|short|unsigned)\\s+([a-zA-Z_]\\w*)\\s*\\([^)]*\\)\\s*\\{"
MAIN_VOID, MAIN = "\\bint\\s+main\\s*\\(\\s*void\\s*\\)", "\\bint\\s+main\\s*\\("
#: Syntax of other languages, by name.
FOREIGN = (
    ("cpp_std", "\\bstd::"), ("cpp_streams", "\\bcout\\s*<<|\\bcin\\s*>>"), ("cpp_syntax", "\\bclass\\b|\\btemplate\\s*<|\\bnamespace\\b"),
    ("cpp_types", "\\bvector\\s*<|\\bstring\\b"), ("python", "\\bdef\\s+\\w+\\s*\\("), ("javascript", "\\bconsole\\.log\\s*\\("),
)
#: Calls that need the header of standard input and output, markers of a sample run, languages of a fence.
IO_CALL = "\\b(?:printf|scanf|puts|getchar|putchar)\\s*\\("
SAMPLES = ("測試輸入", "測試輸出", "sample input", "sample output", "input:", "output:", "輸入：", "輸出：")
LANGUAGES = ("c", "c99", "c11")
#: Fixed value: what an issue costs of an answer's score.
ISSUE_COST = 0.15
FENCE = "(?s)```([^\\n`]*)\\n(.*?)```"
QUOTED = "\"[^\"\\\\]*(?:\\\\[\\s\\S][^\"\\\\]*)*\"|'[^'\\\\]*(?:\\\\[\\s\\S][^'\\\\]*)*'"


def nested_functions(code: Column) -> Column:
    """Names of the functions whose body opens within another function's, in order. Braces in comments and strings don't count.

    The fold runs over heads and braces with a stack: f for a function's brace, b for any other."""
    marks = F.regexp_extract_all(masked(code), F.lit(f"{FUNCTION}|[{{}}]"), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        opens = ~x.isin("{", "}")
        inner = opens & F.contains(s["stack"], F.lit("f"))
        stack = F.when(x == "}", F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)).otherwise(F.concat(s["stack"], F.when(opens, "f").otherwise("b")))
        return F.struct(stack.alias("stack"), F.when(inner, F.array_append(s["found"], F.regexp_extract(x, FUNCTION, 1))).otherwise(s["found"]).alias("found"))

    start = F.struct(F.lit("").alias("stack"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(marks, start, step, lambda s: s["found"])


def reference_issues(code: Column, includes: Sequence[str] = ()) -> Column:
    """What keeps a program from being a reference solution: missing parts, braces, length, nested functions (nested:name)."""
    has = lambda x: F.contains(code, F.lit(x))
    found = [("include", ~has("#include")), *[(f"include:{x}", ~has(x)) for x in includes], ("main_void", ~code.rlike(MAIN_VOID)), ("return_0", ~has("return 0") & ~has("return(0)"))]
    found += [("braces", F.regexp_count(code, F.lit("\\{")) != F.regexp_count(code, F.lit("\\}"))), ("scanf", ~has("scanf")), ("printf", ~has("printf")), ("too_short", F.length(strip(code)) < 50)]
    return F.concat(issues(found), F.transform(nested_functions(code), lambda n: F.concat(F.lit("nested:"), n)))


def fenced_program(answer: Column) -> Column:
    """The first fence marked as C, else the first fence, else the whole answer."""
    of = lambda k: F.regexp_extract_all(answer, F.lit(FENCE), F.lit(k))
    fences = F.arrays_zip(of(1).alias("lang"), of(2).alias("code"))
    marked = F.filter(fences, lambda x: F.lower(strip(x["lang"])).isin(*LANGUAGES))
    return F.coalesce(strip(F.get(marked, 0)["code"]), strip(F.get(fences, 0)["code"]), strip(answer))


def answer_issues(answer: Column, request: Column) -> tuple[Column, Column]:
    """Issues of an answer that should hold a whole C program with a sample run, and its score."""
    code = fenced_program(answer)
    bare = F.regexp_replace(code, QUOTED, "")
    sample = F.lit(False)
    for marker in SAMPLES:
        sample = sample | F.contains(F.lower(answer), F.lit(marker))
    found = [(name, code.rlike(pattern)) for name, pattern in FOREIGN]
    found += [("main", ~code.rlike(MAIN)), ("stdio", code.rlike(IO_CALL) & ~F.contains(code, F.lit("#include <stdio.h>")))]
    found += [("braces", ~balanced(bare, "{", "}") | bare.rlike("[\"']")), ("sample", ~sample)]
    all_ = F.array_distinct(F.concat(issues(found), unsafe(answer, request)))
    return all_, F.bround(F.greatest(F.lit(0.0), 1.0 - ISSUE_COST * F.size(all_)), 2)
