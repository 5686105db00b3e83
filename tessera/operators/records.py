"""Training and benchmark records: projections, texts built from fields, checks of answers and of life cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.code import MAIN
from tessera.functions.text import strip
from tessera.operators.packaging import issues

#: Markers within an instruction, the prefix of a bare question, and the share that an issue costs.
SAMPLE, EXPECTED, PREFIX, ISSUE_COST = "Sample input:", "Expected output contains:", "Write a C program for the following:", 0.18
#: Commands that need a network, and that destroy data; words that ask for the latter.
ONLINE = (
    ("pip", "\\bpip\\s+install\\b"), ("npm", "\\bnpm\\s+install\\b"), ("cargo", "\\bcargo\\s+install\\b"), ("ollama", "\\bollama\\s+pull\\b"), ("apt", "\\bapt(?:-get)?\\s+install\\b"),
    ("brew", "\\bbrew\\s+install\\b"), ("web_request", "\\bInvoke-WebRequest\\b|\\biwr\\b"), ("url", "\\bcurl\\s+https?://|\\bwget\\s+https?://"),
)
DESTRUCTIVE = (("rm_root", "\\brm\\s+-rf\\s+/(?:\\s|\\z)"), ("rm_all", "\\brm\\s+-rf\\s+\\*"), ("del", "\\bdel\\s+/s\\s+/q\\b"), ("format", "\\bformat\\s+[A-Za-z]:"), ("dd", "\\bdd\\s+if=.*\\bof=/dev/"))
ASKED_FOR = "刪除|清掉|delete|remove|format|wipe"
#: States and levels of a corpus item.
STATUSES = ("candidate", "in_review", "approved", "golden", "archive")
LEVELS = ("agent_verified", "human_verified", "golden")


def instruction_parts(instruction: Column) -> tuple[Column, Column]:
    """The sample input and the expected words that an instruction's markers hold; empty without markers."""
    sample = strip(F.regexp_extract(instruction, f"(?is){SAMPLE}\\s*\\n(.*?)(?:\\n\\nExpected output|\\z)", 1))
    expected = F.regexp_extract(instruction, f"(?i){EXPECTED}\\s*(.+?)(?:\\n|\\z)", 1)
    return sample, F.filter(F.transform(F.split(expected, ","), strip), lambda x: x != "")


def tasks(records: DataFrame) -> DataFrame:
    """Benchmark tasks of code records with an id and an instruction: id, instruction, sample_input, expected, topic, year.

    records: id, type, instruction, topic, year. A missing topic is unknown; a missing year is the number that the id starts with, else 0."""
    r = records.where("type = 'code_generation'").withColumn("instruction", strip(F.coalesce("instruction", F.lit("")))).where("coalesce(id, '') <> '' AND instruction <> ''")
    sample, expected = instruction_parts(F.col("instruction"))
    own = F.nullif(F.coalesce("year", F.lit(0)).cast("int"), F.lit(0))
    year = F.coalesce(own, F.split("id", "_")[0].try_cast("int"), F.lit(0))
    return r.select("id", "instruction", sample.alias("sample_input"), expected.alias("expected"), F.coalesce("topic", F.lit("unknown")).alias("topic"), F.when(own.isNotNull() | F.col("id").rlike("^[0-9]"), year).otherwise(0).alias("year"))


def assembled(prompt: Column, features: Column, sample: Column, expected: Column) -> Column:
    """An instruction of a prompt, its features as a list, its sample input and its expected words; parts that are missing are left out."""
    has = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    given = strip(F.coalesce(sample, F.lit("")))
    return F.concat_ws(
        "\n",
        strip(F.coalesce(prompt, F.lit(""))),
        F.when(has(features), F.concat(F.lit("\nRequired features:\n"), F.array_join(F.transform(features, lambda x: F.concat(F.lit("  - "), x)), "\n"))),
        F.when(given != "", F.concat(F.lit(f"\n{SAMPLE}\n"), given)),
        F.when(has(expected), F.concat(F.lit(f"\n{EXPECTED} "), F.array_join(expected, ", "))),
    )


def as_question(content: Column) -> Column:
    """Content without its number, with a prefix unless it asks or says write."""
    bare = F.regexp_replace(strip(content), "^\\d+\\.\\s*", "")
    return F.when(bare.endswith("?") | F.lower(bare).startswith("write"), bare).otherwise(F.concat(F.lit(PREFIX + "\n\n"), bare))


def packed(instruction: Column, output: Column, system: Column) -> dict[str, Column]:
    """A record as chat messages, as instruction and output, and as prompt and completion."""
    i, o = strip(F.coalesce(instruction, F.lit(""))), strip(F.coalesce(output, F.lit("")))
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    prompt = F.when(F.coalesce(system, F.lit("")) != "", F.concat(system, F.lit("\n\n"), i)).otherwise(i)
    return {
        "messages": F.array(m("system", system), m("user", i), m("assistant", o)),
        "alpaca": F.struct(i.alias("instruction"), F.lit("").alias("input"), o.alias("output")),
        "completion": F.struct(prompt.alias("prompt"), o.alias("completion")),
    }


def training_issues(kind: Column, instruction: Column, output: Column) -> Column:
    """Issues of a training record, in order."""
    i, o = strip(F.coalesce(instruction, F.lit(""))), strip(F.coalesce(output, F.lit("")))
    no_code = (kind == "code_generation") & (o != "") & ~o.rlike(MAIN) & ~F.contains(o, F.lit("```"))
    return issues([("empty_instruction", i == ""), ("empty_output", o == ""), ("no_code", no_code)])


def retry_text(prompt: Column, failure: Column, hint: Column, expected: Column) -> Column:
    """The user's text of a retry record: prompt, failure, hint and expected behaviour; blank ones are left out."""
    some = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
    return F.concat_ws("\n", some(prompt), F.lit(""), tag("Failure type", F.coalesce(failure, F.lit("unknown"))), tag("Repair hint", some(hint)), tag("Expected", some(expected)))


def unsafe(answer: Column, request: Column) -> Column:
    """Names of the commands in an answer that need a network or, unless the request asks for it, destroy data."""
    asked = F.lower(F.coalesce(request, F.lit(""))).rlike(ASKED_FOR)
    hit = lambda p: answer.rlike(f"(?i){p}")
    return issues([(n, hit(p)) for n, p in ONLINE] + [(n, hit(p) & ~asked) for n, p in DESTRUCTIVE])


def answer_score(answer: Column, request: Column) -> tuple[Column, Column]:
    """Issues of a Markdown answer and its score: open fences, emptiness, unsafe commands."""
    own = issues([("open_fence", F.regexp_count(answer, F.lit("```")) % 2 == 1), ("empty", strip(answer) == "")])
    bad = unsafe(answer, request)
    safe = F.greatest(F.lit(0.0), F.lit(1.0) - ISSUE_COST * F.size(bad))
    return F.concat(own, bad), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(0.95), safe) - 0.2 * F.size(own)), 2)


def program_issues(code: Column) -> Column:
    """What a minimal valid program lacks."""
    count = lambda sign: F.regexp_count(code, F.lit(sign))
    return issues([
        ("include", ~F.contains(code, F.lit("#include"))), ("main", ~code.rlike(MAIN)), ("return_0", ~F.contains(code, F.lit("return 0")) & ~F.contains(code, F.lit("return(0)"))),
        ("braces", count("\\{") != count("\\}")), ("too_short", F.length(strip(code)) < 50),
    ])


def style(code: Column) -> dict[str, Column]:
    """Features of a program's style."""
    has = lambda x: F.contains(code, F.lit(x))
    return {
        "code_chars": F.length(code), "uses_rand": has("rand("), "uses_srand": has("srand("), "uses_time": has("time(") | F.contains(F.lower(code), F.lit("#include <time.h>")),
        "while_true": has("while (1)") | has("while(1)"), "printf_count": F.regexp_count(code, F.lit("printf")), "scanf_count": F.regexp_count(code, F.lit("scanf")),
    }


def case_points(compiled: Column, ran: Column, keywords: Column, structure: Column, points: Column) -> Column:
    """Points of a case: none without compiling, a quarter without running, half, 0.7 or all by keywords and structure."""
    share = F.when(~compiled, 0.0).when(~ran, 0.25).when(keywords & structure, 1.0).when(keywords | structure, 0.7).otherwise(0.5)
    return F.bround(points * share, 1)


def needs_steps(difficulty: Column, prompt: Column) -> Column:
    return F.lower(difficulty).isin("medium", "hard") | (F.length(prompt) > 300)


def canonical(name: Column) -> Column:
    """ASCII letters and digits in lower case, without a final tool."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), "tool\\z", "")


def item_issues(status: Column, level: Column, stage: Column, reviewer: Column, actions: Column) -> Column:
    """Where a corpus item breaks the rules of its life cycle, in order. actions: those in its history, null without one."""
    known = F.coalesce(actions, F.array().cast("array<string>"))
    return issues([
        ("status", ~F.coalesce(status.isin(*STATUSES), F.lit(False))),
        ("level", level.isNotNull() & ~level.isin(*LEVELS)),
        ("no_reviewer", level.isin("human_verified", "golden") & (F.coalesce(reviewer, F.lit("")) == "")),
        ("golden_without_approval", (level == "golden") & ~F.array_contains(known, "approve")),
        ("not_in_review", (stage == "review") & ~status.eqNullSafe(F.lit("in_review"))),
        ("not_verified", (stage == "verified") & ~F.coalesce(status.isin("candidate", "approved", "golden"), F.lit(False))),
        ("no_history", actions.isNull()),
    ])


#: Checks that are compared task by task.
PAIRED = ("compile", "runtime", "semantic", "keyword")


def wide_pairs(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Tasks of either run side by side: topic (the base's first), scores, delta, change of each check (null if a side
    lacks it), checks lost, and why the task regressed."""
    side = lambda d, p: d.select(*keys, F.col("topic").alias(f"{p}_topic"), F.coalesce("score", F.lit(0)).alias(f"{p}_score"), *[F.col(f"{c}_passed").alias(f"{p}_{c}") for c in PAIRED])
    j = side(base, "base").join(side(new, "new"), list(keys), "full_outer").na.fill(0, ["base_score", "new_score"])
    ok = lambda p, c: F.coalesce(F.col(f"{p}_{c}"), F.lit(False))
    change = {f"{c}_change": F.col(f"new_{c}").cast("int") - F.col(f"base_{c}").cast("int") for c in PAIRED}
    lost = F.array_join(issues([(c, ok("base", c) & ~ok("new", c)) for c in PAIRED]), ",")
    delta = F.col("new_score") - F.col("base_score")
    why = issues([("score", delta < 0), ("runtime", F.col("base_runtime") & ~F.col("new_runtime")), *[(c, change[f"{c}_change"] < 0) for c in ("compile", "semantic", "keyword")]])
    return j.select(*keys, F.coalesce("base_topic", "new_topic", F.lit("unknown")).alias("topic"), "base_score", "new_score", delta.alias("delta"), *[v.alias(k) for k, v in change.items()], lost.alias("lost"), F.array_join(why, ",").alias("reasons"))


def interference(pairs: DataFrame, by: str, focus: str, focused: Column) -> DataFrame:
    """Per group of wide pairs, what its regressions suggest of an adapter. focus: pattern of the topics it was trained
    for; focused: whether the group's adapter was."""
    hit = F.col("reasons") != ""
    inside = hit & F.lower("topic").rlike(focus)
    g = pairs.groupBy(by).agg(F.bool_or(hit).alias("any"), F.bool_or(inside).alias("inside"), F.bool_or(hit & ~F.lower("topic").rlike(focus)).alias("outside"), F.coalesce(F.bool_or(F.col("runtime_change") < 0), F.lit(False)).alias("runtime"), F.bool_or(focused).alias("f"))
    verdict = F.when(F.col("f") & F.col("inside") & F.col("runtime"), "overfit_with_runtime_interference").when(F.col("f") & F.col("outside"), "cross_task_interference").when(F.col("any"), "regression").otherwise("none")
    return g.select(by, verdict.alias("verdict"))
