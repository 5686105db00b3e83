"""Catalogue search, routing, sessions, summaries and sign-offs on small cases, and the plans of the joins."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, sessions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containing_equals_the_nested_loop(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    texts, terms = [(k, word(r.randint(0, 14))) for k in range(80)], {word(r.randint(0, 6)) for _ in range(60)} | {"", "a", "zz", "abzz"}
    df = search.containing(spark.createDataFrame([(t,) for t in terms], "t string"), "t", spark.createDataFrame(texts, "id long, text string"), "id", "text")
    assert {(x.t, x.id) for x in df.collect()} == {(t, k) for t, (k, x) in itertools.product(terms, texts) if t and t in x}
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_shared_terms_against_every_entry(spark):
    """Few letters, so terms are in most entries, overlap and tie; long terms go by their rarest piece."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    entries = [(f"k{r.randint(0, 2)}", f"n{i}", " ".join(word() for _ in range(3)) + " abcdefghijkl" * (i % 9 == 0)) for i in range(150)]
    prompts = [(i, " ".join(word() for _ in range(r.randint(1, 4))) + " bcdefghijk" * (i % 5 == 0)) for i in range(40)]
    df = search.route(spark.createDataFrame(prompts, "id int, p string"), "id", "p", spark.createDataFrame(entries, "kind string, name string, text string"), 4)
    want = []
    for i, p in prompts:
        hits = sorted((-sum(w in t for w in set(p.split())), kind, name) for kind, name, t in entries if any(w in t for w in p.split()))
        heads = [min(h for h in hits if h[1] == kind) for kind in sorted({h[1] for h in hits})]
        want += [(i, n + 1, kind, name, -s) for n, (s, kind, name) in enumerate((heads + [h for h in hits if h not in heads])[:4])]
    assert sorted((x.id, x["rank"], x.kind, x.name, x.score) for x in df.collect()) == want


def test_no_index_of_pieces_is_broadcast(spark, tmp_path):
    """A small file has many pieces, which its size doesn't tell."""
    spark.range(500).select("id", F.concat(F.lit("text of number "), F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/texts")
    met = search.containing(spark.createDataFrame([("number 77",)], "t string"), "t", spark.read.parquet(f"{tmp_path}/texts"), "id", "text")
    assert [x.id for x in met.collect()] == [77]
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    each = plan(met).split("\n")
    for at, line in enumerate(each):
        if "BroadcastExchange" in line:
            below = list(itertools.takewhile(lambda x: depth(x) > depth(line), each[at + 1 :]))
            assert not any("Generate" in x and "substring" in x for x in below)


def test_search_terms(spark):
    entries = spark.createDataFrame([("ReadTool", "Reads a file, from disk"), ("read", "other"), ("WebFetch", None), ("web_search", "search the web for read-only text")], "name string, d string")
    queries = ["read", "+disk read", "select:webfetch, READ-tool,zzz,web_search", "+nothing read", "  ", None, "web fetch", "+web -- search"]
    q = spark.createDataFrame(list(enumerate(queries)), "id int, q string")
    df = search.search(q, "id", "q", entries, "name", "d", 3)
    got = {}
    for x in df.orderBy("id", "rank").collect():
        got.setdefault(x.id, []).append((x.name, x.score))
    # 2 text, 8 name, 4 in the name, 12 canonical name, 3 canonical text
    assert got == {
        0: [("read", 29), ("ReadTool", 21), ("web_search", 5)], 1: [("ReadTool", 26)], 2: [("WebFetch", None), ("ReadTool", None), ("web_search", None)],
        6: [("WebFetch", 18), ("web_search", 9)], 7: [("web_search", 18), ("WebFetch", 9)],
    }
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_route_takes_the_best_of_each_kind_first(spark):
    rows = [("command", f"c{k}", "review code fix tests") for k in range(4)] + [("tool", "t1", "fix"), ("tool", "t2", "other"), ("command", "c9", "review")]
    entries = spark.createDataFrame(rows, "kind string, name string, text string")
    prompts = spark.createDataFrame([(1, "Review/fix code-review TESTS"), (2, "fix"), (3, "none here"), (4, None)], "id int, p string")
    got = [(x.id, x["rank"], x.kind, x.name, x.score) for x in search.route(prompts, "id", "p", entries, 4).orderBy("id", "rank").collect()]
    assert got == [
        (1, 1, "command", "c0", 4), (1, 2, "tool", "t1", 1), (1, 3, "command", "c1", 4), (1, 4, "command", "c2", 4),
        (2, 1, "command", "c0", 1), (2, 2, "tool", "t1", 1), (2, 3, "command", "c1", 1), (2, 4, "command", "c2", 1),
    ]


def test_sessions_in_either_format(spark):
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_result", "content": [{"type": "text", "text": "b"}, {"type": "x"}, 3]}, {"type": "tool_result", "content": "c"}, {"type": "tool_result"}, "no", {"type": "text"}]
    ms = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": blocks}, {"role": "user", "content": 5}, {"role": "tool", "blocks": [{"type": "text", "text": "z"}]}]
    lines = "\n\n".join(json.dumps({"type": "message", "message": m}) for m in ms)
    rows = [(1, json.dumps({"messages": ms}, indent=1)), (2, '{"type": "session_meta"}\r\n' + lines + "\r\n"), (3, None), (4, ""), (5, '{"messages": []}'), (6, "{oops\n" + lines.split("\n\n")[0])]
    got = {}
    for x in sessions.messages(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("id", "n").collect():
        got.setdefault(x.id, []).append((x.role, x.text))
    whole = [("user", "hi"), ("assistant", "a\nb\nc\n"), ("user", ""), ("tool", "z")]
    assert got == {1: whole, 2: whole, 6: [(None, None), ("user", "hi")]}


def summary(spark, text, **limits):
    return sessions.compressed(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", **limits).first()


def test_core_lines_stay_when_the_budget_is_tight(spark):
    text = "\n".join(["Conversation summary:", "- Scope: 18 earlier messages.", "- Current work: finish the summary.", "- Key timeline:", "  - user: first step", "  - user: second step", "plain"])
    r = summary(spark, text, max_chars=120, max_lines=4)
    assert r.summary.split("\n") == ["Conversation summary:", "- Scope: 18 earlier messages.", "- Current work: finish the summary.", "- Key timeline:"] and (r.omitted, r.lines) == (3, 4)


def test_lines_that_do_not_fit_are_passed_over(spark):
    r = summary(spark, "- a\n- " + "b" * 50 + "\n- A\n-  c \n\n", max_chars=48, max_lines=9)
    assert (r.summary, r.repeats, r.omitted) == ("- a\n- c\n- … 1 additional line(s) omitted.", 1, 1)
    assert summary(spark, "x" * 40, max_chars=10).summary == "x" * 9 + "…"
    assert [tuple(summary(spark, t))[1:] for t in (None, "", " \n ")] == [("", 0, 0, 0)] * 3
    assert summary(spark, "a", max_lines=0).summary == ""


@pytest.mark.parametrize("scope", ["all", "listed"])
def test_sign_offs(spark, scope):
    results = spark.createDataFrame([("a", "approved"), ("b", "approved"), ("c", "rejected"), (None, "approved"), ("a", "approved")], "id string, status string")
    offs = spark.createDataFrame([(" Ann ", scope, ["a"]), ("todo", "all", None), (None, "all", None), ("Zoe", "ids", ["a", "c"])], "signed_off_by string, scope string, scope_ids array<string>")
    df = sessions.signed_off(results, offs)
    got = sorted(((x.id, x.status, x.tier, x.signed_by) for x in df.collect()), key=str)
    v, other = "human_verified", ("human_verified", "Ann") if scope == "all" else (None, None)
    first = "Zoe" if scope == "all" else "Ann"
    # a row without an id can't be told from another, so no sign-off reaches it
    assert got == sorted([("a", "approved", v, first), ("a", "approved", v, first), ("b", "approved", *other), ("c", "rejected", None, None), (None, "approved", None, None)], key=str)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df) and df.select(F.count("*")).first()[0] == 5
