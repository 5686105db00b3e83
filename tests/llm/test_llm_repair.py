"""Cost layers against a search over all edits, pieces of any size, odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(codes):
    """(cost, audit, edits) by trying edits in order of cost and audit, without the layers."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, spelt, edits = heapq.heappop(heap)
        if i == len(codes) and GRAMMAR.match(spelt):
            return cost, audit, edits
        state = spelt[-1:] or "-", i
        if not re.match(r"s?(ua)*u?\Z", spelt) or (state, cost, audit) in seen or cost > 2 * len(codes):
            continue
        seen.add((state, cost, audit))
        steps = [(5, "I", i, x, ("I", x)) for x in "ua"]
        if i < len(codes):
            c, extra = codes[i].lower(), 5 * codes[i].isupper()
            steps.append((2, "D", i + 1, "", ("D", i)))
            if c != "-":
                steps += [(extra, "K", i + 1, c, ("K", i))] + [(1 + extra, "R", i + 1, x, ("R", i, x)) for x in "ua"]
        for k, name, j, x, e in steps:
            heapq.heappush(heap, (cost + k, audit + name, j, spelt + x, (*edits, e)))


@pytest.mark.parametrize("size", [1, 2, 5, 99])
def test_layers_against_search(size):
    r = random.Random(size)
    for codes in [*("".join(x) for n in range(4) for x in itertools.product("suaUA-o", repeat=n)), *("".join(r.choice("suauauaUA-oS") for _ in range(r.randint(4, 9))) for _ in range(150))]:
        parts = [codes[k : k + size] for k in range(0, len(codes), size)]
        after, first = cr._costs_after([cr.crossing(p) for p in parts])
        state, script = 0, ""
        for part, rest in zip(parts, after, strict=True):
            state, own = cr.trace(part, tuple(rest))[state]
            script += own
        script += {1: "UA", 2: "A"}.get(state, "")
        cost, audit, _ = cheapest(codes)
        assert (first[0], script.translate(str.maketrans("UAk-ua", "IIKDRR"))) == (cost, audit), codes


def expected(rows):
    """The contract, row by row, in plain Python."""
    blank, out = lambda x: " " if x is None else x, {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = blank(role), blank(text)
            kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.sha256(x[2].encode()).hexdigest()))
        turns, seen, counts, codes = {x[0] for x in kept if x[0] is not None}, set(), [0, 0, 0], ""
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "-" if fault in (0, 1) else letter.upper() if fault == 2 else letter
            if fault is not None:
                counts[fault] += 1
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(kept))
        cost, audit, edits = cheapest(codes)
        full = {"u": "user:", "a": "assistant:"}
        lines = [f"{kept[e[1]][1]}:{kept[e[1]][2]}" if e[0] == "K" else full[e[2]] + kept[e[1]][2] if e[0] == "R" else full[e[1]] for e in edits if e[0] != "D"]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed):
    r, texts = random.Random(seed), ["Yes.", "No!", "And", "  ", "", "Ça va ?", "Well… \n", None, "Go. on", "x" * 3000 + "."]
    rows = [(r.choice([1, 2, 3, 4, None]) if k < 90 else 100 + k % 40, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), r.choice(texts)) for k in range(200)]
    return [x for c in {r[0] for r in rows} for x in [r for r in rows if r[0] == c][:9]]  # the search is slow beyond


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_odd_rows_against_search(spark, bits):
    rows = conversations(bits)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("_at", "cost", "audit", "_conv")})
    got = {r[0]: tuple(r)[1:] for r in cr.repair(cr.damage(df), piece_bits=bits)[0].collect()}
    wanted = expected(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(got) <= set(wanted) and all(got.get(c, nothing) == w for c, w in wanted.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [x.collect() for x in cr.repair(df)] == [[], []]


def test_one_long_conversation_in_pieces(spark):
    turns = spark.range(20_000).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    one, lines = cr.repair(turns.where("turn % 997 <> 5"), piece_bits=8)
    r = one.first()
    drops = sum(k % 997 == 5 for k in range(20_000))
    assert (r.gaps, r.illegal, r.blank, r.truncated) == (drops, drops, 0, 0)
    assert (r.cost, len(r.audit), lines.count()) == cr_of([("u", "a")[k % 2] for k in range(20_000) if k % 997 != 5])


def cr_of(codes):
    """Cost, length of the audit and kept rows of a piece that isn't cut."""
    after, first = cr._costs_after([cr.crossing("".join(codes))])
    script = cr.trace("".join(codes), tuple(after[0]))[0][1]
    return first[0], len(script), len(script) - script.count("-")
