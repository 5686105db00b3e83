"""Decontamination against a plain comparison of every alignment, and the cases that one window misses."""

import random
import re
import time

import pytest

from tessera.llm import decontamination as d

NUM = re.compile(r"[$€£]?[0-9]+(?:[.,/][0-9]+)*")


def template(text):
    """(template token, own word) of each word with letters or digits; a name's token is NAME or the word at a sentence's start."""
    out, first = [], True
    for w in (text or "").split():
        core = "".join(d._WORD.findall(w))
        if core:
            low = core.lower()
            unit = low in d.UNITS and (low not in d.AMBIGUOUS or bool(out) and out[-1][0] == "NUM")
            out.append(("NUM" if NUM.fullmatch(core) else "UNIT" if unit else "NAME" if core[0].isupper() and not first else low, low, core[0].isupper()))
        first = w.endswith((".", "!", "?", ":"))
    return out


def passes(doc, item):
    least = min(12, len(item))
    for shift in range(1 - len(item), len(doc)):
        on = [i for i in range(len(item)) if 0 <= i + shift < len(doc)]
        same = {i: item[i][1] == doc[i + shift][1] for i in on}
        equal = {i: same[i] or item[i][0] == doc[i + shift][0] or i == 0 and item[0][2] and item[0][0] not in ("NUM", "UNIT") and doc[shift][0] == "NAME" for i in on}
        runs, now = [], []
        for i in [*on, -1]:
            if i >= 0 and equal[i]:
                now.append(i)
            else:
                if len(now) >= min(6, len(item)):
                    runs.append(now)
                now = []
        at = sum(runs, [])
        if any(all(same.get(i) for i in range(a, a + least)) for a in range(len(item) - least + 1)):
            return True
        for s in range(len(at) - least + 1):
            part = at[s : s + least]
            maps = [{}, {}, {}]
            for e in range(s, len(at)):
                part = at[s : e + 1]
                i = at[e]
                kind, a, b = item[i][0], item[i][1], doc[i + shift][1]
                if kind == "NUM":
                    ok = maps[0].setdefault((a, item[i + 1][0] if i + 1 in equal else None), b) == b
                elif kind in ("UNIT", "NAME"):
                    ok = maps[1].setdefault((kind, a), b) == b and maps[2].setdefault((kind, b), a) == a
                else:
                    ok = True
                if not ok:
                    break
                if len(part) >= least and sum(item[i][0] not in ("NUM", "UNIT", "NAME") for i in part) >= min(4 if len(item) >= 12 else 3, len(at)):
                    return True
    return False


def pairs(spark, docs, items, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in d.find_leaks(df, bench, **more).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "train", "runs", "to", "Boston", "Paris", "Alice", "in", "3", "5", "7.5", "km", "hours", "Then", "stops.", "The", "fast", "and", "-", "boy"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice((2, 5, 14, 30))))) for k in range(12)] + [(50, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (51, None), (52, "")]
    swap = {"3": "9", "5": "8", "Boston": "Rome", "Alice": "Bob", "km": "miles"}
    docs = []
    for k in range(60):
        t = text(rng.randrange(10, 50))
        if k % 3:
            body = (rng.choice(items[:13])[1] or "").split()
            if k % 3 == 2:
                body = [swap.get(w, w) if rng.random() < 0.9 else w for w in body]
            body = body[rng.randrange(3) :]
            t[5:5] = [w if rng.random() < 0.97 else "zzz" for w in body]
        docs.append((k, " ".join(t)))
    want = {(i, j) for i, t in docs for j, x in items if x and template(x) and passes(template(t), template(x))}
    assert pairs(spark, docs, items) == want and want


def test_first_word_after_a_heading_and_within_a_sentence(spark):
    items = [(1, "What is the capital of France?"), (2, "Name the three largest rivers of Europe in order")]
    docs = [(1, "Question 12\nWhat is the capital of France?"), (2, "they ask Name the three largest rivers of Europe in order here"), (3, "What is the capital"), (4, "so what is the capital of France? they ask")]
    assert pairs(spark, docs, items) == {(1, 1), (2, 2), (4, 1)}


def test_verbatim_numbers_and_changed_ends(spark):
    sums = "12 + 7 = 19 , 30 - 4 = 26 , 5 x 9 = 45 , 80 / 16 = 5"
    story = "Tom has 3 apples and 3 pears and gives half of them to Ann before he walks home with Ann and Ben"
    docs = [
        (1, f"exercise {sums} end"),
        (2, "12 + 8 = 20 , 31 - 4 = 27 , 5 x 8 = 40 , 80 / 10 = 8 and so on and on"),
        (3, story.replace("3 apples", "4 apples").replace("3 pears", "5 pears").replace("Tom", "Tim").replace("Ann", "Eve").replace("Ben", "Bob")),
        (4, story[: story.index("home")] + "home with Bob and Bob"),
    ]
    assert pairs(spark, docs, [(1, sums), (2, story)]) == {(1, 1), (3, 2), (4, 2)}


def test_repeated_items_and_blocks(spark, monkeypatch):
    item = "How many litres of water does the old red pump move in 7 hours if it moves 3 litres in a minute"
    items = [(1, item), (2, item), (None, item), (3, "another thing that nobody asks about water and pumps and time at all in here")]
    docs = [(1, item.replace("7", "9")), (1, item), (None, item), (2, None), (3, "")]
    monkeypatch.setattr(d, "BLOCK_TOKENS", 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted([(r.doc_id, r.item_id, r.exact, r.start, r.n_slots) for r in d.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()], key=str)
    assert got == sorted([(i, j, e, 0, 6) for i, e in ((1, False), (1, True), (None, True)) for j in (1, 2, None)], key=str)


def test_tables_of_figures_cost_little():
    block = d.Block([(str(k), " ".join(str(k * 100 + j) for j in range(30))) for k in range(20)], 6)
    canon = d.Canon()
    began = time.thread_time()
    assert d._found(block, *canon(" ".join(str(j % 97) + ".5" for j in range(50_000))), 12) == []
    assert time.thread_time() - began < 2


def test_rewritten_numbers_and_units(spark):
    train = "A train goes 60 km in 3 hours from Boston to Paris so how long does it take to go 90 km?"
    sums = "What is 12 times 7?"
    docs = [
        (1, train.replace("60 km in 3 hours", "80km in 4h").replace("90 km", "200km")),
        (2, train.replace("60 km in 3 hours", "eighty km in four hours").replace("90", "two hundred and")),
        (3, "then we ask What is 15 times 8? and go on"),
        (4, "What is fifteen times twenty-five?"),
        (5, "What is the time in second place of 12 times 7 km?"),
        (6, train.replace("60 km", "one hundred twenty km").replace("90 km", "three hundred miles")),
    ]
    assert pairs(spark, docs, [(1, train), (2, sums)]) == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 1)}


def test_number_words_stand_for_one_number():
    canon = d.Canon()
    hashes, types, own = canon("Two hundred five. Six in 7 seconds, in all 8in and 3.5%")
    assert types.tolist() == [d._NUM, d._NUM, d._UNIT, d._NUM, d._UNIT, d._PLAIN, d._PLAIN, d._NUM, d._UNIT, d._PLAIN, d._NUM, d._UNIT]
    assert len(hashes) == len(own) == len(types)


def test_rows_stay_or_go_by_their_own_text(spark):
    item = "How many litres of water does the old red pump move in 7 hours if it moves 3 litres in a minute"
    docs = spark.createDataFrame([(1, item), (1, "clean text here"), (None, item), (None, "another clean text"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in d.decontaminate(docs, bench).collect()), key=str) == [(1, "clean text here"), (2, None), (None, "another clean text")]
