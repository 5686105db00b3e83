"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a re-parameterised question keeps its
template. Windows of template tokens are hashed and hash-joined against the benchmark's; windows of
placeholders alone, which anything would match, are joined by their words. A document that shares a window
is compared with the item along that alignment, and its slots are then checked: names and units must map
one to one, and a number that the item repeats before the same word must be repeated in the document.
A stretch that passes is enough, whatever differs elsewhere; a verbatim one needs no check.

The benchmark's distinct texts are joined in blocks of a bounded size, each broadcast once to all
executors; documents are never shuffled and only hits leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stage, table
from .shingles import mixed, windows

#: Template tokens in a window; tokens on one alignment that make a document contaminated (all of a shorter item).
WINDOW, RUN = 6, 12
#: Of the tokens of a stretch that isn't verbatim, so many at least must be words, not placeholders; of an item shorter
#: than a run, which must be there whole.
MIN_WORDS, MIN_WORDS_SHORT = 4, 3
#: Template tokens of the benchmark that are broadcast at a time.
BLOCK_TOKENS = 500_000
#: Hashes of leaking texts (32 bytes each) that may be broadcast; beyond, they and the documents are joined by shuffle.
BROADCAST_LEAKS = 500_000
#: Unit words and signs.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years $ € £ usd eur gbp dollar dollars euro euros cent cents "
    "% percent degree degrees °c °f c f k kph mph km/h m/s w kw kwh v j n pa hz".split()
)
#: Units that are other words as well, and count as units behind a number only; number words.
AMBIGUOUS = frozenset("in second k n s h m f v j t g w pa mi l min sec yd c".split())
NUMBERS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
#: A number and a unit in one word.
_ATTACHED = re.compile(r"([^\w$€£]*[$€£]?[0-9]+(?:[.,/][0-9]+)*)([a-zA-Z°%/]+)(\W*)")
_WORD = re.compile(r"\w+(?:[.,/'’]\w+)*|[%$€£]")
_NUMBER = re.compile(r"[0-9]+(?:[.,/][0-9]+)*")
_ENDS = (".", "!", "?", ":")
#: Marks that stand around words and aren't part of them.
_AROUND = ".,;:!?\"'()[]{}-"
_NUM, _NAME, _UNIT, _PLAIN = 1, 2, 3, 0


class Canon:
    """Template tokens of texts. Words are kept with what they become at a sentence's start and within one."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.pairs: dict[int, tuple[str, str]] = {}
        self.table = [np.zeros(1024, t) for t in (np.uint64, np.int8, np.uint64, np.int8, np.uint64, bool, np.int8)]

    def _add(self, word: str) -> None:
        """Number a word and keep its hash and type at a start, its hash and type within, its own hash, whether it ends a
        sentence, and what its place decides: 1 a number word, 2 a unit behind a number only, 3 a number and a unit in one."""
        core, n, ends = word.strip(_AROUND), len(self.ids), word.endswith(_ENDS)
        self.ids[word] = n
        if n == len(self.table[0]):
            self.table = [np.concatenate([x, np.zeros_like(x)]) for x in self.table]
        start_hash, start_type, in_hash, in_type, own, last, special = self.table
        if ends:
            last[n] = True
        parts = None
        if not core.isalpha():  # a word of letters alone needs no closer look
            parts = _WORD.findall(word)
            core = "".join(parts)
        low = core.lower()
        own[n] = plain = xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace"))
        start_hash[n] = in_hash[n] = plain
        if low in AMBIGUOUS:
            special[n] = 2
        attached = parts and _ATTACHED.fullmatch(word)
        if parts and (_NUMBER.fullmatch(core) or core[:1] in "$€£" and _NUMBER.fullmatch(core[1:] or "-")):
            start_hash[n] = start_type[n] = in_hash[n] = in_type[n] = _NUM
        elif attached and attached[2].lower() in UNITS:
            special[n] = 3
            self.pairs[n] = attached[1], attached[2] + attached[3]
        elif low in NUMBERS or parts and all(p.lower() in NUMBERS for p in parts):
            start_hash[n] = start_type[n] = in_hash[n] = in_type[n] = _NUM
            special[n] = 1
        elif low in UNITS and low not in AMBIGUOUS:
            start_hash[n] = start_type[n] = in_hash[n] = in_type[n] = _UNIT
        elif core[:1].isupper():
            in_hash[n] = in_type[n] = _NAME

    def _numbers(self, parts: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            for w in parts:
                if w not in ids:
                    self._add(w)
            return np.fromiter(map(ids.__getitem__, parts), np.int64, len(parts))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hashes, slot types and own hashes of a text's words, those without letters or digits left out. A number and
        a unit in one word are two; of number words in a row the first stands for all; a unit that is another word
        as well is one behind a number only."""
        parts = text.split()
        if len(self.ids) > self.LIMIT:
            self._clear()
        at = self._numbers(parts)
        special, ends = self.table[6][at], self.table[5][at]
        if (special & 1).any():
            at = self._numbers([x for k, w in zip(at.tolist(), parts, strict=True) for x in self.pairs.get(k, (w,))])
            at = at[self.table[0][at] != _EMPTY]  # what has no letter or digit parts nothing
            special, ends = self.table[6][at], self.table[5][at]
            again = np.zeros(len(at), bool)
            again[1:] = (special[1:] == 1) & (special[:-1] == 1) & ~ends[:-1]
            one = np.nonzero(~again)[0]
            at, special, ends = at[one], special[one], ends[np.append(one[1:], len(at)) - 1]
        start_hash, start_type, in_hash, in_type, own = (x[at] for x in self.table[:5])
        first = np.ones(len(at), bool)
        first[1:] = ends[:-1]
        hashes, types = np.where(first, start_hash, in_hash), np.where(first, start_type, in_type)
        kept = start_hash != _EMPTY
        if not kept.all():
            hashes, types, own, special = hashes[kept], types[kept], own[kept], special[kept]
        behind = np.nonzero(types[:-1] == _NUM)[0] + 1
        if len(behind):
            unit = behind[special[behind] == 2]
            hashes[unit], types[unit] = _UNIT, _UNIT
        return hashes, types, own


_EMPTY = np.uint64(xxhash.xxh3_64_intdigest(b""))


def _slots_only(types: np.ndarray, n: int) -> np.ndarray:
    """Whether each window of n tokens holds placeholders alone."""
    plain = np.cumsum(np.append(0, types == _PLAIN))
    return plain[n:] == plain[: len(plain) - n]


_NONE = np.zeros((0, 2), np.int64)


class Table:
    """Places (item, token) by window hash, sorted."""

    def __init__(self) -> None:
        self.hashes, self.owners, self.places = [], [], []

    def add(self, hashes: np.ndarray, owner: int, places) -> None:
        self.hashes.append(hashes)
        self.owners.append(np.full(len(hashes), owner))
        self.places.append(np.asarray(places))

    def close(self) -> Table:
        h = np.concatenate([np.zeros(0, np.uint64), *self.hashes])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owners, self.places = (np.concatenate([np.zeros(0, np.int64), *x])[order] for x in (self.owners, self.places))
        return self

    def hits(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (item, shift from the item's places to the document's) of equal windows. w: hashes of the windows at places at."""
        lo = np.searchsorted(self.hashes, w)
        some = np.nonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == w)[0]
        if not len(some):
            return _NONE
        lo, at = lo[some], at[some]
        many = np.searchsorted(self.hashes, w[some], side="right") - lo
        x = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.unique(np.stack([self.owners[x], np.repeat(at, many) - self.places[x]], 1), axis=0)


class Block:
    """Items of one block with tables of their windows: by template, by words where a window has placeholders alone,
    and for items shorter than a window, as wholes by length."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        canon = Canon()
        self.window, self.items = window, []
        self.tables: dict[tuple[int, bool], Table] = {}
        for key, text in items:
            hashes, types, own = canon(text)
            k, n = len(self.items), min(window, len(hashes))
            # a capital at the item's start may stand within a sentence elsewhere
            other = np.append(np.uint64(_NAME), hashes[1:]) if len(hashes) and types[0] == _PLAIN and text.split()[0][:1].isupper() else None
            self.items.append((key, hashes, types, own, other is not None))
            if not n:
                continue
            slots = _slots_only(types, n)
            for w, which, words in ((hashes, ~slots, False), (own, slots, True)):
                self.table(n, words).add(windows(w, n)[which], k, np.nonzero(which)[0])
            if other is not None:
                only = _slots_only(np.append(np.int8(_NAME), types[1:n]), n)[0]
                self.table(n, bool(only)).add(windows((own if only else other)[:n], n), k, [0])
        self.tables = {k: t for k, t in self.tables.items() if len(t.close().hashes)}

    def table(self, n: int, words: bool) -> Table:
        return self.tables.setdefault((n, words), Table())

    def hits(self, hashes: np.ndarray, types: np.ndarray, own: np.ndarray) -> np.ndarray:
        found = []
        for (n, words), t in self.tables.items():
            if len(hashes) < n:
                continue
            if words:
                at = np.nonzero(_slots_only(types, n))[0]
                w = np.zeros(len(at), np.uint64) + np.uint64(n)
                for i in range(n):
                    w = mixed(w * np.uint64(0x9E3779B97F4A7C15) + own[at + i])
                found.append(t.hits(w, at))
            else:
                found.append(t.hits(windows(hashes, n), np.arange(len(hashes) - n + 1)))
        found = [x for x in found if len(x)]
        return np.unique(np.concatenate(found), axis=0) if found else _NONE


def stretch(types: list[int], item: list[int], doc: list[int], after: list[int], least: int, min_words: int) -> tuple[int, int]:
    """Start and end of the longest stretch of aligned tokens whose slots are consistent, with least tokens and min_words
    plain ones at least; (0, 0) if none. Names and units map one to one; a number before the same token maps to one number."""
    seen: dict[tuple, tuple[int, int]] = {}
    best, left, plain = (0, 0), 0, [0]
    for at, (t, a, b, z) in enumerate(zip(types, item, doc, after, strict=True)):
        plain.append(plain[-1] + (t == _PLAIN))
        if t != _PLAIN:
            for key, value in [((t, a, z), b)] if t == _NUM else [((t, a, 0), b), ((t, b, 1), a)]:
                was, last = seen.get(key, (value, -1))
                if was != value:
                    left = max(left, last + 1)
                seen[key] = (value, at)
        if at + 1 - left >= max(least, best[1] - best[0] + 1) and plain[-1] - plain[left] >= min_words:
            best = (left, at + 1)
    return best


def _runs(ok: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the runs of true values that are long enough."""
    edges = np.nonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))[0].reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if b - a >= least]


def _found(block: Block, hashes: np.ndarray, types: np.ndarray, own: np.ndarray, run: int) -> list[tuple]:
    """(item, first word, end, tokens matched, slots, exact) of each item's longest stretch that passes."""
    best: dict[int, tuple] = {}
    for k, shift in block.hits(hashes, types, own).tolist():
        key, item_hashes, item_types, item_own, capital = block.items[k]
        n = len(item_hashes)
        a, b = max(0, -shift), min(n, len(hashes) - shift)
        there = slice(a + shift, b + shift)
        same = item_own[a:b] == own[there]
        equal = same | (item_hashes[a:b] == hashes[there])
        if capital and a == 0 and hashes[shift] == _NAME:
            equal[0] = True
        runs = _runs(equal, min(block.window, n))
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(*r) for r in runs)])
        least = min(run, n)
        if len(at) < least:
            continue
        kinds, words, after = item_types[a:b][at], item_own[a:b], np.append(item_hashes[a + 1 : b], 0)
        s, e = stretch(kinds.tolist(), words[at].tolist(), own[there][at].tolist(), after[at].tolist(), least, min(MIN_WORDS_SHORT if n < run else MIN_WORDS, len(at)))
        chosen = at[s:e]
        for p, q in _runs(same, least):
            if q - p > len(chosen):
                chosen = np.arange(p, q)
        if len(chosen) and (k not in best or len(chosen) > best[k][3]):
            slots = int((item_types[a:b][chosen] != _PLAIN).sum())
            best[k] = (key, int(chosen[0]) + a + shift, int(chosen[-1]) + a + shift + 1, len(chosen), slots, bool(same[chosen].all()))
    return list(best.values())


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start and end (template tokens of
    the document, end exclusive), n_matched, n_slots, exact.

    Of an item's stretches in a document the longest is told. Null and empty texts on either side hold
    nothing. An item with fewer tokens than the run must be there whole. Repeated documents repeat their
    rows, repeated items theirs; ids may be null and are carried as they are. An empty table on either side gives an empty result. Other columns don't matter.
    """
    spark = docs.sparkSession
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, _key string, start int, end int, n_matched int, n_slots int, exact boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    items = benchmark.select(F.col(item_id).alias("_item"), F.sha2(item_text, 256).alias("_key"), F.col(item_text).alias("_text")).where("length(_text) > 0")
    texts = items.select("_key", "_text").dropDuplicates(["_key"])
    tokens = texts.agg(F.sum(F.length("_text") / 2)).first()[0] or 0
    n_blocks = int(tokens // BLOCK_TOKENS) + 1
    out = None
    for b in range(n_blocks):
        rows = texts.where(F.pmod(F.xxhash64("_key"), F.lit(n_blocks)) == b).collect()  # distinct texts of BLOCK_TOKENS or so
        held = spark.sparkContext.broadcast(cloudpickle.dumps(Block(sorted((r[0], r[1]) for r in rows), window)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            canon, block = Canon(), cloudpickle.loads(held.value)
            for batch in batches:
                ids, found = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if t := t.as_py():
                        new = _found(block, *canon(t), run)
                        ids += [i] * len(new)
                        found += new
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *cols], arrow, strict=True)], schema=arrow)

        part = docs.select(doc_id, text).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    named = out.join(items.select("_key", F.col("_item").alias(item_id)), "_key")
    return named.select(doc_id, item_id, "start", "end", "n_matched", "n_slots", "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item. A text decides for itself, so rows that repeat an id, or have none, stay or
    go by their own text."""
    key = F.unhex(F.sha2(F.col(text), 256))
    leaks = stage(find_leaks(docs.select(key.alias("_leak"), text), benchmark, "_leak", text, **options).select("_leak").distinct(), "leaks")
    few = F.broadcast(leaks) if leaks.count() <= BROADCAST_LEAKS else leaks
    return docs.join(few, key == leaks["_leak"], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
SQL: dict[str, str] = {}
