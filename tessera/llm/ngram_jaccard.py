"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its hashed word shingles. Sizes fall into bands; in a band, similar sets
differ in at most k elements. The feature domain is partitioned by hash into n1 parts, so that for
similar sets some parts differ in k2 elements at most; each part is partitioned again into n2, and
every subset of n2 - k2 of these is enumerated: similar sets agree wholly on one of them, whose hash
is the signature they share. Sets near a band's upper edge also take the next band's partition.

Exact copies are folded into one representative before anything is compared. Each signature's members
are first compared with its leader (the smallest id) only and the links found are joined into components.
Then the members of each signature that still has several components are compared with each other: in
tasks, in order of size, each with those in reach of its size, by sketches that bound the difference of
two sets from below, so that few pairs leave a task. Every pair that passes is checked against the whole
sets. Pairs within a component can't change it and are skipped; every other pair that shares a signature
is compared. Signatures with the same members count once, large ones are dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stage, table
from .components import connected_components
from .shingles import WordHashes, mixed, split_words, windows

#: Words in a shingle and least similarity (percent) unless a caller says otherwise.
N, PERCENT = 5, 80
#: A signature is common if it has so many rows in a sample of this share (3,200 rows or so).
SAMPLE, COMMON_ROWS = 1 / 64, 50
#: Copies whose ids, and common signatures, that may be broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Members of a signature in one block of the second comparison; least cells of a sketch.
BLOCK, CELLS = 4000, 1024
#: Pairs that a task compares at a time.
PAIRS = 50_000


class PartEnum:
    """Signatures of sets under a least Jaccard similarity in percent."""

    #: A band's sizes grow by the similarity's inverse to this power.
    STEPS = 2

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low = [1]
        #: Second level: differences allowed in a part, parts of a part. Lower similarities need larger subsets, or a signature covers too few elements.
        self.k2, self.n2 = (1, 2) if percent >= 78 else (1, 3) if percent >= 65 else (2, 5)
        self.subsets = list(combinations(range(self.n2), self.n2 - self.k2))

    def _low(self, band: int) -> int:
        """Least size of a band."""
        while len(self.low) <= band:
            at = self.low[-1]
            for _ in range(self.STEPS):
                at = max(at, at * 100 // self.percent)
            self.low.append(at + 1)
        return self.low[band]

    def band(self, size: int) -> int:
        b = 0
        while self._low(b + 1) <= size:
            b += 1
        return b

    def instances(self, size: int) -> list[int]:
        """Bands whose partition a set of this size takes: its own, and the next if a similar set may lie there."""
        b = self.band(size)
        return [b, b + 1] if size * 100 >= self.percent * self._low(b + 1) else [b]

    def parts(self, band: int) -> int:
        """n1: one part more than those that may differ in more than k2 elements. 0 where similar sets are equal."""
        largest = self._low(band + 1) - 1
        k = 2 * largest * (100 - self.percent) // (100 + self.percent)
        return k // (self.k2 + 1) + 1 if k else 0

    def left_out(self, size: int, n1: int) -> int:
        """Parts that a set of this size leaves out, its poorest, whose signatures tell little.

        Similar sets of sizes a and b differ in (a + b)(100 - percent) / (100 + percent) elements at most, so
        that over k2 + 1 is the most parts they can't agree on. Half of n1 - 1, less a set's share of these, may
        be left out: what two sets leave out and what they can't agree on is n1 - 1 at most, so a part remains."""
        d = (self.k2 + 1) * (100 + self.percent)
        return max(0, ((n1 - 1) * d - 2 * size * (100 - self.percent)) // (2 * d))

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        """Signatures (of 48 bits) of a set of distinct hashes."""
        out = []
        value = mixed(elements ^ np.uint64(0x5851F42D4C957F2D))
        for band in self.instances(len(elements)) if len(elements) else []:
            n1 = self.parts(band)
            if not n1:
                continue
            skip = self.left_out(len(elements), n1)
            part = (elements >> np.uint64(33)) % np.uint64(n1)
            cell = (part * np.uint64(self.n2) + (elements & np.uint64(0x7FFFFFFF)) % np.uint64(self.n2)).astype(np.int64)
            cells = n1 * self.n2
            low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
            high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), cells).astype(np.uint64)
            sums = (low + (high << np.uint64(32))).reshape(n1, self.n2)
            keep = np.arange(n1)
            if skip:
                count = np.bincount(cell, minlength=cells).reshape(n1, self.n2)
                poorest = np.min([count[:, chosen].sum(1) for chosen in self.subsets], axis=0)
                keep = np.argsort(poorest, kind="stable")[skip:]
            for i, chosen in enumerate(self.subsets):
                place = (keep.astype(np.uint64) * np.uint64(len(self.subsets) + 1) + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1)
                out.append(mixed(sums[np.ix_(keep, chosen)].sum(1, dtype=np.uint64) + mixed(place)))
        return np.concatenate(out) >> np.uint64(16) if out else np.zeros(0, np.uint64)


def shingle_set(hashes: WordHashes, text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: runs of n words, or all words if fewer; none without words."""
    return np.unique(windows(hashes(split_words(text)), n))


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell, a bit each. An element that only one of two sets has changes one
    bit, so the bits in which two sketches differ are at most as many as the sets' difference, and while the
    difference is small against the cells, nearly as many. There are CELLS cells, or a power of two up to twice the set's size."""
    cells = max(CELLS, 1 << (max(2 * len(elements), 1).bit_length() - 1))
    return np.packbits(np.bincount((elements >> np.uint64(20)).astype(np.int64) % cells, minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(s: bytes, size: int) -> np.ndarray:
    """A sketch brought down to a size in bytes: cells that fall together add up."""
    return np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), axis=0)


def far(a: bytes, b: bytes) -> int:
    """A lower bound of two sets' difference."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def signed(df: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """id, n_shingles, digest (of the set, 128 bits), sketch and sigs of each row; a task holds one batch."""
    kind = to_arrow_type(df.schema[doc_id].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = WordHashes(), PartEnum(percent)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sizes, digests, sigs, sketches = [], [], [], []
                for t in part.column(1):
                    s = shingle_set(hashes, t.as_py(), n)
                    sizes.append(len(s))
                    sketches.append(sketch(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(sign(s).view(np.int64))
                ends = np.cumsum([0, *map(len, sigs)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), lists], ["id", "n_shingles", "digest", "sketch", "sigs"])

    return df.select(doc_id, text).mapInArrow(rows, f"id {df.schema[doc_id].dataType.simpleString()}, n_shingles long, digest binary, sketch binary, sigs array<long>")


def sets_of(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """id and shingle set of each row."""
    kind = to_arrow_type(df.schema[doc_id].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingle_set(hashes, t.as_py(), n) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), lists], ["id", "shingles"])

    return df.select(doc_id, text).mapInArrow(rows, f"id {df.schema[doc_id].dataType.simpleString()}, shingles array<long>")


def shared(rows: DataFrame) -> DataFrame:
    """sig, lead, id: members of the signatures that several ids have; lead is the smallest. rows: sig, id.

    Signatures meet in one shuffle. Common ones, found in a sample, don't go through it whole: their
    smallest ids are found by sums of tasks and joined, by broadcast while they are few and else by a
    join whose large keys Spark splits. The sample decides only the way, not the result."""
    common = stage(rows.sample(SAMPLE, seed=1).groupBy("sig").count().where(F.col("count") >= COMMON_ROWS).select("sig"), "common")
    rare, some = rows, common.count()
    small = (lambda d: F.broadcast(d)) if some <= BROADCAST_IDS else (lambda d: d)
    if some:
        rare = rows.join(small(common), "sig", "left_anti")
    sig = Window.partitionBy("sig")
    out = rare.withColumns({"lead": F.min("id").over(sig), "z": F.max("id").over(sig)}).where("lead <> z").select("sig", "lead", "id")
    if some:
        often = rows.join(small(common), "sig", "left_semi")
        lead = stage(often.groupBy("sig").agg(F.min("id").alias("lead")), "leaders")
        out = out.unionByName(often.join(small(lead), "sig").select("sig", "lead", "id"))
    return out


def near(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that may be similar by size and sketch: the cells' differences add up to no more than
    two sets of these sizes may differ. sized: node, size, sketch."""
    side = lambda k: sized.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("sketch").alias(f"{k}_sketch"))
    schema = pairs.select("u", "v").schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [b.column(c).to_numpy() for c in ("u_size", "v_size")]
            ok = np.minimum(*size) * 100 >= np.maximum(*size) * percent
            for i in np.nonzero(ok)[0]:
                ok[i] = far(b.column("u_sketch")[i].as_py(), b.column("v_sketch")[i].as_py()) * (100 + percent) <= (size[0][i] + size[1][i]) * (100 - percent)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_size", "v_size", "u_sketch", "v_sketch").mapInArrow(keep, schema)


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose whole sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    ratio = (F.least(F.size("a"), F.size("b")) * 100) >= (F.greatest(F.size("a"), F.size("b")) * percent)
    both = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(a, "u").join(b, "v").where(ratio).withColumn("i", both)
    return joined.where(F.col("i") * 100 >= (F.size("a") + F.size("b") - F.col("i")) * percent).select("u", "v")


def within(groups: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (x, y), x before y, of one group whose sizes may be similar; rows come by (group, size)."""
    n = len(groups)
    last = np.append(np.nonzero(np.diff(groups))[0] + 1, n)
    upto = last[np.searchsorted(last, np.arange(n), side="right")]
    base = np.cumsum(np.append(0, np.diff(groups) != 0)) * (np.int64(1) << 40)
    reach = np.searchsorted(base + sizes, base + sizes * 100 // percent, side="right")
    many = np.minimum(upto, reach) - np.arange(n) - 1
    sums, at = np.cumsum(many), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, side="right")))
        m = many[at:to]
        x = np.repeat(np.arange(at, to), m)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        at = to


def apart(members: DataFrame, labels: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that share a signature, lie in different components and may be similar by size and sketch.

    members: sig, id; labels: node, component; sized: node, size, sketch. Of signatures with the same
    members one is taken. One with over BLOCK members is dealt into blocks, and each pair of blocks is a
    group of its own, so that it spreads over tasks; no pair is made as a row before it passes."""
    named = members.join(labels, F.col("id") == F.col("node"), "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sums = named.groupBy("sig").agg(F.count("*").alias("m"), F.min("component").alias("a"), F.max("component").alias("z"), total("id").alias("h"), total("id", F.lit(1)).alias("g"))
    kept = sums.where("m > 2 AND a <> z").groupBy("m", "h", "g").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = named.join(kept, "sig").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("sig", F.least("b", "o"), F.greatest("b", "o"))
    dealt = dealt.select(key.alias("key"), (F.col("blocks") > 1).alias("split"), "b", "o", "id", "component").join(sized, F.col("id") == F.col("node"))
    dealt = dealt.select("key", "size", F.col("b").alias("b"), (F.col("split") & (F.col("b") != F.col("o"))).alias("two"), "id", "component", "sketch")
    kind = to_arrow_type(members.schema["id"].dataType)

    def compare(t: pa.Table) -> pa.RecordBatch:
        key, size, b, two, ids, component = (t.column(c).to_numpy() for c in ("key", "size", "b", "two", "id", "component"))
        whole = t.column("sketch").to_pylist()
        long = np.array([len(x) * 8 > CELLS for x in whole])
        cells = np.array([folded(x, CELLS // 8) for x in whole])
        known, code = np.unique(ids, return_inverse=True)
        found = np.zeros(0, np.int64)  # each pair once, whatever the signatures it shares
        for x, y in within(key, size, percent):
            ok = (component[x] != component[y]) & ~(two[x] & (b[x] == b[y]))
            x, y = x[ok], y[ok]
            most = (size[x] + size[y]) * (100 - percent) // (100 + percent)
            close = np.bitwise_count(cells[x] ^ cells[y]).sum(1, dtype=np.int64) <= most
            x, y, most = x[close], y[close], most[close]
            for k in np.nonzero(long[x] & long[y])[0]:
                if far(whole[x[k]], whole[y[k]]) > most[k]:
                    most[k] = -1
            x, y = x[most >= 0], y[most >= 0]
            found = np.union1d(found, np.minimum(code[x], code[y]) * len(known) + np.maximum(code[x], code[y]))
        u, v = np.divmod(found, len(known))
        return pa.RecordBatch.from_arrays([pa.array(known[u], kind), pa.array(known[v], kind)], ["u", "v"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            key = batch.column(0).to_numpy()
            cut = np.nonzero(key != key[-1])[0] if len(key) else []
            if n < 5_000 or not len(cut):
                continue
            cut = int(cut[-1]) + 1  # the last group may go on in the next batch
            yield compare(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, n = [batch.slice(cut)], batch.num_rows - cut
        if n:
            yield compare(pa.Table.from_batches(held))

    node = members.schema["id"].dataType.simpleString()
    return dealt.repartition("key").sortWithinPartitions("key", "size").mapInArrow(rows, f"u {node}, v {node}").distinct()


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id of each row of df.

    component_id is the smallest id reachable by links; two documents are linked when their sets'
    intersection is at least percent of their union. A null or empty text, or one without words, has
    an empty set and links to nothing. Texts with fewer than n words are one shingle. A row without
    an id can't be named: it keeps its size, has a null component and links to nothing. Rows that
    repeat an id are one document with the links of all its texts, each row returned. Other columns
    don't matter. An empty table gives an empty one.
    """
    base = stage(signed(df, doc_id, text, n, percent), "signatures")
    named = base.where("id IS NOT NULL AND n_shingles > 0")
    classes = stage(named.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    copies = stage(named.select("id", "digest").join(classes, "digest").where("id <> rep").select("id", "digest", "rep").distinct(), "copies")
    out_ = copies.select(F.col("id").alias("_i"), F.col("digest").alias("_d"))
    if copies.count() <= BROADCAST_IDS:
        out_ = F.broadcast(out_)
    reps = named.join(out_, (F.col("id") == F.col("_i")) & (F.col("digest") == F.col("_d")), "left_anti")
    members = stage(shared(reps.select(F.explode("sigs").alias("sig"), "id")), "members")
    pairs = members.where("lead <> id").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    sized = named.select(F.col("id").alias("node"), F.col("n_shingles").alias("size"), "sketch")
    texts = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def checked(candidates: DataFrame) -> DataFrame:
        ids = candidates.select(F.col("u").alias("id")).unionByName(candidates.select(F.col("v").alias("id"))).distinct()
        return links(candidates, stage(sets_of(texts.join(ids, "id", "left_semi"), "id", "text", n), "sets"), percent)

    # an id with several texts stands for all of them
    again = named.groupBy("id").count().where("count > 1").select("id")
    same = copies.join(again, "id").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    first = stage(checked(stage(near(pairs, sized, percent), "close")).unionByName(same).distinct(), "first")
    stars = connected_components(first)
    rest = stage(apart(members.select("sig", "id"), stars, sized, percent), "rest")
    stars = stars.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = stage(connected_components(stars.unionByName(checked(rest))), "labels")
    out = base.join(copies.select(F.col("digest").alias("_d"), F.col("id").alias("_i"), "rep"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("_i")), "left")
    out = out.select("id", "n_shingles", F.coalesce("rep", "id").alias("node"))
    return out.join(labels, "node", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_components(docs, n=3, percent=90).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
SQL = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * i >= 90 * (p.n + q.n - i)),
c AS (SELECT u, v FROM l UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(v) FROM c WHERE c.u = doc_id), doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id)"""
}
