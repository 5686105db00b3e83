"""Conversation structure repair: cheapest edits by cost layers, in the manner of Wu and Manber's approximate matching.

The initials of a conversation's roles must spell ``(s?(ua)+)?``. For every place between its rows, a word of bits holds
one layer per cost: the grammar states from which the rest can be finished at that cost or less. A row moves all
layers at once (each edit is a shift by its cost and a step of the grammar), and the first layer that
accepts gives the cost. Layers are kept relative to the cheapest one: two states never differ by more than SPREAD, so a word of
fixed size is enough for rows without number. The trace walks the words and takes, where edits tie, the least in ASCII.

A conversation is cut into pieces of consecutive rows, none of which needs another's rows: a piece is reduced to what it
costs between any two states, those small matrices are summed from the last piece on, and then each piece is traced
with the costs after it. So a conversation that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import stage, table

RETAG, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece, as a power of two.
PIECE_BITS = 12
#: Grammar states: nothing yet, after s, after u, after a. Rows may end in ENDS.
STATES, ENDS = 4, 0b1001
#: Any state can stand in for any other at INSERT * 2 at most, and a row raises the least cost by DELETE at most.
SPREAD = 2 * INSERT + DELETE
_ONES = int("1" * (SPREAD + 1), 16)
_ALL = (1 << STATES * (SPREAD + 1)) - 1
_COSTS = ArrayType(LongType())
_WHITE = " \t\n\x0b\f\r"


def _before(word: int, letter: str) -> int:
    """In all layers: the states from which the letter leads into a state of the layer."""
    if letter == "u":
        return (word >> 2 & _ONES) * 0b1011
    if letter == "a":
        return (word >> 3 & _ONES) << 2
    return word >> 1 & _ONES if letter == "s" else 0


def _next(state: int, letter: str) -> int | None:
    to = {"s": 1, "u": 2, "a": 3}.get(letter)
    return to if to and _before(1 << to, letter) >> state & 1 else None


def _later(word: int, cost: int) -> int:
    return word << STATES * cost & _ALL


def _inserting(word: int) -> int:
    for _ in range(2):
        word |= _later(_before(word, "u") | _before(word, "a"), INSERT)
    return word


def _back(word: int, base: int, code: str) -> tuple[int, int]:
    """The word before a row from the one behind it. code: '-' if the row has to go, else its initial, upper-case if truncated."""
    if not word:
        return word, base
    out = _later(word, DELETE)
    if code != "-":
        extra = TRUNCATED * code.isupper()
        out |= _later(_before(word, code.lower()), extra) | _later(_before(word, "u") | _before(word, "a"), RETAG + extra)
    out = _inserting(out)
    while not out & 0xF:  # the last layer holds what the one before it holds
        out = out >> STATES | out & 0xF << STATES * SPREAD
        base += 1
    return out, base


def _cost(word: int, base: int, state: int) -> int | None:
    """The first layer that has the state."""
    layers = word >> state & _ONES
    return base + ((layers & -layers).bit_length() - 1) // STATES if layers else None


def _word(costs: list[int]) -> tuple[int, int]:
    """Layers of states with the given costs."""
    base = min(costs)
    return sum((1 << s) * (_ONES << STATES * (c - base) & _ALL) for s, c in enumerate(costs)), base


#: Costs at the end of a conversation, by state.
END = [_cost(_inserting(_ONES * ENDS), 0, s) for s in range(STATES)]


@functools.lru_cache(maxsize=1000)
def crossing(codes: str) -> tuple[int, ...]:
    """What a piece costs from each state (by fours) to each state behind it, -1 where there is no way."""
    ways = []
    for to in range(STATES):
        word, base = _ONES << to, 0
        for code in reversed(codes):
            word, base = _back(word, base, code)
        ways.append([_cost(word, base, s) for s in range(STATES)])
    return tuple(-1 if ways[to][s] is None else ways[to][s] for s in range(STATES) for to in range(STATES))


@functools.lru_cache(maxsize=1000)
def trace(codes: str, after: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """For each state before a piece: the state behind it and its least cheapest script. after: costs of the
    rest by state. A script has, for each row, U or A for each inserted turn and then k (kept), - (deleted), u or a (new role)."""
    words = [_word(list(after))]
    for code in reversed(codes):
        words.append(_back(*words[-1], code))
    words.reverse()
    out = []
    for state in range(STATES):
        left, script, here = _cost(*words[0], state), [], 0
        while here < len(codes):
            code, (word, base), fits = codes[here], words[here + 1], "u" if state != 2 else "a"
            extra = TRUNCATED * code.isupper()
            reach = lambda cost, s, word=word, base=base, left=left: s is not None and left - cost >= base and bool(word >> STATES * min(left - cost - base, SPREAD) >> s & 1)
            kept, new = _next(state, code.lower()), _next(state, fits)
            if reach(DELETE, state):
                left, here = left - DELETE, here + 1
                script.append("-")
            elif left >= INSERT and _cost(*words[here], new) == left - INSERT:
                left, state = left - INSERT, new
                script.append(fits.upper())
            elif code != "-" and reach(extra, kept):
                left, state, here = left - extra, kept, here + 1
                script.append("k")
            else:
                left, state, here = left - extra - RETAG, new, here + 1
                script.append(fits)
        out.append((state, "".join(script)))
    return tuple(out)


def _costs_after(matrices: list) -> tuple[list[list[int]], list[int]]:
    """Costs by state behind each piece, and before the first one."""
    after, now = [], END
    for m in reversed(matrices):
        after.append([int(c) for c in now])
        now = [min(m[STATES * s + t] + now[t] for t in range(STATES) if m[STATES * s + t] >= 0) for s in range(STATES)]
    return after[::-1], [int(c) for c in now]


@F.pandas_udf(_COSTS)
def _crossing(codes: pd.Series) -> pd.Series:
    return codes.map(lambda c: list(crossing(c)))


@F.pandas_udf(StructType().add("after", ArrayType(_COSTS)).add("cost", LongType()))
def _after(matrices: pd.Series) -> pd.DataFrame:
    both = [_costs_after(list(m)) for m in matrices]
    return pd.DataFrame({"after": [a for a, _ in both], "cost": [now[0] for _, now in both]})


@F.pandas_udf(ArrayType(StructType().add("to", IntegerType()).add("script", StringType())))
def _trace(codes: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"to": s, "script": x} for s, x in trace(c, tuple(int(v) for v in a))] for c, a in zip(codes, after, strict=True)])


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role, by crc32 of conversation and turn; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    t = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    out = df.select(conv, turn, F.when(kind == 4, "user").otherwise(blank(role)).alias(role), t.alias(text), kind.alias("_kind")).where("_kind <> 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    return functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def _joined(a: DataFrame, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """a with b's other columns, by a key that may be null."""
    other = b.withColumnRenamed(key, "_key")
    return a.join(other, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def _digests(key: StructField):
    """SHA-256 of each conversation's lines, as its chunks come in order; nothing is held but the running hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, first = None, None, True
        for batch in batches:
            done = []
            schema = pa.schema([pa.field("_conv", batch.schema.field("_conv").type), pa.field("sha", pa.string())])
            for conv, lines in zip(batch.column("_conv").to_pylist(), batch.column("_lines").to_pylist(), strict=True):
                if first or conv != now:
                    done += [] if first else [(now, digest.hexdigest())]
                    now, digest, first = conv, hashlib.sha256(), False
                else:
                    digest.update(b"\n")
                digest.update(lines.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([digest.hexdigest()])], schema=schema)

    return run, StructType([StructField("_conv", key.dataType), StructField("sha", StringType())])


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bits: int = PIECE_BITS) -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. One row per repaired stretch of lines: _conv, _at (its order), _lines.

    Rows go by turn, nulls first; rows of equal turn by role and text (its first 64 characters, then a hash). A null
    role or text is one space; a null conversation is one of its own. Whole repeated rows are duplicates of the first. An empty
    table gives empty ones, columns beside the four are left out. A row's first fault counts: blank, duplicate, truncated.
    """
    white = lambda c: F.trim(F.coalesce(c, F.lit(" ")), F.lit(_WHITE))
    rows = df.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit(" ")).alias("_role"), F.coalesce(text, F.lit(" ")).alias("_text"))
    rows = rows.withColumns({"_sha": F.sha2("_text", 256), "_any": F.monotonically_increasing_id()})
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", F.substring("_text", 1, 64), "_sha", "_any"]
    letter = F.when(F.substring("_role", 1, 1).isin("s", "u", "a"), F.substring("_role", 1, 1)).otherwise("o")
    last = F.substring(white(F.col("_text")), -1, 1)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_any")
    rows = stage(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_letter": letter, "_blank": last == "", "_cut": ~last.isin(".", "!", "?")}), "turns")

    seen = stage(rows.groupBy("_conv", "_role", "_sha").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "turns-seen")
    flat = rows.select("_conv", "_role", "_sha", "_at", "_letter", "_blank", "_cut").alias("r").join(seen.alias("s"), F.expr("r._conv <=> s._conv AND r._role = s._role AND r._sha = s._sha"), "left")
    flat = flat.select("r._conv", "_at", "_letter", "_blank", (~F.col("_blank") & F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))).alias("_again"), "_cut")
    flat = flat.withColumn("_short", F.col("_cut") & ~F.col("_blank") & ~F.col("_again"))
    code = F.when(F.col("_blank") | F.col("_again"), "-").when(F.col("_short"), F.upper("_letter")).otherwise(F.col("_letter"))
    each = F.sort_array(F.collect_list(F.struct("_at", "_letter", code.alias("_code"))))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    pieces = flat.groupBy("_conv", F.shiftright("_at", piece_bits).alias("_piece")).agg(each.alias("_each"), count("_blank"), count("_again"), count("_short"))
    written = lambda f: F.array_join(F.transform("_each", lambda x: x[f]), "")
    pieces = pieces.select("_conv", F.col("_each")[0]["_at"].alias("_start"), written("_letter").alias("_letters"), written("_code").alias("_codes"), "_blank", "_again", "_short")
    pieces = stage(pieces, "pieces")

    pairs = F.regexp_count("_letters", F.lit("(?=su|ua|au)"))  # adjacent letters that are legal
    small = pieces.select("_conv", "_blank", "_again", "_short", F.struct("_start", _crossing("_codes").alias("m"), (F.length("_letters") - 1 - pairs).alias("bad"), F.substring("_letters", 1, 1).alias("a"), F.substring("_letters", -1, 1).alias("z")).alias("_p"))
    whole = small.groupBy("_conv").agg(F.sort_array(F.collect_list("_p")).alias("_p"), *[F.sum(c).alias(c) for c in ("_blank", "_again", "_short")])
    joints = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(1))), lambda x, y: F.when(F.concat(x["z"], y["a"]).isin("su", "ua", "au"), 0).otherwise(1))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    illegal = (total(F.transform("_p", lambda x: x["bad"])) + total(joints)).cast("long")
    whole = stage(whole.select("_conv", "_blank", "_again", "_short", illegal.alias("_illegal"), F.transform("_p", lambda x: x["_start"]).alias("_starts"), _after(F.transform("_p", lambda x: x["m"])).alias("_a")), "pieces-after")

    after = whole.select(F.explode(F.arrays_zip(F.col("_starts").alias("s"), F.col("_a.after").alias("a"))).alias("_x")).select(F.col("_x.s").alias("_start"), F.col("_x.a").alias("_after"))
    traced = stage(pieces.select("_conv", "_start", "_codes").join(after, "_start").select("_conv", "_start", _trace("_codes", "_after").alias("_ways")), "pieces-traced")
    ways = traced.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_start", F.transform("_ways", lambda w: w["to"]).alias("to")))).alias("_w"))
    states = F.aggregate("_w", F.array(F.lit(0)), lambda s, w: F.array_append(s, w["to"][F.element_at(s, -1)]))
    ways = ways.select("_conv", "_w", states.alias("_states")).withColumn("_end", F.element_at("_states", -1))
    entered = ways.select(F.explode(F.zip_with("_w", F.slice("_states", 1, F.size("_w")), lambda w, s: F.struct(w["_start"].alias("start"), s.alias("state")))).alias("_x"))
    entered = entered.select(F.col("_x.start").alias("_start"), F.col("_x.state").alias("_state"))
    scripts = stage(traced.join(entered, "_start").select("_conv", "_start", F.col("_ways")[F.col("_state")]["script"].alias("_script")), "scripts")
    tail = ways.select("_conv", F.when(F.col("_end") == 1, "UA").when(F.col("_end") == 2, "A").otherwise("").alias("_tail"))
    audits = scripts.groupBy("_conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_start", "_script"))), lambda x: x["_script"]), "").alias("_script"))

    edits = scripts.select("_start", F.posexplode(F.regexp_extract_all("_script", F.lit("[UA]*[-kua]"), F.lit(0))).alias("_i", "_edit")).select((F.col("_start") + F.col("_i")).alias("_at"), "_edit")
    added = lambda e: F.filter(F.transform(F.split(e, ""), lambda x: F.when(x == "U", "user:").when(x == "A", "assistant:")), lambda x: x.isNotNull())
    op = F.substring("_edit", -1, 1)
    own = F.when(op == "k", F.concat("_role", F.lit(":"), "_text")).when(op == "u", F.concat(F.lit("user:"), "_text")).when(op == "a", F.concat(F.lit("assistant:"), "_text"))
    lines = rows.select("_conv", "_at", "_role", "_text").join(edits, "_at").where("_edit <> '-'")
    lines = lines.select("_conv", "_at", F.array_join(F.concat(added(F.col("_edit")), F.filter(F.array(own), lambda x: x.isNotNull())), "\n").alias("_lines"))
    ends = tail.where("_tail <> ''").select("_conv", F.lit(2**62).alias("_at"), F.array_join(added(F.col("_tail")), "\n").alias("_lines"))
    lines = lines.unionByName(ends)
    run, schema = _digests(df.select(F.col(conv).alias("_conv")).schema["_conv"])
    digests = lines.repartition("_conv").sortWithinPartitions("_conv", "_at").select("_conv", "_lines").mapInArrow(run, schema)

    span = rows.groupBy("_conv", "_turn").count().groupBy("_conv").agg((F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")).alias("_gaps"))
    out = whole.select("_conv", "_blank", "_again", "_short", "_illegal", F.col("_a.cost").alias("_cost"))
    for part in (span, audits, tail, digests):
        out = _joined(out, part, "_conv")
    out = out.select(
        F.col("_conv").alias(conv),
        F.coalesce("_gaps", F.lit(0)).cast("long").alias("gaps"),
        F.col("_blank").alias("blank"),
        F.col("_again").alias("duplicate"),
        F.col("_short").alias("truncated"),
        F.col("_illegal").alias("illegal"),
        F.col("_cost").alias("cost"),
        F.translate(F.concat("_script", "_tail"), "UAk-ua", "IIKDRR").alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return out, lines


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired, _ = repair(damage(conversations))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = _joined(conversations.select("conv_id").distinct(), repaired, "conv_id")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_CRC = "list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))"
_SQL = rf"""
WITH RECURSIVE bits(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor({_CRC}, 4294967295) % 20 AS kind FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS n, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS c FROM damaged),
faults AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM placed),
codes AS (SELECT *, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS short, lag(c) OVER (PARTITION BY conv_id ORDER BY n) || c AS pair FROM faults),
starts AS (SELECT DISTINCT conv_id FROM damaged),
steps(conv_id, n, q, cost, audit, out) AS (
  SELECT conv_id, 0::BIGINT, x.q, x.cost, x.audit, x.out FROM starts, (VALUES (0, 0, '', []::VARCHAR[]), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) x(q, cost, audit, out)
  UNION ALL
  SELECT conv_id, n, q, cost, audit, out FROM (
    SELECT e.conv_id, e.n, i.q2 AS q, e.cost + i.cost AS cost, e.audit || i.audit AS audit, e.out || i.out AS out FROM (
      SELECT s.conv_id, r.n, o.q, s.cost + o.cost AS cost, s.audit || o.audit AS audit, CASE o.audit WHEN 'D' THEN s.out WHEN 'K' THEN s.out || [r.role || ':' || r.text] ELSE s.out || [CASE o.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END AS out
      FROM steps s JOIN codes r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1,
      (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)) g(p, c, q),
      LATERAL (SELECT g.q AS q, CASE WHEN g.c = '' THEN 2 WHEN g.c = r.c THEN 0 ELSE 1 END + CASE WHEN g.c <> '' AND r.short THEN 5 ELSE 0 END AS cost, CASE WHEN g.c = '' THEN 'D' WHEN g.c = r.c THEN 'K' ELSE 'R' END AS audit) o
      WHERE g.p = s.q AND (g.c = '' OR NOT (r.blank OR r.again) AND (g.c <> 's' OR r.c = 's'))
    ) e JOIN (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
      (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])) i(q, q2, cost, audit, out) ON i.q = e.q
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ended AS (SELECT s.* FROM steps s JOIN (SELECT conv_id, max(n) AS m FROM codes GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = z.m WHERE q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost, audit) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again, count(*) FILTER (short) AS short,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM codes GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.again, 0)::BIGINT AS duplicate, coalesce(c.short, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {"op11_conversation_repair": _SQL}
