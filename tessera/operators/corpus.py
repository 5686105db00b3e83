"""Building and keeping record sets: selections, joins with other record sets, quotas, life cycle, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import SPACES
from tessera.operators.dedup import keep_first

#: Levels of a corpus item in the order in which a benchmark takes them.
LEVELS = ("golden", "human_verified", "agent_verified")


def id_matches(id_: Column, given: list[str]) -> Column:
    """Whether an id equals or starts with any of the given strings; none given lets all through."""
    return F.lit(True) if not given else F.exists(F.array(*map(F.lit, given)), lambda g: F.startswith(id_, g))


def any_word(words: list[str], *fields: Column) -> Column:
    """Whether any of the words stands in the fields taken together, in any case."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w))


def row_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose JSON form holds the needle, in any case."""
    return df.where(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(needle.lower())))


def first_of_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """One row per key from several sources of equal columns: an earlier source wins, empty keys are left out."""
    ranked = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(k))
        ranked = s if ranked is None else ranked.unionByName(s)
    return keep_first(ranked.where(F.coalesce(key, F.lit("")).cast("string") != ""), [key], "_source").drop("_source")


def with_prompts(failures: DataFrame, prompts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Failures that have a prompt, with it; and those without one, which are left out and counted by the caller."""
    return failures.join(prompts, key), failures.join(prompts, key, "left_anti")


def add_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with those rows of new whose keys it lacks; adding twice changes nothing."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def override(rows: DataFrame, better: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value taken from better where it has one (not null or blank), else their own."""
    b = better.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    found = F.when(F.trim("_value") != "", F.col("_value"))
    return rows.join(b, F.col(key) == F.col("_key"), "left").withColumn(value, F.coalesce(found, value)).drop("_key", "_value")


def fill_missing(rows: DataFrame, made: DataFrame, key: str, value: str) -> DataFrame:
    """rows with blank values filled from made; filled tells which, and rows that stay blank count as failed."""
    m = made.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    j = rows.join(m, F.col(key) == F.col("_key"), "left").withColumn("_blank", blank)
    out = j.withColumn(value, F.when(F.col("_blank"), F.col("_value")).otherwise(F.col(value)))
    state = F.when(~F.col("_blank"), "kept").when(F.trim(F.coalesce("_value", F.lit(""))) == "", "failed").otherwise("filled")
    return out.withColumn("state", state).drop("_key", "_value", "_blank")


def scored(records: DataFrame, reports: dict[str, DataFrame], key: str, weights: dict[str, float]) -> DataFrame:
    """records with a score per report (0 where a report lacks the record) and their weighted total: one left join each."""
    out = records
    for name, report in reports.items():
        r = report.select(F.col(key).alias("_key"), F.col("score").alias(f"{name}_score"))
        out = out.join(r, F.col(key) == F.col("_key"), "left").drop("_key").na.fill(0.0, [f"{name}_score"])
    return out.withColumn("total", F.bround(sum((F.col(f"{n}_score") * w for n, w in weights.items()), F.lit(0.0)), 3))


def routed(tasks: DataFrame, policy: DataFrame, adapters: DataFrame, fallback: str = "base") -> DataFrame:
    """tasks with adapter: the first allowed one of the task's topic that is usable, not blocked and of an allowed status.

    policy: topic, allowed (array of names), statuses (array, or null for any); adapters: name, status, blocked.
    A topic without policy or without such an adapter gets the fallback."""
    each = policy.select("topic", "statuses", F.posexplode("allowed").alias("pos", "name")).join(adapters.where(~F.coalesce("blocked", F.lit(False))), "name")
    fits = F.col("statuses").isNull() | F.array_contains("statuses", F.col("status"))
    best = each.where(fits).groupBy("topic").agg(F.min_by("name", "pos").alias("adapter"))
    return tasks.join(best, "topic", "left").withColumn("adapter", F.coalesce("adapter", F.lit(fallback)))


def routing_audit(policy: DataFrame, adapters: DataFrame) -> DataFrame:
    """topic, name, state of every adapter that a policy names: ok, blocked or unknown."""
    each = policy.select("topic", F.explode("allowed").alias("name")).join(adapters.select("name", "blocked", F.lit(True).alias("_known")), "name", "left")
    return each.select("topic", "name", F.when(F.col("_known").isNull(), "unknown").when(F.col("blocked"), "blocked").otherwise("ok").alias("state"))


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference isn't null and names no target."""
    return rows.where(F.col(reference).isNotNull()).join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")


def sync_plan(source: DataFrame, target: DataFrame, preserved: Column) -> DataFrame:
    """path, action (added, modified, unchanged, deleted, preserved) of two listings of path, size, mtime."""
    s = source.select("path", F.col("size").alias("s_size"), F.col("mtime").alias("s_time"))
    t = target.select("path", F.col("size").alias("t_size"), F.col("mtime").alias("t_time"))
    j = s.join(t, "path", "full_outer")
    action = (
        F.when(F.col("t_size").isNull(), "added")
        .when(F.col("s_size").isNull(), F.when(preserved, "preserved").otherwise("deleted"))
        .when((F.col("s_size") != F.col("t_size")) | (F.col("s_time") > F.col("t_time")), "modified")
        .otherwise("unchanged")
    )
    return j.select("path", action.alias("action"))


def catalogue_matches(prompts: DataFrame, id_: str, text: str, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """The k entries of a small catalogue (name, kind) whose words a prompt shares most: id, kind, name, score, rank.
    Words meet by an equi-join; ties go by name."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    p = prompts.select(id_, F.explode(words(F.col(text))).alias("word"))
    c = catalogue.select("name", "kind", F.explode(words(F.col("name"))).alias("word"))
    hits = p.join(c, "word").groupBy(id_, "kind", "name").agg(F.count("*").alias("score"))
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc("score"), "name"))
    return hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def quota_sample(rows: DataFrame, by: str, seq: str, quotas: dict[str, int], other: int) -> DataFrame:
    """The first rows by seq of each group, as many as its quota; groups without one get ``other``."""
    limit = F.coalesce(*[F.when(F.col(by) == g, n) for g, n in quotas.items()], F.lit(other))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(seq))).where(F.col("_n") <= limit).drop("_n")


def oversampled(rows: DataFrame, copies: Column) -> DataFrame:
    """Each row as often as copies says, numbered from 1 in column copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def superseded(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key in order; events without a key all stay."""
    last = keep_first(events.where(F.col(key).isNotNull()), [key], F.desc(order))
    return last.unionByName(events.where(F.col(key).isNull()))


def by_level(rows: DataFrame, level: str, levels=LEVELS) -> DataFrame:
    """rows with priority: the place of their level in levels from 0, 99 for others."""
    at = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    return rows.withColumn("priority", F.when(F.coalesce(at, F.lit(0)) == 0, 99).otherwise(at - 1).cast("int"))


def category(message: Column, words: int = 6) -> Column:
    """A message's first words."""
    return F.array_join(F.slice(F.filter(F.split(message, f"{SPACES}+"), lambda w: w != ""), 1, words), " ")


def top_categories(rows: DataFrame, message: str, k: int = 10) -> DataFrame:
    """The k most frequent categories, ties by name, with their rank."""
    counts = rows.groupBy(category(F.col(message)).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")).cast("bigint"))  # of k rows


def dashboard(items: DataFrame, *dims: str) -> DataFrame:
    """Counts by each dimension and over all, with the share of all items, in one pass."""
    sets = [[d] for d in dims] + [[]]
    out = items.groupingSets(sets, *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    total = F.max("n").over(Window.partitionBy(F.lit(1)))  # one row per value of each dimension
    return out.withColumn("share", F.bround(F.col("n") / total, 3)).drop("_g")


def validation_summary(rows: DataFrame, id_: str, prompt: str, topic: str) -> DataFrame:
    """One row: records, distinct ids and prompts, whether any repeats, and whether all topics have as many records."""
    one = rows.agg(F.count("*").alias("records"), F.count_distinct(id_).alias("ids"), F.count_distinct(prompt).alias("prompts"))
    balance = rows.groupBy(topic).agg(F.count("*").alias("n")).agg((F.count_distinct("n") == 1).alias("balanced"))
    return one.join(balance).withColumns({"repeated_ids": F.col("ids") < F.col("records"), "repeated_prompts": F.col("prompts") < F.col("records")})


def reason_histogram(rows: DataFrame, reasons: str) -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def manifest_digest(files: DataFrame, by: str) -> DataFrame:
    """Per group, a digest over its paths in order with their contents' hashes. Bounded by a release's list of files."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat(x["path"], F.lit("\x00"), x["sha"], F.lit("\n")))
    return files.groupBy(by).agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


#: Steps of an item's life: action -> (level it needs, status it needs, new status, new level).
STEPS = {
    "submit": ("agent_verified", "candidate", "in_review", None),
    "approve": (None, None, "approved", "human_verified"),
    "reject": (None, None, "archive", None),
    "promote": ("human_verified", None, "golden", "golden"),
}


def stepped(items: DataFrame, actions: DataFrame) -> DataFrame:
    """items after one action each (id, action): status and level, whether it was allowed, and the history with a new entry.

    An item without action, or one whose action isn't allowed, stays as it is."""
    rule = F.coalesce(*[F.when(F.col("action") == a, F.struct(F.lit(lv).cast("string").alias("lv"), F.lit(st).cast("string").alias("st"), F.lit(to).alias("to"), F.lit(tl).cast("string").alias("tl"))) for a, (lv, st, to, tl) in STEPS.items()])
    j = items.join(actions, "id", "left").withColumn("_r", rule)
    ok = F.col("_r").isNotNull() & (F.col("_r.lv").isNull() | (F.col("_r.lv") == F.col("level"))) & (F.col("_r.st").isNull() | (F.col("_r.st") == F.col("status")))
    j = j.withColumn("allowed", F.coalesce(ok, F.lit(False)))
    entry = F.struct("action", F.col("status").alias("from_status"), F.col("_r.to").alias("to_status"))
    return j.withColumns({
        "history": F.when(F.col("allowed"), F.array_append("history", entry)).otherwise(F.col("history")),
        "level": F.when(F.col("allowed"), F.coalesce("_r.tl", "level")).otherwise(F.col("level")),
        "status": F.when(F.col("allowed"), F.col("_r.to")).otherwise(F.col("status")),
    }).drop("_r")


def unique_ids(rows: DataFrame, id_: str, seq: str) -> DataFrame:
    """rows with run_name: the id, and from its second row on the id with _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(id_).orderBy(seq))
    return rows.withColumn("_n", n).withColumn("run_name", F.when(F.col("_n") == 1, F.col(id_)).otherwise(F.concat(F.col(id_), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def cost(usage: DataFrame, prices: DataFrame, by: str, family: str) -> DataFrame:
    """Tokens and their price per group. prices: family, per_million."""
    priced = usage.join(prices, family, "left")
    return priced.groupBy(by).agg(F.sum("tokens").alias("tokens"), F.bround(F.sum(F.col("tokens") * F.coalesce("per_million", F.lit(0.0)) / 1e6), 6).alias("cost"))


def compressed(lines: DataFrame, id_: str, text: str, max_lines: int, max_chars: int) -> DataFrame:
    """Lines of each text without repeats (in any case), the first ones that fit a budget of lines and characters together."""
    each = lines.select(id_, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    once = keep_first(each.withColumn("_k", F.lower(F.trim("line"))), [id_, "_k"], "pos").drop("_k")
    by = Window.partitionBy(id_).orderBy("pos")
    used = F.sum(F.length("line") + 1).over(by)
    return once.withColumns({"n": F.row_number().over(by), "used": used}).where((F.col("n") <= max_lines) & (F.col("used") <= max_chars)).select(id_, "pos", "line")
