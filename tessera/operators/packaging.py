"""Packaging of conversations and records for training: selection, budgets, splits, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import message_tokens


def latest_user_text(turns: DataFrame) -> DataFrame:
    """The last user turn of each conversation."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def compact(turns: DataFrame, keep: int = 4, budget: int = 200) -> DataFrame:
    """Turns that stay when conversations over the token budget keep their last turns only; removed counts the rest."""
    by = Window.partitionBy("conv_id")
    t = turns.withColumn("tokens", message_tokens(F.col("text")))
    t = t.withColumns({"_n": F.count("*").over(by), "_back": F.row_number().over(by.orderBy(F.desc("turn"))), "_sum": F.sum("tokens").over(by)})
    over = (F.col("_n") > keep) & (F.col("_sum") >= budget)
    return t.where(~over | (F.col("_back") <= keep)).select("conv_id", "turn", "role", "tokens", F.when(over, F.col("_n") - keep).otherwise(0).cast("bigint").alias("removed"))


def usage_totals(turns: DataFrame) -> DataFrame:
    """Each turn's tokens and the conversation's so far."""
    t = turns.select("conv_id", "turn", message_tokens(F.col("text")).alias("tokens"))
    return t.withColumn("total", F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn")))


def chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: its messages in order."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(m.alias("_m")).select("conv_id", F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def split_label(year: Column, val: list[int], test: list[int]) -> Column:
    """train, val or test by year; unknown years train."""
    return F.when(year.isin(*val), "val").when(year.isin(*test), "test").otherwise("train")


def issues(rules: list[tuple[str, Column]]) -> Column:
    """Messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(message)) for message, bad in rules]))


def accepted_or(records: DataFrame, accepted: DataFrame, key: str, free: Column) -> DataFrame:
    """Records whose key is among the accepted ones, or for which the condition holds."""
    hit = accepted.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return records.join(hit, F.col(key) == F.col("_key"), "left").where(F.coalesce("_hit", F.lit(False)) | free).drop("_key", "_hit")
