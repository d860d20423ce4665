"""Conversation tables: (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.common import top_n_per

# Turns kept per thread.
MAX_TURNS = 15


def thread_stats(turns: DataFrame) -> DataFrame:
    """Input (not assistant) and output (assistant) messages per thread."""
    reply = F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(~reply).alias("input_messages"), F.count_if(reply).alias("output_messages"))


def last_reply(turns: DataFrame) -> DataFrame:
    """Last assistant text per thread, '' when there is none; one aggregate."""
    reply = F.col("role") == "assistant"
    return turns.groupBy("conv_id").agg(F.coalesce(
        F.max_by("text", F.when(reply, F.col("turn"))), F.lit("")).alias("reply"))


def latest_message(turns: DataFrame) -> DataFrame:
    """Text and role of the last message per thread, whatever its role."""
    return turns.groupBy("conv_id").agg(
        F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


def capped_turns(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The first ``max_turns`` turns per thread; the group limit runs before the shuffle."""
    return top_n_per(turns, ["conv_id"], [F.asc("turn")], max_turns, rank="position")


def assemble_threads(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per thread with its messages in order, at most ``max_turns``."""
    messages = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return capped_turns(turns, max_turns).groupBy("conv_id").agg(messages.alias("messages"))


def append_turns(history: DataFrame, new: DataFrame) -> DataFrame:
    """New turns after the history: their numbers continue each thread's last one."""
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    first = new.groupBy("conv_id").agg(F.min("turn").alias("_first"))
    shifted = (new.join(first, "conv_id").join(last, "conv_id", "left")
               .withColumn("turn", F.col("turn") - F.col("_first") + F.coalesce(F.col("_last") + 1, F.lit(0)))
               .select(*history.columns))
    return history.unionByName(shifted)


def export_conversations(turns: DataFrame, path: str, exported_at: str, max_turns: int = MAX_TURNS) -> None:
    """Write one JSON record {exported_at, conv_id, messages[{role, content}]} per thread."""
    threads = export_records(turns, exported_at, max_turns)
    threads.write.mode("overwrite").json(path)


def export_records(turns: DataFrame, exported_at: str, max_turns: int = MAX_TURNS) -> DataFrame:
    threads = assemble_threads(turns, max_turns)
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return threads.select(F.lit(exported_at).alias("exported_at"), "conv_id", messages.alias("messages"))
