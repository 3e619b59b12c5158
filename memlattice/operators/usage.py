"""Token and tool accounting over logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts of a usage record and their other names.
PARTS = {"input_tokens": ("input_tokens", "prompt_tokens"), "output_tokens": ("output_tokens", "completion_tokens"), "cache_creation_input_tokens": ("cache_creation_input_tokens",), "cache_read_input_tokens": ("cache_read_input_tokens",)}


_KEYS = (*PARTS, "prompt_tokens", "completion_tokens", "total_tokens")


def _usages(value) -> Iterator[dict]:
    """Every object under a key `usage`, at any depth."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("usage"), dict):
                yield x["usage"]
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def nested(body: Column) -> Column:
    """The usage records anywhere in a JSON text, as array<struct> of their numbers, the other names standing in for missing parts. Arrow-batched Python: SQL has no recursion into objects."""

    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [_numbers(u) for u in _usages(_parsed(b))])

    return F.pandas_udf(run, "array<struct<" + ",".join(f"{k}:bigint" for k in _KEYS) + ">>")(body)


def _parsed(body: str | None):
    try:
        return json.loads(body) if body else None
    except ValueError:
        return None


def _numbers(usage: dict) -> dict:
    out = {k: int(v) for k in _KEYS if isinstance(v := usage.get(k), int | float) and not isinstance(v, bool)}
    for part, names in PARTS.items():
        out.setdefault(part, next((out[n] for n in names if n in out), None))
    return {k: out.get(k) for k in _KEYS}


def nested_totals(events: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """(by, the sums of each number, total_reported_tokens) over all nested records; the total is that of total_tokens where any record has one, else of the four parts."""
    u = events.select(*by, F.explode(nested(F.col(body))).alias("u")).select(*by, "u.*")
    sums = u.groupBy(*by).agg(*[F.sum(k).alias(k) for k in _KEYS])
    parts = sum((F.coalesce(F.col(k), F.lit(0)) for k in PARTS), F.lit(0))
    return sums.withColumn("total_reported_tokens", F.coalesce("total_tokens", parts).cast("bigint"))


# What an agent's log calls the tools that start sub-agents.
SUBAGENT_TOOLS = ("Agent", "Task")
AGENT_EVENT = """type string, subtype string, tool_use_id string, task_id string, parent_tool_use_id string, tool_use_result struct<totalTokens:bigint>,
message struct<id:string,role:string,content:array<struct<type:string,name:string,id:string,tool_use_id:string>>,usage:map<string,bigint>>"""


def agent_tokens(events: DataFrame, by: str, seq: str, body: str = "body") -> DataFrame:
    """(by, tokens) that sub-agents used, for JSON events in order of seq.

    Sub-agents are known by the ids of started tasks, or in a log without any, by those of the top level's calls of the tools that
    start them. Messages marked with such a parent count once by (parent, message id), as they were last; results of such calls
    count what they report.
    """
    e = events.select(by, seq, F.from_json(body, AGENT_EVENT).alias("e")).select(by, seq, "e.*")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    started = e.where("type = 'system' AND subtype = 'task_started'").select(by, F.coalesce(filled("tool_use_id"), filled("task_id")).alias("id"))
    started = started.where("id IS NOT NULL").distinct()
    assistant = F.coalesce(F.col("message.role") == "assistant", F.lit(False))
    called = e.where(assistant & filled("parent_tool_use_id").isNull()).select(by, F.explode("message.content").alias("b"))
    called = called.where((F.col("b.type") == "tool_use") & F.col("b.name").isin(*SUBAGENT_TOOLS) & F.col("b.id").isNotNull()).select(by, "b.id").distinct()
    ids = started.unionByName(called.join(started.select(by).distinct(), by, "left_anti"))
    used = sum((F.coalesce(F.try_element_at("message.usage", F.lit(k)), F.lit(0)) for k in PARTS), F.lit(0))
    own = e.where(assistant & F.col("message.usage").isNotNull()).join(ids.withColumnRenamed("id", "parent_tool_use_id"), [by, "parent_tool_use_id"], "left_semi")
    last = own.groupBy(by, "parent_tool_use_id", F.col("message.id").alias("m")).agg(F.max_by(used, seq).alias("tokens"))
    results = e.select(by, seq, F.col("tool_use_result.totalTokens").alias("tokens"), F.explode(F.filter("message.content", lambda b: b["type"] == "tool_result")).alias("b"))
    results = results.select(by, seq, "tokens", F.col("b.tool_use_id").alias("id")).join(ids, [by, "id"], "left_semi").dropDuplicates([by, seq])
    both = last.select(by, "tokens").unionByName(results.select(by, "tokens"))
    every = events.select(by).distinct().join(both.groupBy(by).agg(F.sum("tokens").alias("tokens")), by, "left")
    return every.select(by, F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def normalised(usage: Column) -> Column:
    """A usage map as a struct of the four parts and the total: the one given, or the sum of the parts."""
    part = {k: F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names], F.lit(0)) for k, names in PARTS.items()}
    total = F.coalesce(F.try_element_at(usage, F.lit("total_tokens")), sum(part.values(), F.lit(0)))
    return F.struct(*[v.cast("bigint").alias(k) for k, v in part.items()], total.cast("bigint").alias("total_tokens"))


def totals(rows: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """(by, events, sum, last): count, sum, and the value of the latest event."""
    return rows.groupBy(*by).agg(F.count("*").cast("bigint").alias("events"), F.sum(value).cast("bigint").alias("total"), F.max_by(value, seq).cast("bigint").alias("last"))


def overall(samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sums of columns over all samples, and their number."""
    return samples.agg(F.count("*").cast("bigint").alias("samples"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])


def subagent_tokens(rows: DataFrame) -> DataFrame:
    """(parent, tokens): of each (parent, message) the last value counts. rows: parent, message_id, seq, tokens."""
    last = rows.groupBy("parent", "message_id").agg(F.max_by("tokens", "seq").alias("tokens"))
    return last.groupBy("parent").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def distinct_turns(rows: DataFrame) -> DataFrame:
    """(main_turns, subagent_turns): distinct message ids; messages without an id count as one."""
    ids = lambda c: F.count_distinct(F.when(c, F.col("message_id"))) + F.max(F.when(c & F.col("message_id").isNull(), 1).otherwise(0))
    return rows.agg(ids(F.col("parent").isNull()).alias("main_turns"), ids(F.col("parent").isNotNull()).alias("subagent_turns"))


def tool_counts(rows: DataFrame, name: str, user: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").cast("bigint").alias("n"), F.count_distinct(user).cast("bigint").alias("distinct_users"))


def latest_answer(rows: DataFrame, by: str) -> DataFrame:
    """(by, text): the latest answer of the top level, else the latest of all. rows: by, seq, parent, text."""
    top = F.col("parent").isNull()
    return rows.groupBy(by).agg(F.max_by("text", F.struct(top, "seq")).alias("text"))


def judged(rows: DataFrame, by: str) -> DataFrame:
    """(by, samples, total, average) of scores; a sample's score is total_score, or the sum of the map's values. 0 without samples."""
    own = F.coalesce("total_score", F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, b: a + b))
    return rows.groupBy(by).agg(F.count("*").alias("samples"), F.coalesce(F.sum(own), F.lit(0.0)).alias("total"), F.coalesce(F.avg(own), F.lit(0.0)).alias("average"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, delta, pct) of the keys that both runs have."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    delta = F.round(F.col("b") - F.col("a"), 6)
    return both.select(key, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), delta.alias("delta"), F.round(F.when(F.col("a") != 0, F.lit(100.0) * (F.col("b") - F.col("a")) / F.col("a")), 6).alias("pct"))
