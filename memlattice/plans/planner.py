"""Packing of a session's memories into segments: a fold over each session in order of memory index.

The fold's state holds the open segment and the closed ones, which are copied only when another closes, so a session of n
memories costs O(n) steps. Sessions are independent: one shuffle by session_id deals them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice import schema

_SEGMENT = "struct<first_idx:bigint,last_idx:bigint,n:int,total:int,estimated_tokens:int,exact_tokens:int,manual_start:boolean,auto_split_start:boolean>"
_STATE = f"struct<closed:array<{_SEGMENT}>,last:{_SEGMENT}>"


def plan(
    memories: DataFrame, context: int = schema.CONTEXT, empty: int = schema.EMPTY_TOKENS, oneshot: bool = False, boundary: Column | None = None, most: int | None = schema.MAX_SEGMENTS
) -> DataFrame:
    """(session_id, segments) for memories (session_id, memory_idx, tokens).

    A memory opens a segment if it is the first, or at a manual boundary, or if the segment would exceed the
    soft limit: first by an estimate (its own tokens and a safety margin on top of the segment's estimate),
    and if that exceeds, by the exact count. A memory that doesn't fit a fresh segment (the soft limit, or
    for one-shot plans, which have no boundaries, the whole context) raises, and so do more than `most` segments (None: any number).
    """
    soft, fresh = schema.soft_limit(context), context if oneshot else schema.soft_limit(context)
    manual = F.lit(False) if boundary is None or oneshot else F.coalesce(boundary, F.lit(False))
    folded = memories.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("memory_idx", "tokens", manual.alias("manual")))).alias("m"))

    def step(state: Column, m: Column) -> Column:
        last, closed = state["last"], state["closed"]
        alone = m["tokens"] + empty
        estimate = last["estimated_tokens"] + F.greatest(F.lit(1), alone - empty) + schema.SAFETY_TOKENS
        exact = last["total"] + m["tokens"]
        recounted = estimate > soft
        auto = last.isNotNull() & ~m["manual"] & recounted & (exact > soft)
        fresh_one = F.struct(
            m["memory_idx"].alias("first_idx"), m["memory_idx"].alias("last_idx"), F.lit(1).alias("n"), alone.alias("total"), alone.alias("estimated_tokens"),
            alone.alias("exact_tokens"), m["manual"].alias("manual_start"), auto.alias("auto_split_start"),
        ).cast(_SEGMENT)
        grown = F.struct(
            last["first_idx"].alias("first_idx"), m["memory_idx"].alias("last_idx"), (last["n"] + 1).alias("n"), exact.alias("total"), F.when(recounted, exact).otherwise(estimate).alias("estimated_tokens"),
            F.when(recounted, exact).otherwise(F.lit(0)).alias("exact_tokens"), last["manual_start"].alias("manual_start"), last["auto_split_start"].alias("auto_split_start"),
        ).cast(_SEGMENT)
        opens = last.isNull() | m["manual"] | auto
        done = F.when(opens & last.isNotNull(), F.concat(closed, F.array(last))).otherwise(closed)
        out = F.struct(done.alias("closed"), F.when(opens, fresh_one).otherwise(grown).alias("last"))
        full = F.lit(False) if most is None else opens & (F.size(done) >= most)
        return (
            F.when(alone > fresh, F.raise_error(F.lit("memory is too large for a fresh segment")).cast(_STATE))
            .when(full, F.raise_error(F.lit("segment limit exceeded")).cast(_STATE))
            .otherwise(out)
        )

    start = F.struct(F.array().cast(f"array<{_SEGMENT}>").alias("closed"), F.lit(None).cast(_SEGMENT).alias("last")).cast(_STATE)
    whole = F.aggregate("m", start, step, lambda s: F.when(s["last"].isNull(), s["closed"]).otherwise(F.concat(s["closed"], F.array(s["last"]))))
    return folded.select("session_id", whole.alias("segments"))


def segments(planned: DataFrame) -> DataFrame:
    """A row for each segment of plan()."""
    out = planned.select("session_id", F.posexplode("segments").alias("segment_id", "s"))
    return out.select("session_id", "segment_id", "s.*")


def members(memories: DataFrame, segs: DataFrame) -> DataFrame:
    """memories with segment_id, local_idx and the segment's tokens, found by the segments' index ranges."""
    ranges = segs.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("segment_id", "first_idx", "estimated_tokens", "exact_tokens", "manual_start", "auto_split_start"))).alias("segs"))
    found = memories.join(ranges, "session_id")
    own = F.try_element_at(F.filter("segs", lambda s: s["first_idx"] <= F.col("memory_idx")), F.lit(-1))
    found = found.withColumn("s", own).drop("segs").select("*", "s.segment_id", "s.estimated_tokens", "s.exact_tokens", "s.manual_start", "s.auto_split_start").drop("s")
    return found.withColumn("local_idx", F.row_number().over(Window.partitionBy("session_id", "segment_id").orderBy("memory_idx")) - 1)


def member_rows(memories: DataFrame, **options) -> DataFrame:
    return members(memories, segments(plan(memories, **options)))
