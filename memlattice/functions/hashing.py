"""64-bit FNV-1a hashes of texts and of segments. Arrow-batched Python: SQL's 64-bit product overflows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Offset basis and prime.
BASIS = 1469598103934665603
PRIME = 1099511628211


def fnv1a(data: bytes, state: int = BASIS) -> int:
    for byte in data:
        state = ((state ^ byte) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return state


def fnv_hex(text: Column) -> Column:
    """The hash of a text as 16 hex digits; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")

    return F.pandas_udf(run, T.StringType())(text)


def _of_segment(system: str, indices, texts) -> str:
    raw = system.encode()
    state = fnv1a(struct.pack("<Q", len(raw)) + raw)
    for i, t in zip(indices, texts, strict=True):
        raw = t.encode()
        state = fnv1a(struct.pack("<qQ", i, len(raw)) + raw, state)
    return f"{state:016x}"


def _content_hash(system: Column, indices: Column, texts: Column) -> Column:
    def run(s: pd.Series, i: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([_of_segment(*x) for x in zip(s, i, t, strict=True)])

    return F.pandas_udf(run, T.StringType())(system, indices, texts)


def segment_hashes(members: DataFrame, system: Column | None = None) -> DataFrame:
    """(session_id, segment_id, hash): over the system text and each memory's index and text; client ids don't count."""
    folded = members.groupBy("session_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("memory_idx", "text"))).alias("m"))
    text = F.coalesce(system, F.lit("")) if system is not None else F.lit("")
    return folded.select("session_id", "segment_id", _content_hash(text, F.col("m.memory_idx"), F.col("m.text")).alias("hash"))

def segment_digests(members: DataFrame) -> DataFrame:
    """(session_id, segment_id, sha): the same content in SQL's terms, sha256 over lines of index, length and text."""
    part = F.concat_ws(":", F.col("memory_idx").cast("string"), F.octet_length("text").cast("string"), "text")
    folded = members.groupBy("session_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("memory_idx", part.alias("part")))).alias("m"))
    return folded.select("session_id", "segment_id", F.sha2(F.array_join(F.col("m.part"), "\n"), 256).alias("sha"))

__all__ = ["BASIS", "PRIME", "fnv1a", "fnv_hex", "segment_digests", "segment_hashes"]
