"""Settings from a JSON file, then from arguments. Sections and keys are closed."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from memlattice import schema

# Sections and their keys.
KEYS = {
    "server": ("host", "port"), "model": ("tier", "path"), "attention": ("truncate",), "storage": ("data_dir", "cache_dir"),
    "runtime": ("backend", "n_ctx", "n_batch", "threads"), "search": ("candidate_top_k", "top_k"), "KV": ("resident_budget",),
}


@dataclass
class Settings:
    data_dir: str = "data"
    cache_dir: str = "cache"
    n_ctx: int = schema.CONTEXT
    top_k: int = 0
    candidate_top_k: int = schema.CANDIDATE_TOP_K
    resident_budget: int = 0


def parsed(text: str, **overrides) -> Settings:
    """Settings of a JSON object; an error for anything unknown or out of range. Overrides that aren't None win."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("config must be a JSON object")
    flat: dict = {}
    for section, body in found.items():
        if section not in KEYS:
            raise ValueError(f"config contains unknown field: {section}")
        for key, value in body.items():
            if key not in KEYS[section]:
                raise ValueError(f"{section} contains unknown field: {key}")
            flat[key] = value
    flat |= {k: v for k, v in overrides.items() if v is not None}
    known = {k: v for k, v in flat.items() if k in Settings.__dataclass_fields__}
    out = Settings(**known)
    if isinstance(out.resident_budget, str):
        out.resident_budget = size_of(out.resident_budget)
    if out.top_k < 0 or out.candidate_top_k < 1 or out.n_ctx < 1:
        raise ValueError("search.top_k, search.candidate_top_k or runtime.n_ctx is out of range")
    return out


def size_of(text: str) -> int:
    from pyspark.sql import functions as F

    from memlattice.functions.text import size_bytes

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    value = spark.range(1).select(size_bytes(F.lit(text)).alias("b")).first()["b"]
    if value is None:
        raise ValueError(f"invalid size: {text}")
    return int(value)
