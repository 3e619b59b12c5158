"""Schemas of the stored tables and of the records that commands exchange, and the fixed limits."""

from pyspark.sql import types as T

# Limits of the data model.
CONTEXT = 700
SOFT_PERCENT = 85
SAFETY_TOKENS = 4
EMPTY_TOKENS = 10
MAX_SEGMENTS = 100
TOP_K = 3
CANDIDATE_TOP_K = 25
MAX_ONESHOT_MEMORIES = 100_000
MAX_ID_BYTES = 4_096
MAX_TEXT_BYTES = 4 * 1024 * 1024
MAX_BODY_BYTES = 100 * 1024 * 1024
MAX_SESSION_RECORDS = 1_000_000
CHUNK_LINES = 30
BLANK_WINDOW = 10
K_VALUES = (1, 3, 5, 10, 30, 50)
RERANK_PASSES = 2


def soft_limit(context: int) -> int:
    return max(context * SOFT_PERCENT // 100, 1)


SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("system_text", T.StringType()), T.StructField("system_locked", T.BooleanType()),
    T.StructField("kv_persist", T.BooleanType()), T.StructField("next_memory_idx", T.LongType()), T.StructField("boundaries", T.ArrayType(T.LongType())),
])
MEMORIES = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("memory_idx", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("estimated_tokens", T.IntegerType()),
])
MANIFEST = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("segment_id", T.IntegerType()), T.StructField("first_idx", T.LongType()),
    T.StructField("last_idx_excl", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("token_count", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("created_ms", T.LongType()), T.StructField("last_access_ms", T.LongType()),
])
ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("details", T.MapType(T.StringType(), T.StringType()))])
SCORER_KEY = T.StructType([T.StructField(k, T.StringType()) for k in ("value", "vendor", "description", "name", "backend", "template", "type_k", "type_v")])
AGENT_EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("subtype", T.StringType()), T.StructField("parent_tool_use_id", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("id", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("input", T.MapType(T.StringType(), T.StringType()))]))),
        T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
    ])),
])
