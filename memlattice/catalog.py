"""The queries over the test tables: each applies one operator to whole tables, with the same question in SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice import schema
from memlattice.functions import hashing, text
from memlattice.operators import chunker, fusion, metrics, search, usage
from memlattice.plans import manifest, planner
from memlattice.shipping import shared_folder
from memlattice.sources import readers, requests
from memlattice.streaming import append

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SOFT = schema.soft_limit(schema.CONTEXT)
PASSAGE = "that the of and this from with"
SLICE = 600
REFINED = 200_000  # tokens of a one-shot context when whole documents are refined


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _literals(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def _sql_values(name: str, values: list[str]) -> str:
    return "(SELECT unnest([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"]) AS {name})"


# --- memories and plans ----------------------------------------------------------------------------


def memories(spark: SparkSession, sf: str) -> DataFrame:
    t = readers.table(spark, sf, "conversations")
    body = text.memory_text(F.col("role"), F.col("text"))
    return t.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("memory_idx"), body.alias("text"), text.token_estimate(body).alias("tokens"), (F.col("turn") == 4).alias("manual"))


def slices(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sessions, their texts in slices of SLICE characters as memories."""
    t = readers.table(spark, sf, "documents").where(F.length("text") > 0)
    at = F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {SLICE}").cast("int"))
    rows = t.select(F.col("doc_id").cast("string").alias("session_id"), "text", F.explode(at).alias("i"))
    rows = rows.select("session_id", F.col("i").cast("bigint").alias("memory_idx"), F.substring("text", F.col("i") * SLICE + 1, F.lit(SLICE)).alias("text"))
    return rows.withColumn("tokens", text.token_estimate(F.col("text")))


MEMORIES = """mem AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS memory_idx, role || ': ' || text AS text,
  CAST(ceil(strlen(role || ': ' || text) / 4.0) AS INTEGER) AS tokens, {manual} AS manual FROM conversations)"""
SLICES = f"""mem AS (SELECT session_id, memory_idx, text, CAST(ceil(strlen(text) / 4.0) AS INTEGER) AS tokens, false AS manual FROM (
  SELECT CAST(doc_id AS VARCHAR) AS session_id, i AS memory_idx, substring(text, CAST(i * {SLICE} + 1 AS BIGINT), {SLICE}) AS text
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {SLICE} + 1)) AS i FROM documents WHERE length(text) > 0)))"""


def plan_cte(mem: str, x: str = "") -> str:
    """mem, placed (a row for each memory) and segs, to follow WITH RECURSIVE; x: a suffix of all names but mem's own."""
    return f"""{mem},
o{x} AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY memory_idx) AS rn FROM mem{x}),
p{x} AS (
  SELECT session_id, memory_idx, rn, 0 AS seg, 0 AS loc, tokens + 10 AS est, tokens + 10 AS exact, tokens + 10 AS total, manual AS m, false AS a FROM o{x} WHERE rn = 1
  UNION ALL
  SELECT session_id, memory_idx, rn, CASE WHEN manual OR auto THEN seg + 1 ELSE seg END, CASE WHEN manual OR auto THEN 0 ELSE loc + 1 END,
    CASE WHEN manual OR auto THEN tokens + 10 WHEN guess > {SOFT} THEN total + tokens ELSE guess END,
    CASE WHEN manual OR auto THEN tokens + 10 WHEN guess > {SOFT} THEN total + tokens ELSE 0 END,
    CASE WHEN manual OR auto THEN tokens + 10 ELSE total + tokens END,
    CASE WHEN manual OR auto THEN manual ELSE m END, CASE WHEN manual OR auto THEN auto AND NOT manual ELSE a END
  FROM (SELECT o.session_id, o.memory_idx, o.rn, o.tokens, o.manual, p.seg, p.loc, p.total, p.m, p.a, p.est + greatest(1, o.tokens) + 4 AS guess,
          (p.est + greatest(1, o.tokens) + 4 > {SOFT} AND p.total + o.tokens > {SOFT}) AS auto
        FROM p{x} p JOIN o{x} o ON o.session_id = p.session_id AND o.rn = p.rn + 1)
),
placed{x} AS (SELECT p.session_id, p.memory_idx, CAST(seg AS BIGINT) AS segment_id, CAST(loc AS BIGINT) AS local_idx, mem.text, mem.tokens,
    last_value(est) OVER w AS est, last_value(exact) OVER w AS exact, last_value(total) OVER w AS total, m, a
  FROM p{x} p JOIN mem{x} mem ON p.session_id = mem.session_id AND p.memory_idx = mem.memory_idx
  WINDOW w AS (PARTITION BY p.session_id, seg ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
segs{x} AS (SELECT session_id, segment_id, min(memory_idx) AS first_idx, max(memory_idx) AS last_idx, count(*) AS n, any_value(est) AS est, any_value(exact) AS exact, any_value(total) AS total FROM placed{x} GROUP BY session_id, segment_id)"""


PLAN = "WITH RECURSIVE " + plan_cte(MEMORIES.format(manual="false"))
_PLANNED = "session_id, memory_idx, segment_id, local_idx, CAST(est AS BIGINT) AS estimated_tokens, CAST(exact AS BIGINT) AS exact_tokens"


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return planner.member_rows(memories(spark, sf))


def segs(spark: SparkSession, sf: str) -> DataFrame:
    return planner.segments(planner.plan(memories(spark, sf)))


@query("q_corpus_build", """SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS BIGINT) AS memory_idx, id, text FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, conv_id || '_' || (turn + 1) AS id, role || ': ' || text AS text FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), -1, NULL, 'session ' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations))""")
def q_corpus_build(spark, sf):
    return readers.conversation_memories(readers.table(spark, sf, "conversations"))


@query("q_sectioned_lines", """SELECT CAST(doc_id AS BIGINT) AS doc_id, doc_id || ' ' || lang AS section, CAST(i + 1 AS BIGINT) AS line_no, trim(line) AS text FROM (
  SELECT doc_id, lang, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE trim(line) <> '')
  WHERE NOT (trim(line) LIKE '[%]' AND length(trim(line)) > 2)""")
def q_sectioned_lines(spark, sf):
    d = readers.table(spark, sf, "documents")
    head = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("]"))
    lines = d.select("doc_id", F.posexplode(F.concat(F.array(head), F.split("text", "\n"))).alias("pos", "line"))
    return readers.sectioned(lines, ["doc_id"])


_IDS = """(SELECT source AS raw FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+://([^/]*).*$', '\\1') FROM pages UNION ALL SELECT unnest(['.', '..', '', 'a b', 'ok_1.x-2', 'é']))"""


@query("q_valid_ids", f"SELECT raw, coalesce(regexp_full_match(raw, '[A-Za-z0-9._-]+') AND raw NOT IN ('.', '..'), false) AS ok FROM {_IDS}")
def q_valid_ids(spark, sf):
    urls = readers.table(spark, sf, "pages").select("url")
    hosts = urls.select(F.regexp_replace("url", r"^[a-z]+://([^/]*).*$", "$1").alias("raw"))
    rows = readers.table(spark, sf, "documents").select(F.col("source").alias("raw")).unionAll(urls).unionAll(hosts).unionAll(_literals(spark, "raw", [".", "..", "", "a b", "ok_1.x-2", "é"]))
    return rows.select("raw", text.valid_session_id(F.col("raw")).alias("ok"))


@query("q_sanitize", f"""SELECT raw, CASE WHEN s IN ('.', '..') THEN '' ELSE s END AS safe, regexp_replace(raw, '[^\\p{{L}}\\p{{N}}._-]', '-', 'g') AS dashed
FROM (SELECT raw, trim(regexp_replace(raw, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS s FROM (SELECT url AS raw FROM pages UNION ALL SELECT raw FROM {_sql_values("raw", ["..", ".", "__a//b__", "a_/b", "/./", "ü x"])}))""")
def q_sanitize(spark, sf):
    rows = readers.table(spark, sf, "pages").select(F.col("url").alias("raw")).unionAll(_literals(spark, "raw", ["..", ".", "__a//b__", "a_/b", "/./", "ü x"]))
    return rows.select("raw", text.storage_component(F.col("raw")).alias("safe"), text.dashed_session_id(F.col("raw")).alias("dashed"))


_BODY = """CASE event_id % 8 WHEN 0 THEN '{"query":"x","top_k":' || event_id || '}' WHEN 1 THEN '{"query":"x","top-k":1}' WHEN 2 THEN '{"query":7}'
  WHEN 3 THEN '{"query":"x","top_k":-' || (event_id + 1) || '}' WHEN 4 THEN '[1]' WHEN 5 THEN '{"query_context":"c"}' WHEN 6 THEN '{"query":"x","query_context":7}' ELSE props END"""


@query("q_parse_requests", f"""SELECT event_id, field IS NULL AS ok, CASE WHEN field IS NOT NULL THEN 'INVALID_REQUEST' END AS code, field FROM (
SELECT event_id, CASE WHEN json_type(body) <> 'OBJECT' THEN 'body'
  WHEN len([k for k in json_keys(body) if k NOT IN ('query', 'query_context', 'top_k')]) > 0 THEN [k for k in json_keys(body) if k NOT IN ('query', 'query_context', 'top_k')][1]
  WHEN json_type(body, '$.query') IS NULL THEN 'query' WHEN json_type(body, '$.query') <> 'VARCHAR' THEN 'query'
  WHEN json_type(body, '$.query_context') NOT IN ('VARCHAR', 'NULL') THEN 'query_context'
  WHEN json_type(body, '$.top_k') NOT IN ('UBIGINT', 'NULL') OR CAST(json_extract_string(body, '$.top_k') AS BIGINT) > 2147483647 THEN 'top_k' END AS field
FROM (SELECT event_id, {_BODY} AS body FROM events))""")
def q_parse_requests(spark, sf):
    rows = readers.table(spark, sf, "events").select("event_id", F.expr(_BODY).alias("body"))
    return requests.validated(rows, "search").select("event_id", "ok", "code", "field")


_MEMORY = """CASE event_id % 9 WHEN 0 THEN '{"text":"x","id":"' || event_id || '"}' WHEN 1 THEN '{"text":"x","id":null}' WHEN 2 THEN '{"id":"a"}' WHEN 3 THEN '{"text":7}' WHEN 4 THEN '{"text":"x","id":true}'
  WHEN 5 THEN '{"text":"x","kind":1}' WHEN 6 THEN '{"text":"x","id":"' || repeat('i', CAST(4000 + event_id % 200 AS INT)) || '"}' WHEN 7 THEN '[]' ELSE '{"text":null}' END"""


@query("q_parse_add_memory", f"""SELECT event_id, field IS NULL AS ok, CASE WHEN field IS NOT NULL THEN 'INVALID_REQUEST' END AS code, field FROM (
SELECT event_id, CASE WHEN json_type(body) <> 'OBJECT' THEN 'body' WHEN len([k for k in json_keys(body) if k NOT IN ('id', 'text')]) > 0 THEN [k for k in json_keys(body) if k NOT IN ('id', 'text')][1]
  WHEN json_type(body, '$.text') IS NULL OR json_type(body, '$.text') <> 'VARCHAR' THEN 'text' WHEN json_type(body, '$.id') NOT IN ('VARCHAR', 'NULL') THEN 'id'
  WHEN strlen(json_extract_string(body, '$.id')) > 4096 THEN 'id' END AS field FROM (SELECT event_id, {_MEMORY} AS body FROM events))""")
def q_parse_add_memory(spark, sf):
    rows = readers.table(spark, sf, "events").select("event_id", F.expr(_MEMORY).alias("body"))
    return requests.validated(rows, "add-memory").select("event_id", "ok", "code", "field")


@query("q_byte_limits", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) <= 4096 AS within, length(text) <= 4096 AS within_chars FROM documents")
def q_byte_limits(spark, sf):
    d = readers.table(spark, sf, "documents")
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), text.within_bytes(F.col("text"), schema.MAX_ID_BYTES).alias("within"), (F.length("text") <= schema.MAX_ID_BYTES).alias("within_chars"))


@query("q_segment_plan", PLAN + f" SELECT {_PLANNED} FROM placed")
def q_segment_plan(spark, sf):
    return placed(spark, sf).select("session_id", *_long("memory_idx", "segment_id", "local_idx", "estimated_tokens", "exact_tokens"))


@query("q_segment_plan_manual", "WITH RECURSIVE " + plan_cte(MEMORIES.format(manual="turn = 4")) + f" SELECT {_PLANNED}, m AS manual_start, a AS auto_split_start FROM placed")
def q_segment_plan_manual(spark, sf):
    rows = planner.member_rows(memories(spark, sf), boundary=F.col("manual"))
    return rows.select("session_id", *_long("memory_idx", "segment_id", "local_idx", "estimated_tokens", "exact_tokens"), "manual_start", "auto_split_start")


@query("q_segment_plan_oneshot", "WITH RECURSIVE " + plan_cte(SLICES) + f" SELECT {_PLANNED} FROM placed")
def q_segment_plan_oneshot(spark, sf):
    rows = planner.member_rows(slices(spark, sf), oneshot=True)
    return rows.select("session_id", *_long("memory_idx", "segment_id", "local_idx", "estimated_tokens", "exact_tokens"))


@query("q_segment_summary", PLAN + """ SELECT session_id, CAST(sum(n) AS BIGINT) AS memory_count, count(*) AS segment_count, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(greatest(700 - max_by(t, segment_id), 0) AS BIGINT) AS remaining_tokens
FROM (SELECT *, CASE WHEN exact > 0 THEN exact ELSE est END AS t FROM segs) GROUP BY session_id""")
def q_segment_summary(spark, sf):
    s = segs(spark, sf).withColumn("tokens", F.when(F.col("exact_tokens") > 0, F.col("exact_tokens")).otherwise(F.col("estimated_tokens")))
    return manifest.summary(s, schema.CONTEXT)


@query("q_validate_store", """SELECT DISTINCT session_id, error FROM (
  SELECT session_id, 'duplicate memory index' AS error FROM (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR), turn FROM conversations WHERE conv_id % 5 = 0 AND turn = 0) GROUP BY session_id, turn HAVING count(*) > 1
  UNION ALL SELECT CAST(conv_id AS VARCHAR), 'invalid memory index' FROM conversations GROUP BY conv_id HAVING max(turn) >= CASE WHEN conv_id % 7 = 0 THEN max(turn) ELSE max(turn) + 1 END
  UNION ALL SELECT CAST(conv_id AS VARCHAR), 'invalid manual segment boundary' FROM conversations GROUP BY conv_id HAVING conv_id % 3 = 0 AND 4 > CASE WHEN conv_id % 7 = 0 THEN max(turn) ELSE max(turn) + 1 END)""")
def q_validate_store(spark, sf):
    c = readers.table(spark, sf, "conversations")
    rows = c.select("conv_id", F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("memory_idx"))
    twice = rows.unionAll(rows.where("conv_id % 5 = 0 AND memory_idx = 0")).select("session_id", "memory_idx")
    s = rows.groupBy("conv_id", "session_id").agg(F.max("memory_idx").alias("top"))
    s = s.select("session_id", F.when(F.expr("conv_id % 7 = 0"), F.col("top")).otherwise(F.col("top") + 1).alias("next_memory_idx"), F.when(F.expr("conv_id % 3 = 0"), F.array(F.lit(4).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("boundaries"))
    return manifest.invalid_stores(s, twice)


@query("q_segment_hash")
def q_segment_hash(spark, sf):
    return hashing.segment_hashes(placed(spark, sf)).select("session_id", *_long("segment_id"), "hash")


_SHA = "sha256(string_agg(memory_idx || ':' || strlen(text) || ':' || text, chr(10) ORDER BY memory_idx))"


@query("q_segment_sha", PLAN + f" SELECT session_id, segment_id, {_SHA} AS sha FROM placed GROUP BY session_id, segment_id")
def q_segment_sha(spark, sf):
    return hashing.segment_digests(placed(spark, sf)).select("session_id", *_long("segment_id"), "sha")


@query("q_short_ids", "SELECT doc_id, substring(sha1(text), 1, 10) AS short, substring(sha1(source || ':' || 1 || ':' || n_chars), 1, 12) AS chunk FROM documents")
def q_short_ids(spark, sf):
    return readers.table(spark, sf, "documents").select("doc_id", text.short_sha(F.col("text"), 10).alias("short"), text.chunk_id(F.col("source"), F.lit(1), F.col("n_chars")).alias("chunk"))


# --- manifests and status --------------------------------------------------------------------------

_N = "CAST(session_id AS BIGINT) * 7 + segment_id"


def _entries(spark, sf):
    """A manifest derived from the plan: some entries missing, some with another hash, some without their file."""
    d = hashing.segment_digests(placed(spark, sf)).withColumn("k", F.expr(_N))
    return d.where("k % 5 <> 0").select("session_id", "segment_id", F.when(F.expr("k % 3 = 0"), F.lit("stale")).otherwise(F.col("sha")).alias("hash"), (F.expr("k % 4 <> 1")).alias("on_disk"))


def _hashed(spark, sf):
    return hashing.segment_digests(placed(spark, sf)).select("session_id", "segment_id", F.col("sha").alias("hash"), (F.expr(_N) % 11 == 0).alias("resident"))


_STATED = PLAN + f""", h AS (SELECT session_id, segment_id, {_SHA} AS hash, ({_N}) AS k FROM placed GROUP BY session_id, segment_id),
e AS (SELECT session_id, segment_id, CASE WHEN k % 3 = 0 THEN 'stale' ELSE hash END AS hash, k % 4 <> 1 AS on_disk FROM h WHERE k % 5 <> 0)"""


@query("q_manifest_coverage", PLAN + f""", s AS (SELECT session_id, segment_id, ({_N}) AS k FROM segs),
m AS (SELECT session_id, segment_id FROM s WHERE k % 5 <> 0 UNION ALL SELECT session_id, segment_id FROM s WHERE k % 6 = 1 UNION ALL SELECT session_id, 99 FROM s WHERE k % 13 = 2),
c AS (SELECT coalesce(s.session_id, g.session_id) AS session_id, s.segment_id AS planned, g.copies FROM s FULL JOIN (SELECT session_id, segment_id, count(*) AS copies FROM m GROUP BY ALL) g ON s.session_id = g.session_id AND s.segment_id = g.segment_id),
r AS (SELECT session_id, CASE WHEN bool_or(copies > 1) THEN 'duplicate segment' WHEN bool_or(copies IS NULL) THEN 'missing segment' WHEN bool_or(planned IS NULL) THEN 'extra segment' ELSE '' END AS reason FROM c GROUP BY session_id)
SELECT session_id, reason = '' AS ok, reason FROM r""")
def q_manifest_coverage(spark, sf):
    s = segs(spark, sf).select("session_id", "segment_id").withColumn("k", F.expr(_N))
    key = ["session_id", "segment_id"]
    m = s.where("k % 5 <> 0").select(*key).unionAll(s.where("k % 6 = 1").select(*key)).unionAll(s.where("k % 13 = 2").select("session_id", F.lit(99).alias("segment_id")))
    return manifest.coverage(s.select(*key), m)


@query("q_reconcile_manifest", _STATED + """ SELECT h.session_id, h.segment_id, CASE WHEN h.k % 11 = 0 THEN 'RESIDENT' WHEN e.hash = h.hash AND e.on_disk THEN 'DISK_ONLY' ELSE 'MISSING' END AS state
FROM h LEFT JOIN e ON h.session_id = e.session_id AND h.segment_id = e.segment_id""")
def q_reconcile_manifest(spark, sf):
    return manifest.reconciled(_hashed(spark, sf), _entries(spark, sf)).select("session_id", *_long("segment_id"), "state")


@query("q_plan_restore", PLAN + """, s AS (SELECT session_id, CAST(session_id AS BIGINT) % 7 AS k, count(*) AS segments, CAST(sum(n) AS BIGINT) AS memories, CAST(max_by(n, segment_id) AS BIGINT) AS last_n FROM segs GROUP BY session_id)
SELECT session_id, CASE WHEN k = 6 OR (k = 1 AND segments = 1) THEN 'manifest has no segments' WHEN k = 1 THEN 'partial manifest coverage: covered=' || (memories - last_n) || '/' || memories
  WHEN k = 2 THEN 'segment content hash mismatch: segment=0' WHEN k = 3 THEN 'segment exceeds context limit: segment=0' WHEN k = 4 THEN 'invalid segment range: segment=0' WHEN k = 5 THEN 'segment memory coverage is invalid: segment=0' END AS reason FROM s""")
def q_plan_restore(spark, sf):
    """Manifests of every plan, each seventh session's spoilt in another way."""
    p = placed(spark, sf)
    k, at0 = F.expr("cast(session_id as bigint) % 7"), F.col("segment_id") == 0
    s = segs(spark, sf).join(hashing.segment_digests(p), ["session_id", "segment_id"])
    last = F.max("segment_id").over(Window.partitionBy("session_id"))
    s = s.withColumn("last", last).where((k != 6) & ~((k == 1) & (F.col("segment_id") == F.col("last"))))
    end = F.when((k == 4) & at0, F.col("first_idx")).when((k == 5) & at0, F.col("last_idx") + 101).otherwise(F.col("last_idx") + 1)
    entries = s.select(
        "session_id", "segment_id", "first_idx", end.alias("last_idx_excl"), F.when((k == 2) & at0, F.lit("stale")).otherwise(F.col("sha")).alias("hash"),
        F.when((k == 3) & at0, F.lit(schema.CONTEXT + 1)).otherwise(F.col("total")).alias("token_count"),
    )
    m = memories(spark, sf)
    digest = lambda rows: hashing.segment_digests(rows).withColumnRenamed("sha", "hash")
    return manifest.restored(m.select("session_id").distinct(), m, entries, digest, schema.CONTEXT)


@query("q_status_unplanned", PLAN + f""", s AS (SELECT *, ({_N}) AS k, CASE WHEN exact > 0 THEN exact ELSE est END AS t FROM segs), m AS (SELECT * FROM s WHERE CAST(session_id AS BIGINT) % 5 <> 0),
e AS (SELECT session_id, count(*) AS n, count(*) FILTER (k % 2 = 0) AS saved, sum(t) AS total FROM m GROUP BY session_id), r AS (SELECT session_id, count(*) AS n FROM s WHERE k % 3 = 0 GROUP BY session_id),
j AS (SELECT c.session_id, c.n AS memory_count, coalesce(e.n, 0) AS segment_count, coalesce(r.n, 0) AS resident_segments, coalesce(e.saved, 0) AS saved_segments, CAST(coalesce(e.total, 0) AS BIGINT) AS total_tokens
  FROM (SELECT session_id, count(*) AS n FROM mem GROUP BY session_id) c LEFT JOIN e USING (session_id) LEFT JOIN r USING (session_id))
SELECT *, greatest(resident_segments, saved_segments) AS indexed_segments, segment_count > 0 AND greatest(resident_segments, saved_segments) = segment_count AS indexed, segment_count > 0 AND saved_segments = segment_count AS disk_cached FROM j""")
def q_status_unplanned(spark, sf):
    m = memories(spark, sf)
    s = segs(spark, sf).withColumn("k", F.expr(_N))
    tokens = F.when(F.col("exact_tokens") > 0, F.col("exact_tokens")).otherwise(F.col("estimated_tokens"))
    entries = s.where("cast(session_id as bigint) % 5 <> 0").select("session_id", "segment_id", tokens.alias("token_count"), F.expr("k % 2 = 0").alias("on_disk"))
    return manifest.status_unplanned(m.select("session_id").distinct(), m, entries, s.where("k % 3 = 0").select("session_id", "segment_id"))


@query("q_index_delta", _STATED + " SELECT session_id, segment_id FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = h.session_id AND e.segment_id = h.segment_id AND e.hash = h.hash AND e.on_disk)")
def q_index_delta(spark, sf):
    return manifest.to_build(_hashed(spark, sf), _entries(spark, sf)).select("session_id", *_long("segment_id"))


@query("q_session_status", PLAN + f""", s AS (SELECT *, ({_N}) % 3 = 0 AS resident, ({_N}) % 2 = 0 AS on_disk FROM segs)
SELECT session_id, CAST(sum(n) AS BIGINT) AS memory_count, count(*) AS segment_count, count(*) FILTER (resident) AS resident_segments, count(*) FILTER (resident OR on_disk) AS indexed_segments,
  count(*) FILTER (on_disk) AS saved_segments, CAST(sum(CASE WHEN exact > 0 THEN exact ELSE est END) AS BIGINT) AS total_tokens, bool_and(resident OR on_disk) AS indexed, bool_and(on_disk) AS disk_cached, bool_or(resident) AS has_resident
FROM s GROUP BY session_id""")
def q_session_status(spark, sf):
    s = segs(spark, sf).withColumn("resident", F.expr(f"({_N}) % 3 = 0")).withColumn("on_disk", F.expr(f"({_N}) % 2 = 0"))
    return manifest.status(s, memories(spark, sf))


@query("q_lru_keep", PLAN + f""", e AS (SELECT session_id, segment_id, CAST(est AS BIGINT) AS bytes, (({_N}) * 7919) % 10007 AS used, segment_id = 0 AND CAST(session_id AS BIGINT) % 10 = 3 AS safe FROM segs)
SELECT session_id, segment_id, safe OR sum(bytes) OVER (PARTITION BY CAST(session_id AS BIGINT) % 16 ORDER BY CASE WHEN safe THEN 0 ELSE 1 END, used DESC, session_id DESC, segment_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 3000 AS kept FROM e""")
def q_lru_keep(spark, sf):
    """Sixteen stores with a budget of 3000 bytes each."""
    e = segs(spark, sf).select("session_id", "segment_id", F.col("estimated_tokens").cast("bigint").alias("bytes"), F.expr(f"(({_N}) * 7919) % 10007").alias("last_access"))
    e = e.withColumn("store", F.expr("cast(session_id as bigint) % 16"))
    safe = F.expr("segment_id = 0 AND cast(session_id as bigint) % 10 = 3")
    return manifest.kept_within(e, 3000, safe, ["store"]).select("session_id", *_long("segment_id"), "kept")


# --- search ------------------------------------------------------------------------------------------


def bm25_cte(rows: str, asked: str = "qs", x: str = "") -> str:
    """sc: scores of asked (query_id, query) over rows (session_id, segment_id, memory_idx, text); x: a suffix of all names."""
    return f"""tok{x} AS (SELECT session_id, segment_id, memory_idx, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {rows}),
sz{x} AS (SELECT session_id, segment_id, count(*) AS n, avg(len(t)) AS mean FROM tok{x} GROUP BY ALL),
post{x} AS (SELECT session_id, segment_id, memory_idx, len, term, count(*) AS tf FROM (SELECT session_id, segment_id, memory_idx, len(t) AS len, unnest(t) AS term FROM tok{x}) GROUP BY ALL),
dfs{x} AS (SELECT session_id, segment_id, term, count(*) AS df FROM post{x} GROUP BY ALL),
qt{x} AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {asked})),
sc{x} AS (SELECT query_id, session_id, segment_id, memory_idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM post{x} JOIN qt{x} USING (term) JOIN dfs{x} USING (session_id, segment_id, term) JOIN sz{x} USING (session_id, segment_id) GROUP BY ALL)"""


def top_cte(x: str = "") -> str:
    """res: the three best of each segment, merged by segment."""
    return f"""top{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id, session_id, segment_id ORDER BY score DESC, memory_idx) AS sr FROM sc{x}),
res{x} AS (SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id, session_id ORDER BY segment_id, sr) AS rank, memory_idx, segment_id FROM top{x} WHERE sr <= 3)"""


TOP = top_cte()
_BENCH = "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_FOUND = "SELECT query_id, session_id, rank, memory_idx, segment_id, text FROM res JOIN placed USING (session_id, memory_idx, segment_id)"


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return readers.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("q_search_bm25", PLAN + f", qs AS (SELECT CAST(0 AS BIGINT) AS query_id, '{PASSAGE}' AS query), {bm25_cte('placed')}, {TOP} {_FOUND}")
def q_search_bm25(spark, sf):
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(PASSAGE).alias("query"))
    out = search.search(asked, placed(spark, sf), schema.TOP_K)
    return out.select("query_id", "session_id", "rank", *_long("memory_idx", "segment_id"), "text")


@query("q_index_search", PLAN + f", qs AS (SELECT CAST(0 AS BIGINT) AS query_id, '{PASSAGE}' AS query), {bm25_cte('placed')}, {TOP} {_FOUND}")
def q_index_search(spark, sf):
    """The same search over postings that were written before."""
    members = placed(spark, sf)
    index = _materialise(spark)(search.postings(members))
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(PASSAGE).alias("query"))
    return search.search_index(asked, index, members, schema.TOP_K).select("query_id", "session_id", "rank", *_long("memory_idx", "segment_id"), "text")


@query("q_search_batch", PLAN + f", {_BENCH}, {bm25_cte('placed')}, {TOP} {_FOUND}")
def q_search_batch(spark, sf):
    out = search.search(passages(spark, sf), placed(spark, sf), schema.TOP_K)
    return out.select("query_id", "session_id", "rank", *_long("memory_idx", "segment_id"), "text")


@query("q_search_attention", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
l AS (SELECT query_id, label, vec_id, list_sum([CAST(a[1] AS DOUBLE) * CAST(a[2] AS DOUBLE) for a in list_zip(q, embedding)]) / sqrt(64.0) AS logit FROM q CROSS JOIN embeddings),
w AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY query_id, label)) AS e FROM l),
f AS (SELECT query_id, label, vec_id, round(e / sum(e) OVER (PARTITION BY query_id, label), 6) AS weight FROM w)
SELECT query_id, CAST(label AS BIGINT) AS segment_id, row_number() OVER (PARTITION BY query_id, label ORDER BY weight DESC, vec_id) AS rank, vec_id, weight FROM f""")
def q_search_attention(spark, sf):
    """Every vector whose id is divisible by 50, against all."""
    e = readers.table(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = search.attention(asked, e.select(F.col("label").alias("segment_id"), "vec_id", F.col("embedding").alias("v")))
    return search.ranked(out, ["query_id", "segment_id"], "weight", "vec_id", "rank").select("query_id", *_long("segment_id"), "rank", "vec_id", "weight")


def by_lang(spark, sf):
    d = readers.table(spark, sf, "documents").select(F.lit("all").alias("session_id"), F.col("lang").alias("segment_id"), F.col("doc_id").alias("memory_idx"), "text")
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(PASSAGE).alias("query"))
    return search.ranked(search.bm25(asked, d), ["query_id", "segment_id"])


_LANG = f"""WITH qs AS (SELECT 0 AS query_id, '{PASSAGE}' AS query), rows_ AS (SELECT 'all' AS session_id, lang AS segment_id, doc_id AS memory_idx, text FROM documents), {bm25_cte('rows_')}
SELECT segment_id AS lang, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, memory_idx) AS rank, memory_idx AS doc_id, score FROM sc"""


@query("q_topk_per_segment", _LANG + " QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, memory_idx) <= 3")
def q_topk_per_segment(spark, sf):
    return search.limited(by_lang(spark, sf), schema.TOP_K).select(F.col("segment_id").alias("lang"), F.col("seg_rank").alias("rank"), F.col("memory_idx").alias("doc_id"), "score")


@query("q_topk_unlimited", _LANG)
def q_topk_unlimited(spark, sf):
    return search.limited(by_lang(spark, sf), 0).select(F.col("segment_id").alias("lang"), F.col("seg_rank").alias("rank"), F.col("memory_idx").alias("doc_id"), "score")


@query("q_merge_dedup", """WITH m AS (SELECT doc_id % 8 AS segment_id, doc_id AS seg_rank, min(doc_id) OVER (PARTITION BY text) AS memory_idx FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY memory_idx ORDER BY segment_id, seg_rank) AS k FROM m)
SELECT row_number() OVER (ORDER BY segment_id, seg_rank) AS rank, memory_idx, segment_id FROM f WHERE k = 1""")
def q_merge_dedup(spark, sf):
    """Equal texts are one memory that several segments rank. One result list, so one order."""
    d = readers.table(spark, sf, "documents")
    first = d.groupBy(F.xxhash64("text").alias("h"), F.sha1("text").alias("s")).agg(F.min("doc_id").alias("memory_idx"))
    rows = d.select(F.xxhash64("text").alias("h"), F.sha1("text").alias("s"), "doc_id").join(first, ["h", "s"])
    rows = rows.select(F.lit(0).alias("query_id"), (F.col("doc_id") % 8).alias("segment_id"), F.col("doc_id").alias("seg_rank"), "memory_idx")
    return search.merged(rows, ["query_id"], large=True).select("rank", *_long("memory_idx", "segment_id"))


_HITS = PLAN + f", {_BENCH}, {bm25_cte('placed')}, {TOP}"


@query("q_oneshot", f"""{_HITS}, hit AS (SELECT DISTINCT session_id, memory_idx FROM res),
one AS (SELECT 0 AS query_id, '{PASSAGE}' AS query),
{plan_cte("mem2 AS (SELECT session_id, memory_idx, text, tokens, false AS manual FROM mem JOIN hit USING (session_id, memory_idx))", "2")},
{bm25_cte("placed2", "one", "2")}, {top_cte("2")}
SELECT session_id, rank, memory_idx, segment_id, text FROM res2 JOIN placed2 USING (session_id, segment_id, memory_idx)""")
def q_oneshot(spark, sf):
    """The hits of the batch search, planned anew by the whole context and asked another query."""
    rows = memories(spark, sf)
    hits = search.search(passages(spark, sf), placed(spark, sf), schema.TOP_K).select("session_id", "memory_idx").distinct()
    own = planner.member_rows(rows.join(hits, ["session_id", "memory_idx"], "left_semi"), oneshot=True)
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(PASSAGE).alias("query"))
    return search.search(asked, own, schema.TOP_K).select("session_id", "rank", *_long("memory_idx", "segment_id"), "text")


@query("q_rebuild_context", _HITS + """, hit AS (SELECT DISTINCT session_id, memory_idx FROM res),
both_ AS (SELECT session_id, memory_idx, session_id || '_' || (memory_idx + 1) AS id, text FROM mem JOIN hit USING (session_id, memory_idx) UNION ALL SELECT DISTINCT session_id, -1, NULL, 'session ' || session_id FROM hit)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY memory_idx) AS pos, id, text FROM both_""")
def q_rebuild_context(spark, sf):
    hits = search.search(passages(spark, sf), placed(spark, sf), schema.TOP_K)
    rows = memories(spark, sf).withColumn("id", text.corpus_id(F.col("session_id"), F.col("memory_idx") + 1, F.lit(True)))
    return search.rebuilt(hits, rows)




@query("q_merge_rerank", """WITH b AS (SELECT lang AS query_id, doc_id, n_chars, (doc_id * 7919) % 10007 AS h FROM documents),
f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY h, doc_id) AS rank FROM b WHERE h % 3 = 0),
s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rank FROM b),
u AS (SELECT query_id, doc_id, 0 AS t, rank FROM f UNION ALL SELECT query_id, doc_id, 1, rank FROM s ANTI JOIN f USING (query_id, doc_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY t, rank) AS rank, doc_id FROM u""")
def q_merge_rerank(spark, sf):
    d = readers.table(spark, sf, "documents")
    w = Window.partitionBy("query_id")
    base = d.select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.expr("(doc_id * 7919) % 10007").alias("h"))
    first = base.where("h % 3 = 0").select("query_id", "doc_id", F.row_number().over(w.orderBy("h", "doc_id")).alias("rank"))
    second = base.select("query_id", "doc_id", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return search.union_in_order(first, second, ["query_id"], "doc_id")


def _materialise(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a pass to the folder that executors share, spark.checkpoint.dir, or where that is unset to one of our own."""
    root = shared_folder(spark)

    def write(df: DataFrame) -> DataFrame:
        path = f"{root}/pass-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


@query("q_refine")
def q_refine(spark, sf):
    items = readers.table(spark, sf, "documents").select(F.col("doc_id").alias("memory_idx"), F.col("source").alias("group"), "text")
    out = search.refine(passages(spark, sf), items, keep=3, passes=schema.RERANK_PASSES, segment_size=200, materialise=_materialise(spark), context=REFINED)
    return out.select("query_id", "rank", F.col("memory_idx").alias("doc_id"), "passes")


def ranking(spark, sf):
    """Documents for each passage, by BM25 within their language, then by score."""
    d = readers.table(spark, sf, "documents").select(F.lit("all").alias("session_id"), F.col("lang").alias("segment_id"), F.col("doc_id").alias("memory_idx"), "text")
    scored = search.bm25(passages(spark, sf), d)
    return search.ranked(scored, ["query_id"], rank="rank").select("query_id", "rank", F.col("memory_idx").alias("doc_id"), F.col("segment_id").alias("lang"))


def gold(spark, sf):
    """(query_id, doc_id): documents that hold a passage verbatim.

    Candidates share the passage's second to fourth word, which stand whole in a text that holds it. Passages of under five
    words have no such words; they are a query set that is asked of every row.
    """
    d = readers.table(spark, sf, "documents").select("doc_id", "text").withColumn("t", F.split("text", r"\s+"))
    w = F.split("query", r"\s+")
    asked = passages(spark, sf).withColumn("g", F.when(F.size(w) >= 5, F.xxhash64(F.get(w, F.lit(1)), F.get(w, F.lit(2)), F.get(w, F.lit(3)))))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("t", i), F.get("t", i + 1), F.get("t", i + 2)))
    long = d.select("doc_id", "text", F.explode(F.array_distinct(grams)).alias("g")).join(search.told(asked.where("g is not null")), "g")
    found = long.where(F.contains("text", "query")).select("query_id", "doc_id")
    short = asked.where("g is null").select("query_id", "query")
    if not short.isEmpty():
        found = found.unionByName(d.join(search.told(short), F.contains("text", "query")).select("query_id", "doc_id"))
    return found.distinct()


_RANKING = f"""WITH {_BENCH}, rows_ AS (SELECT 'all' AS session_id, lang AS segment_id, doc_id AS memory_idx, text FROM documents), {bm25_cte('rows_')},
ranking AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_idx) AS rank, memory_idx AS doc_id, segment_id AS lang FROM sc),
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ks AS (SELECT item_id AS query_id, unnest([1, 3, 5, 10, 30, 50]) AS k FROM benchmark),
hit AS (SELECT r.query_id, r.rank FROM ranking r JOIN gold USING (query_id, doc_id)),
gs AS (SELECT query_id, count(*) AS g FROM gold GROUP BY query_id),
at_k AS (SELECT ks.query_id, CAST(ks.k AS BIGINT) AS k, coalesce(any_value(gs.g), 0) AS g, count(hit.rank) AS h,
  coalesce(sum(CASE WHEN hit.rank = 1 THEN 1.0 ELSE 1 / log2(hit.rank) END), 0) AS a, coalesce(sum(1 / log2(hit.rank + 1)), 0) AS b
  FROM ks LEFT JOIN gs USING (query_id) LEFT JOIN hit ON hit.query_id = ks.query_id AND hit.rank <= ks.k GROUP BY ks.query_id, ks.k)"""
_IDEAL_A = "list_sum([CASE WHEN i = 1 THEN 1.0 ELSE 1 / log2(i) END for i in range(1, least(g, k) + 1)])"
_IDEAL_B = "list_sum([1 / log2(i + 1) for i in range(1, least(g, k) + 1)])"


@query("q_recall", _RANKING + " SELECT query_id, k, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_any, CASE WHEN g > 0 AND h = g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_all FROM at_k")
def q_recall(spark, sf):
    return metrics.recall(passages(spark, sf), ranking(spark, sf), gold(spark, sf), "doc_id")


@query("q_ndcg_a", _RANKING + f" SELECT query_id, k, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(CAST(a / {_IDEAL_A} AS DOUBLE), 6) END AS ndcg FROM at_k")
def q_ndcg_a(spark, sf):
    return metrics.ndcg(passages(spark, sf), ranking(spark, sf), gold(spark, sf), "doc_id", "a")


@query("q_ndcg_b", _RANKING + f" SELECT query_id, k, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(CAST(b / {_IDEAL_B} AS DOUBLE), 6) END AS ndcg FROM at_k")
def q_ndcg_b(spark, sf):
    return metrics.ndcg(passages(spark, sf), ranking(spark, sf), gold(spark, sf), "doc_id", "b")


@query("q_eval_macro", _RANKING + f""" , per AS (SELECT query_id, k, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(CAST(b / {_IDEAL_B} AS DOUBLE), 6) END AS ndcg FROM at_k),
lead_ AS (SELECT query_id, lang FROM ranking WHERE rank = 1)
SELECT lang, k, round(avg(ndcg), 6) AS mean FROM per JOIN lead_ USING (query_id) GROUP BY lang, k""")
def q_eval_macro(spark, sf):
    """Mean by k over the queries whose best document is in a language."""
    r = ranking(spark, sf)
    per = metrics.ndcg(passages(spark, sf), r, gold(spark, sf), "doc_id", "b")
    return metrics.macro(per.join(r.where("rank = 1").select("query_id", "lang"), "query_id"), "lang", "ndcg").select("lang", "k", "mean")


@query("q_session_rank", _RANKING + """, f AS (SELECT query_id, source, min(rank) AS first FROM ranking JOIN documents USING (doc_id) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank, source AS session_id FROM f""")
def q_session_rank(spark, sf):
    sources = readers.table(spark, sf, "documents").select("doc_id", "source")
    return metrics.parent_ranks(ranking(spark, sf).join(sources, "doc_id"), "source").select("query_id", "rank", F.col("source").alias("session_id"))


@query("q_session_eval", _RANKING + f""", f AS (SELECT query_id, source, min(rank) AS first FROM ranking JOIN documents USING (doc_id) GROUP BY ALL),
sr AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY first, source) AS rank FROM f), sg AS (SELECT DISTINCT query_id, source FROM gold JOIN documents USING (doc_id)),
sn AS (SELECT query_id, count(*) AS g FROM sg GROUP BY query_id), sh AS (SELECT query_id, sr.rank FROM sr JOIN sg USING (query_id, source)),
sk AS (SELECT ks.query_id, CAST(ks.k AS BIGINT) AS k, coalesce(any_value(sn.g), 0) AS g, count(sh.rank) AS h, coalesce(sum(CASE WHEN sh.rank = 1 THEN 1.0 ELSE 1 / log2(sh.rank) END), 0) AS a
  FROM ks LEFT JOIN sn USING (query_id) LEFT JOIN sh ON sh.query_id = ks.query_id AND sh.rank <= ks.k GROUP BY ks.query_id, ks.k)
SELECT query_id, k, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_any, CASE WHEN g > 0 AND h = g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_all,
  CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE round(CAST(a / {_IDEAL_A} AS DOUBLE), 6) END AS ndcg FROM sk""")
def q_session_eval(spark, sf):
    """Recall and gain of sessions (sources): each counts where its first document is ranked, and is right if it holds a right document."""
    sources = readers.table(spark, sf, "documents").select("doc_id", "source")
    asked = passages(spark, sf)
    order = metrics.parent_ranks(ranking(spark, sf).join(sources, "doc_id"), "source")
    right = gold(spark, sf).join(sources, "doc_id").select("query_id", "source").distinct()
    return metrics.recall(asked, order, right, "source").join(metrics.ndcg(asked, order, right, "source", "a"), ["query_id", "k"])


@query("q_full_permutation", f"""WITH qs AS (SELECT min(item_id) AS query_id, arg_min(text, item_id) AS query FROM benchmark), rows_ AS (SELECT 'all' AS session_id, 'all' AS segment_id, doc_id AS memory_idx, text FROM documents), {bm25_cte('rows_')},
r AS (SELECT memory_idx AS doc_id, row_number() OVER (ORDER BY score DESC, memory_idx) AS rank FROM sc),
u AS (SELECT doc_id, 0 AS t, rank AS p FROM r UNION ALL SELECT doc_id, 1, doc_id FROM documents ANTI JOIN r USING (doc_id))
SELECT row_number() OVER (ORDER BY t, p) AS rank, doc_id FROM u""")
def q_full_permutation(spark, sf):
    d = readers.table(spark, sf, "documents").select(F.lit("all").alias("session_id"), F.lit("all").alias("segment_id"), F.col("doc_id").alias("memory_idx"), "text")
    one = passages(spark, sf).agg(F.min(F.struct("query_id", "query")).alias("q")).select("q.*")
    r = search.ranked(search.bm25(one, d), ["query_id"], rank="rank").select(F.col("memory_idx").alias("doc_id"), "rank")
    return metrics.complete(r, d.select(F.col("memory_idx").alias("doc_id"), F.col("memory_idx").alias("pos")), "doc_id")


@query("q_p50", "SELECT event_type, list_sort(list(value))[CAST(count(value) // 2 + 1 AS BIGINT)] AS p50 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def q_p50(spark, sf):
    return metrics.upper_median(readers.table(spark, sf, "events"), "event_type", "value", "p50")


# --- chunks, fusion, ranges ----------------------------------------------------------------------------


def spaced(spark, sf):
    """Documents with a blank line after each sentence: the tables have none."""
    return readers.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


def blocks_cte(rule: str) -> str:
    """blocks (doc_id, start_line, end_line, text), to follow WITH RECURSIVE."""
    if rule == "nearest":
        best = "list_min([abs(x - want) * 1000000 + x for x in blank if x >= greatest(s, want - 10) AND x <= least(n, want + 10)]) % 1000000"
    else:
        best = "list_min([x for x in blank if x >= want AND x <= least(n, want + 10)])"
    return f"""d0 AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS l FROM documents WHERE text <> ''),
d AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS lines FROM d0),
b AS (SELECT doc_id, lines, len(lines) AS n, [i for i in range(1, len(lines) + 1) if trim(regexp_replace(lines[i], '\\s+', ' ', 'g')) = ''] AS blank FROM d),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e FROM b WHERE n > 0 UNION ALL
  SELECT doc_id, s, CASE WHEN want = n THEN n ELSE coalesce({best}, want) END FROM (SELECT r.doc_id, r.e + 1 AS s, least(r.e + 30, b.n) AS want, b.n, b.blank FROM r JOIN b USING (doc_id) WHERE r.e < b.n)),
blocks AS (SELECT * FROM (SELECT r.doc_id, s AS start_line, e AS end_line, array_to_string(lines[s:e], chr(10)) AS text FROM r JOIN b USING (doc_id) WHERE e > 0) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')"""


@query("q_line_blocks_nearest", "WITH RECURSIVE " + blocks_cte("nearest") + " SELECT doc_id, start_line, end_line FROM blocks")
def q_line_blocks_nearest(spark, sf):
    return chunker.blocks(spaced(spark, sf), "nearest").select("doc_id", "start_line", "end_line")


@query("q_line_blocks_forward", "WITH RECURSIVE " + blocks_cte("forward") + " SELECT doc_id, start_line, end_line FROM blocks")
def q_line_blocks_forward(spark, sf):
    return chunker.blocks(spaced(spark, sf), "forward").select("doc_id", "start_line", "end_line")


def block_hits(spark, sf):
    """(query_id, rank, doc_id, start_line, end_line): a passage's 20 best blocks by the number of its terms that they hold."""
    b = chunker.blocks(spaced(spark, sf), "nearest")
    terms = b.select("doc_id", "start_line", "end_line", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    asked = search.asked_terms(passages(spark, sf))
    n = terms.join(search.told(asked), "term").groupBy("query_id", "doc_id", "start_line", "end_line").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id", "start_line")
    return n.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20").drop("n")


_BLOCK_HITS = "WITH RECURSIVE " + blocks_cte("nearest") + f""", {_BENCH},
bt AS (SELECT DISTINCT doc_id, start_line, end_line, term FROM (SELECT doc_id, start_line, end_line, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM blocks)),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM qs)),
hits AS (SELECT query_id, doc_id, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id, start_line) AS rank FROM bt JOIN qt USING (term) GROUP BY query_id, doc_id, start_line, end_line QUALIFY rank <= 20)"""


def _fuse_sql(filter_: str, weight: str) -> str:
    return _BLOCK_HITS + f""", h AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM hits),
f AS (SELECT query_id, doc_id, round(sum({weight} / log2(rank + 1)), 6) AS score, min(rank) AS first FROM h WHERE {filter_} GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank, doc_id, score FROM f"""


@query("q_fuse_sum", _fuse_sql("true", "1.0::DOUBLE"))
def q_fuse_sum(spark, sf):
    return fusion.fused(block_hits(spark, sf), "sum")


@query("q_fuse_capped", _fuse_sql("nth <= 2", "(CASE WHEN nth > 1 THEN 0.25 ELSE 1.0 END)::DOUBLE"))
def q_fuse_capped(spark, sf):
    return fusion.fused(block_hits(spark, sf), "capped")


@query("q_fuse_first", _fuse_sql("nth = 1", "1.0::DOUBLE"))
def q_fuse_first(spark, sf):
    return fusion.fused(block_hits(spark, sf), "first")


_MERGED = """, i AS (SELECT *, max(end_line) OVER (PARTITION BY {by} ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT {by}, start_line, end_line FROM {rows})),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS isl FROM i),
merged AS (SELECT {by}, min(start_line) AS start_line, max(end_line) AS end_line FROM j GROUP BY {by}, isl)"""
_TEXTED = "string_agg(CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || end_line END, ',' ORDER BY start_line)"


@query("q_merge_ranges", _BLOCK_HITS + _MERGED.format(by="doc_id", rows="hits") + " SELECT doc_id, start_line, end_line FROM merged")
def q_merge_ranges(spark, sf):
    return fusion.merged_ranges(block_hits(spark, sf), ["doc_id"])


@query("q_range_text", _BLOCK_HITS + _MERGED.format(by="doc_id", rows="hits") + f" SELECT doc_id, {_TEXTED} AS ranges FROM merged GROUP BY doc_id")
def q_range_text(spark, sf):
    return fusion.ranges_as_text(fusion.merged_ranges(block_hits(spark, sf), ["doc_id"]), ["doc_id"])


@query("q_code_search", _BLOCK_HITS + ", " + _fuse_sql("nth <= 2", "(CASE WHEN nth > 1 THEN 0.25 ELSE 1.0 END)::DOUBLE").split("QUALIFY rank <= 20), ")[1].replace("SELECT query_id, row_number()", ", files AS (SELECT query_id, row_number()", 1) + ")" + _MERGED.format(by="query_id, doc_id", rows="hits").replace(", i AS", ", i AS") + f"""
SELECT f.query_id, f.rank, f.doc_id, {_TEXTED} AS ranges FROM (SELECT * FROM files WHERE rank <= 5) f JOIN merged m ON f.query_id = m.query_id AND f.doc_id = m.doc_id GROUP BY f.query_id, f.rank, f.doc_id""")
def q_code_search(spark, sf):
    """The five best documents of a passage with the lines of their hits."""
    hits = block_hits(spark, sf)
    files = fusion.fused(hits, "capped", top_k=5)
    ranges = fusion.ranges_as_text(fusion.merged_ranges(hits, ["query_id", "doc_id"]), ["query_id", "doc_id"])
    return files.join(ranges, ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", "ranges")


@query("q_chunk_locations", _BLOCK_HITS + " SELECT query_id, rank, doc_id, start_line, end_line FROM hits")
def q_chunk_locations(spark, sf):
    """Hits that carry only a chunk's id, some of an unknown one, with the lines of their chunk."""
    place = text.chunk_id(F.col("doc_id").cast("string"), F.col("start_line"), F.col("end_line")).alias("chunk_id")
    hits = block_hits(spark, sf).select("query_id", "rank", place)
    hits = hits.unionByName(hits.where("rank = 1").withColumn("chunk_id", F.concat(F.lit("gone-"), "chunk_id")))
    chunks = chunker.blocks(spaced(spark, sf), "nearest").select(place, "doc_id", "start_line", "end_line")
    return fusion.located(hits, chunks).select("query_id", "rank", "doc_id", "start_line", "end_line")


@query("q_reciprocal_score", _BLOCK_HITS + " SELECT query_id, doc_id AS id, rank, round(1.0::DOUBLE / (rank + 1), 6) AS score FROM hits WHERE doc_id IS NOT NULL")
def q_reciprocal_score(spark, sf):
    return block_hits(spark, sf).where(F.col("doc_id").isNotNull()).select("query_id", F.col("doc_id").alias("id"), "rank", F.round(fusion.reciprocal(F.col("rank")), 6).alias("score"))


# --- literals, logs --------------------------------------------------------------------------------------

MESSAGES = [
    "session not found: a", "session already exists: b", "invalid session id", "not found", "payload too large", "Content-Type must be application/json",
    "request contains unknown field: x", "text must be a string", "search requires a query", "id exceeds maximum length", "the index is invalid", "something else", "INVALID", "",
]


@query("q_classify_errors", f"""SELECT message, code, CAST(CASE WHEN code IN ('SESSION_NOT_FOUND', 'NOT_FOUND') THEN 404 WHEN code = 'SESSION_ALREADY_EXISTS' THEN 409 WHEN code = 'UNSUPPORTED_MEDIA_TYPE' THEN 415 WHEN code = 'PAYLOAD_TOO_LARGE' THEN 413 ELSE 400 END AS BIGINT) AS status FROM (
SELECT message, CASE WHEN message LIKE 'session not found: %' THEN 'SESSION_NOT_FOUND' WHEN message LIKE 'session already exists: %' THEN 'SESSION_ALREADY_EXISTS' WHEN message = 'invalid session id' THEN 'INVALID_SESSION_ID'
 WHEN message = 'not found' THEN 'NOT_FOUND' WHEN message = 'payload too large' THEN 'PAYLOAD_TOO_LARGE' WHEN message = 'Content-Type must be application/json' THEN 'UNSUPPORTED_MEDIA_TYPE'
 WHEN message LIKE '% contains unknown field: %' OR message LIKE '%must be%' OR message LIKE '%requires%' OR message LIKE '%exceeds maximum length%' OR message LIKE '%invalid%' THEN 'INVALID_REQUEST' ELSE 'BAD_REQUEST' END AS code
FROM {_sql_values("message", MESSAGES)})""")
def q_classify_errors(spark, sf):
    code = text.error_code(F.col("message"))
    return _literals(spark, "message", MESSAGES).select("message", code.alias("code"), text.http_status(code).cast("bigint").alias("status"))


SIZES = ["7", "10b", "3k", "3KB", "2KiB", "5m", "1GiB", "4tb", "x", "", "5q", "12 mb", "-1", "007", "0000000000000000000000012k"]


@query("q_parse_sizes", f"""SELECT text, CAST(CAST(num AS BIGINT) * (1024 ** CASE WHEN u IN ('', 'b') THEN 0 WHEN u[1] = 'k' THEN 1 WHEN u[1] = 'm' THEN 2 WHEN u[1] = 'g' THEN 3 ELSE 4 END) AS BIGINT) AS bytes FROM (
SELECT text, nullif(regexp_extract(text, '^([0-9]+)(b|[kmgt](i?b)?)?$', 1, 'i'), '') AS num, lower(regexp_extract(text, '^([0-9]+)(b|[kmgt](i?b)?)?$', 2, 'i')) AS u FROM {_sql_values("text", SIZES)})""")
def q_parse_sizes(spark, sf):
    return _literals(spark, "text", SIZES).select("text", text.size_bytes(F.col("text")).cast("bigint").alias("bytes"))


_STARTS, _PARTS = text.PROCEDURAL_STARTS, text.PROCEDURAL_PARTS
_QUOTED = [p.replace("'", "''") for p in (*_STARTS, *_PARTS)]
_SAID = "CASE conv_id % " + str(2 * len(_QUOTED)) + " " + " ".join(f"WHEN {i} THEN '{p.upper()}' || text WHEN {i + len(_QUOTED)} THEN 'so {p}'" for i, p in enumerate(_QUOTED)) + " END"
_TAGGED = f"CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'So <Answer> ' || text || ' </ANSWER> <answer>no</answer>' WHEN 2 THEN {_SAID} ELSE '' END"
_PROCEDURAL = " OR ".join([f"starts_with(s, '{p}')" for p in _QUOTED[: len(_STARTS)]] + [f"contains(s, '{p}')" for p in _QUOTED[len(_STARTS) :]])


@query("q_answer_extract", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?is)<answer>.*?</answer>') THEN trim(regexp_extract(t, '(?is)<answer>(.*?)</answer>', 1)) END AS answer,
 s = '' OR (length(s) <= 800 AND ({_PROCEDURAL})) AS procedural
FROM (SELECT conv_id, turn, t, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS s FROM (SELECT conv_id, turn, {_TAGGED} AS t FROM conversations))""")
def q_answer_extract(spark, sf):
    t = readers.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_TAGGED).alias("t"))
    return t.select("conv_id", "turn", text.tagged_answer(F.col("t")).alias("answer"), text.is_procedural(F.col("t")).alias("procedural"))


_TOKENS = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def usage_log(spark, sf):
    return readers.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.expr(_TOKENS).alias("tokens"))


@query("q_usage_totals", f"SELECT user_id, count(*) AS events, CAST(sum({_TOKENS}) AS BIGINT) AS total, arg_max({_TOKENS}, event_id) AS last FROM events GROUP BY user_id")
def q_usage_totals(spark, sf):
    return usage.totals(usage_log(spark, sf), ["user_id"], "tokens", "event_id")


_NESTED = f"""CASE event_id % 5 WHEN 0 THEN '{{"type":"assistant","message":{{"id":"m","usage":{{"input_tokens":' || {_TOKENS} || ',"output_tokens":3,"cache_read_input_tokens":2}}}}}}'
  WHEN 1 THEN '{{"usage":{{"prompt_tokens":' || {_TOKENS} || ',"completion_tokens":2}}}}' WHEN 2 THEN '{{"result":{{"content":[{{"usage":{{"input_tokens":1}}}},{{"usage":"none"}}]}}}}'
  WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN '{{"usage":{{"total_tokens":' || {_TOKENS} || '}}}}' ELSE '{{"usage":{{"output_tokens":5,"usage":{{"input_tokens":7}}}}}}' END ELSE '{{"text":"usage"}}' END"""


@query("q_usage_overall", f"SELECT count(*) AS samples, CAST(sum(n) AS BIGINT) AS events, CAST(sum(t) AS BIGINT) AS total FROM (SELECT user_id, count(*) AS n, sum({_TOKENS}) AS t FROM events GROUP BY user_id)")
def q_usage_overall(spark, sf):
    return usage.overall(usage.totals(usage_log(spark, sf), ["user_id"], "tokens", "event_id"), ["events", "total"])


@query("q_usage_nested", f"""WITH u AS (SELECT user_id, unnest(json_extract({_NESTED}, '$..usage')) AS u FROM events),
n AS (SELECT user_id, CAST(json_extract_string(u, '$.input_tokens') AS BIGINT) AS i, CAST(json_extract_string(u, '$.output_tokens') AS BIGINT) AS o, CAST(json_extract_string(u, '$.prompt_tokens') AS BIGINT) AS p,
  CAST(json_extract_string(u, '$.completion_tokens') AS BIGINT) AS c, CAST(json_extract_string(u, '$.total_tokens') AS BIGINT) AS t, CAST(json_extract_string(u, '$.cache_read_input_tokens') AS BIGINT) AS r FROM u WHERE json_type(u) = 'OBJECT')
SELECT user_id, CAST(sum(coalesce(i, p)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(o, c)) AS BIGINT) AS output_tokens,
  CAST(CASE WHEN count(t) > 0 THEN sum(t) ELSE coalesce(sum(coalesce(i, p)), 0) + coalesce(sum(coalesce(o, c)), 0) + coalesce(sum(r), 0) END AS BIGINT) AS total_reported_tokens FROM n GROUP BY user_id""")
def q_usage_nested(spark, sf):
    rows = readers.table(spark, sf, "events").select("user_id", F.expr(_NESTED).alias("body"))
    return usage.nested_totals(rows, ["user_id"]).select("user_id", "input_tokens", "output_tokens", "total_reported_tokens")


@query("q_context_text", """WITH m AS (SELECT conv_id, turn, turn // 3 AS s, role || ': ' || text AS text FROM conversations)
SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY s) AS context FROM (SELECT conv_id, s, 'part ' || s || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS block FROM m WHERE turn % 4 < 2 GROUP BY conv_id, s) GROUP BY conv_id""")
def q_context_text(spark, sf):
    t = readers.table(spark, sf, "conversations")
    part = F.expr("turn div 3")
    m = t.select("conv_id", "turn", part.alias("part"), F.concat(F.lit("part "), part.cast("string")).alias("head"), F.concat("conv_id", F.lit("_"), F.col("turn").cast("string")).alias("id"), text.memory_text(F.col("role"), F.col("text")).alias("text"))
    return readers.context_text(m, m.where("turn % 4 < 2"), ["conv_id"], "turn", "part", "head")


@query("q_header_changes", """WITH m AS (SELECT conv_id, turn, (turn // 2) % 2 AS s, text FROM conversations), o AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM m),
r AS (SELECT conv_id, turn, true AS is_header, 'part ' || s AS text FROM o WHERE b IS NULL OR b <> s UNION ALL SELECT conv_id, turn, false, text FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, is_header DESC) - 1 AS pos, is_header, text FROM r""")
def q_header_changes(spark, sf):
    part = F.expr("(turn div 2) % 2")
    m = readers.table(spark, sf, "conversations").select("conv_id", "turn", part.alias("part"), F.concat(F.lit("part "), part.cast("string")).alias("head"), "text")
    return readers.with_headers(m, ["conv_id"], "turn", "part", "head")


@query("q_subagent_tokens", f"SELECT parent, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT user_id AS parent, event_type, arg_max({_TOKENS}, event_id) AS t FROM events GROUP BY user_id, event_type) GROUP BY parent")
def q_subagent_tokens(spark, sf):
    return usage.subagent_tokens(usage_log(spark, sf).select(F.col("user_id").alias("parent"), F.col("event_type").alias("message_id"), F.col("event_id").alias("seq"), "tokens"))


@query("q_tool_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS distinct_users FROM events GROUP BY event_type")
def q_tool_counts(spark, sf):
    return usage.tool_counts(readers.table(spark, sf, "events"), "event_type", "user_id")


_CENTS = "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS x FROM events WHERE event_id % 2 = {} GROUP BY user_id"


@query("q_paired_delta", f"""WITH a AS ({_CENTS.format(0)}), b AS ({_CENTS.format(1)})
SELECT user_id AS key, a.x AS a, b.x AS b, b.x - a.x AS delta, CASE WHEN a.x <> 0 THEN round(100.0::DOUBLE * (b.x - a.x) / a.x, 6) END AS pct FROM a JOIN b USING (user_id)""")
def q_paired_delta(spark, sf):
    """The events of even and of odd numbers as two runs, in cents."""
    e = readers.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    run = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("key").agg(F.sum("v").alias("v"))
    return usage.paired(run(0), run(1), "key", "v")


@query("q_incremental_equals_full", "SELECT 0::BIGINT AS only_full, 0::BIGINT AS only_incremental, (SELECT count(DISTINCT (conv_id, turn)) FROM conversations WHERE regexp_matches(lower(role || ': ' || text), '[a-z0-9]')) AS memories")
def q_incremental_equals_full(spark, sf):
    """An index of the even turns, extended by all memories, against one of all: rows that only either has."""
    m = memories(spark, sf)
    full, inc = append.postings(m), append.extended(append.postings(m.where("memory_idx % 2 = 0")), m)
    key = full.columns
    count = lambda a, b, n: a.exceptAll(b).agg(F.count("*").alias(n))
    return count(full.select(*key), inc.select(*key), "only_full").crossJoin(count(inc.select(*key), full.select(*key), "only_incremental")).crossJoin(full.agg(F.count_distinct("session_id", "memory_idx").alias("memories")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
