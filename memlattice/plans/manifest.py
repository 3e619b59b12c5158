"""What is indexed: reconciliation of plans with manifests, deltas, status, and the budget of what is kept in memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("MISSING", "RESIDENT", "DISK_ONLY", "BUILDING", "INVALID")
KEY = ["session_id", "segment_id"]


def reconciled(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(session_id, segment_id, state). plan: key, hash, resident. manifest: key, hash, on_disk. An entry holds if the hashes are equal and its file exists."""
    entry = manifest.select(*KEY, F.col("hash").alias("_hash"), "on_disk")
    holds = F.coalesce((F.col("hash") == F.col("_hash")) & F.col("on_disk"), F.lit(False))
    return plan.join(entry, KEY, "left").select(*KEY, F.when(F.col("resident"), "RESIDENT").when(holds, "DISK_ONLY").otherwise("MISSING").alias("state"))


def to_build(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Segments without an entry of the same content."""
    return plan.join(manifest.where("on_disk").select(*KEY, "hash"), [*KEY, "hash"], "left_anti").select(*KEY)


def coverage(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(session_id, ok, reason) for each session of either: duplicate, missing or extra segment ids, in this order; ok without any."""
    m = manifest.groupBy(*KEY).agg(F.count("*").alias("copies"))
    both = plan.select(*KEY).distinct().withColumn("planned", F.lit(1)).join(m, KEY, "full_outer")
    each = both.groupBy("session_id").agg(
        F.count_if(F.col("copies") > 1).alias("dup"), F.count_if(F.col("copies").isNull()).alias("missing"), F.count_if(F.col("planned").isNull()).alias("extra")
    )
    reason = F.when(F.col("dup") > 0, "duplicate segment").when(F.col("missing") > 0, "missing segment").when(F.col("extra") > 0, "extra segment")
    return each.select("session_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def restored(sessions: DataFrame, memories: DataFrame, manifest: DataFrame, hashes: Callable[[DataFrame], DataFrame], context: int, scorer: str = "") -> DataFrame:
    """(session_id, reason) for each session: why its plan can't be taken from its manifest, or null if it can.

    sessions: (session_id[, scorer, owner]); memories: (session_id, memory_idx, text); manifest: (session_id, segment_id, first_idx,
    last_idx_excl, hash, token_count[, scorer, owner]). hashes: content hashes (key, hash) of segment members (key, memory_idx, text).
    Sessions without memories need no manifest. Segments are looked at in order of their id, and each by all rules, before the
    coverage of the whole; the first broken rule is the reason, with its segment where it has one.
    """
    spans = manifest.withColumn("_place", F.row_number().over(Window.partitionBy("session_id").orderBy("segment_id", "first_idx")))
    ok = (F.col("segment_id") >= 0) & (F.col("first_idx") >= 0) & (F.col("last_idx_excl") > F.col("first_idx"))
    own = spans.where(ok).select(*KEY, "_place", "first_idx", "last_idx_excl")
    # A memory's segments: met by the range of indices; a session's segments are few (at most MAX_SEGMENTS), its memories lie in one task each.
    listed = own.groupBy("session_id").agg(F.collect_list(F.struct("_place", "segment_id", "first_idx", "last_idx_excl")).alias("_spans"))
    inside = lambda s: (s["first_idx"] <= F.col("memory_idx")) & (F.col("memory_idx") < s["last_idx_excl"])
    hit = memories.select("session_id", "memory_idx", "text").join(listed, "session_id").withColumn("_own", F.array_sort(F.filter("_spans", inside)))
    taken = hit.select("session_id", "memory_idx", "text", F.posexplode("_own").alias("_nth", "_s")).select("session_id", "memory_idx", "text", "_nth", F.col("_s._place").alias("_place"))
    found = taken.groupBy("session_id", "_place").agg(F.count("*").alias("_held"), F.count_if(F.col("_nth") > 0).alias("_again"))
    digest = hashes(taken.select("session_id", F.col("_place").alias("segment_id"), "memory_idx", "text")).select("session_id", F.col("segment_id").alias("_place"), F.col("hash").alias("_content"))
    each = spans.join(found, ["session_id", "_place"], "left").join(digest, ["session_id", "_place"], "left")
    said = lambda text: F.concat(F.lit(f"{text}: segment="), F.col("segment_id").cast("string"))
    covered = F.coalesce("_held", F.lit(0))
    broken = (
        F.when(~ok, said("invalid segment range"))
        .when(F.col("token_count") > context, said("segment exceeds context limit"))
        .when((covered != F.col("last_idx_excl") - F.col("first_idx")) | (F.coalesce("_again", F.lit(0)) > 0), said("segment memory coverage is invalid"))
        .when(~F.col("_content").eqNullSafe(F.col("hash")), said("segment content hash mismatch"))
    )
    per = each.select("session_id", "_place", broken.alias("_broken"), covered.alias("_held")).groupBy("session_id")
    per = per.agg(F.min(F.when(F.col("_broken").isNotNull(), F.struct("_place", "_broken"))).alias("_first"), F.sum("_held").alias("_covered"))
    n = memories.groupBy("session_id").agg(F.count("*").alias("_memories"))
    rows = sessions.join(n, "session_id", "left").join(per, "session_id", "left")
    if "scorer" in manifest.columns:
        keys = manifest.groupBy("session_id").agg(F.min("scorer").alias("_scorer"), *([F.min("owner").alias("_owner")] if "owner" in manifest.columns else []))
        rows = rows.join(keys, "session_id", "left")
    wrong_scorer = (F.col("_scorer") != scorer) if "scorer" in manifest.columns else F.lit(False)
    wrong_owner = (F.col("_owner") != F.col("session_id")) if "owner" in manifest.columns else F.lit(False)
    reason = (
        F.when(F.coalesce("_memories", F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(F.col("_covered").isNull(), "manifest has no segments")
        .when(wrong_scorer, "model cache key mismatch")
        .when(wrong_owner, "session id mismatch")
        .when(F.lit(context) <= 0, "failed to resolve effective context length")
        .when(F.col("_first").isNotNull(), F.col("_first._broken"))
        .when(F.col("_covered") != F.col("_memories"), F.concat(F.lit("partial manifest coverage: covered="), F.col("_covered").cast("string"), F.lit("/"), F.col("_memories").cast("string")))
    )
    return rows.select("session_id", reason.alias("reason"))


def status_unplanned(sessions: DataFrame, memories: DataFrame, manifest: DataFrame, resident: DataFrame) -> DataFrame:
    """The counts and flags of sessions that have no plan yet: from the manifest alone. manifest: key, token_count, on_disk; resident: key."""
    m = memories.groupBy("session_id").agg(F.count("*").alias("memory_count"))
    e = manifest.groupBy("session_id").agg(F.count("*").alias("segment_count"), F.count_if("on_disk").alias("saved_segments"), F.sum(F.greatest("token_count", F.lit(0))).alias("total_tokens"))
    r = resident.groupBy("session_id").agg(F.count("*").alias("resident_segments"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = sessions.select("session_id").join(m, "session_id", "left").join(e, "session_id", "left").join(r, "session_id", "left")
    n = out.select("session_id", *[z(c).alias(c) for c in ("memory_count", "segment_count", "resident_segments", "saved_segments", "total_tokens")])
    n = n.withColumn("indexed_segments", F.greatest("resident_segments", "saved_segments"))
    has = F.col("segment_count") > 0
    return n.withColumn("indexed", has & (F.col("indexed_segments") == F.col("segment_count"))).withColumn("disk_cached", has & (F.col("saved_segments") == F.col("segment_count")))


def status(segments: DataFrame, memories: DataFrame) -> DataFrame:
    """One row of counts and flags for each session. segments: key, exact_tokens, estimated_tokens, resident, on_disk."""
    tokens = F.when(F.col("exact_tokens") > 0, F.col("exact_tokens")).when(F.col("estimated_tokens") > 0, F.col("estimated_tokens")).otherwise(0)
    n = segments.groupBy("session_id").agg(
        F.count("*").alias("segment_count"), F.count_if("resident").alias("resident_segments"), F.count_if(F.col("resident") | F.col("on_disk")).alias("indexed_segments"),
        F.count_if("on_disk").alias("saved_segments"), F.sum(tokens).alias("total_tokens"),
    )
    m = memories.groupBy("session_id").agg(F.count("*").alias("memory_count"))
    out = m.join(n, "session_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    flag = lambda c: ((F.coalesce("segment_count", F.lit(0)) > 0) & (F.col(c) == F.col("segment_count")))
    return out.select(
        "session_id", z("memory_count"), z("segment_count"), z("resident_segments"), z("indexed_segments"), z("saved_segments"), z("total_tokens"),
        F.coalesce(flag("indexed_segments"), F.lit(False)).alias("indexed"), F.coalesce(flag("saved_segments"), F.lit(False)).alias("disk_cached"), (F.coalesce("resident_segments", F.lit(0)) > 0).alias("has_resident"),
    )


def summary(segments: DataFrame, context: int) -> DataFrame:
    out = segments.groupBy("session_id").agg(F.sum("n").cast("bigint").alias("memory_count"), F.count("*").cast("bigint").alias("segment_count"), F.sum("tokens").cast("bigint").alias("total_tokens"), F.max(F.struct("segment_id", "tokens")).alias("last"))
    return out.select("session_id", "memory_count", "segment_count", "total_tokens", remaining(F.col("last.tokens"), context).cast("bigint").alias("remaining_tokens"))


def remaining(tokens: Column, context: int) -> Column:
    """Tokens left of the whole context; -1 where the count is unknown."""
    return F.when(tokens < 0, F.lit(-1)).otherwise(F.greatest(F.lit(context) - tokens, F.lit(0)))


def resident_bytes(entries: DataFrame) -> DataFrame:
    """Bytes of snapshots; what is only live costs nothing."""
    return entries.agg(F.coalesce(F.sum("snapshot_bytes"), F.lit(0)).alias("bytes"))


def kept_within(entries: DataFrame, budget: int, protected: Column, by: list[str] | None = None) -> DataFrame:
    """Adds kept: least recently used entries go until the rest fits; protected ones stay whatever they cost; budget 0 keeps all.

    An entry stays if it and everything used after it (and all protected ones) fit. by: independent budgets.
    """
    if budget == 0:
        return entries.withColumn("kept", F.lit(True))
    order = Window.partitionBy(*(by or [])).orderBy(F.when(protected, 0).otherwise(1), F.desc("last_access"), *[F.desc(k) for k in KEY])
    total = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("kept", protected | (total <= budget))


# What a store can break, in the order in which it is looked at.
STORE_RULES = ("invalid next memory index", "invalid memory index", "duplicate memory index", "invalid manual segment boundary")


def invalid_stores(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """(session_id, error): repeated indices, indices outside [0, next), boundaries outside [0, next]."""
    dup = memories.groupBy("session_id", "memory_idx").count().where("count > 1").select("session_id", F.lit("duplicate memory index").alias("error"))
    far = memories.join(sessions.select("session_id", "next_memory_idx"), "session_id").where((F.col("memory_idx") < 0) | (F.col("memory_idx") >= F.col("next_memory_idx"))).select("session_id", F.lit("invalid memory index").alias("error"))
    cut = sessions.where(F.exists("boundaries", lambda b: (b < 0) | (b > F.col("next_memory_idx")))).select("session_id", F.lit("invalid manual segment boundary").alias("error"))
    low = sessions.where("next_memory_idx < 0").select("session_id", F.lit("invalid next memory index").alias("error"))
    return dup.unionByName(far).unionByName(cut).unionByName(low).distinct()
