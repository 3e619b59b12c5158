"""The command surface: sessions are created, filled, indexed, saved, searched and removed.

Engine keeps sessions in a Store; every command is a few Spark jobs over that session's rows. Errors carry
the message from which functions.text.error_code tells their code.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice import schema
from memlattice.functions.hashing import segment_hashes
from memlattice.functions.text import token_estimate
from memlattice.operators import search as ops
from memlattice.plans import manifest as mf
from memlattice.plans import planner
from memlattice.sources.store import Store, read_index, session_index, write_index

SCORER = "bm25"


class CommandError(Exception):
    """Its message names what is wrong."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, context: int = schema.CONTEXT, top_k: int = 0):
        self.spark, self.store, self.context, self.top_k = spark, Store(spark, root), context, top_k
        self.index_root = f"{self.store.root}/index"
        self.resident: set[tuple[str, int]] = set()

    # --- sessions ---

    def health(self) -> dict:
        return {"status": "ok", "context_length": self.context, "soft_limit": schema.soft_limit(self.context)}

    def _session(self, session_id: str) -> tuple[DataFrame, DataFrame]:
        try:
            return self.store.load(session_id)
        except KeyError as e:
            raise CommandError(e.args[0]) from None

    def create_session(self, session_id: str, kv_persist: bool = False) -> None:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", session_id) or session_id in (".", ".."):
            raise CommandError("invalid session id")
        if not self.store.read("sessions", session_id).isEmpty():
            raise CommandError(f"session already exists: {session_id}")
        row = self.spark.createDataFrame([(session_id, "", False, kv_persist, 0, [])], schema.SESSIONS)
        self.store.replace("sessions", session_id, row)

    def add_system(self, session_id: str, text: str) -> None:
        s, m = self._session(session_id)
        if not m.isEmpty():
            raise CommandError("system text requires a session without memories")
        self.store.replace("sessions", session_id, s.withColumn("system_text", F.lit(text)).withColumn("system_locked", F.lit(True)))

    def add_memories(self, session_id: str, memories: Iterable[tuple[str | None, str]]) -> list[int]:
        """Appends (id, text); the plan is checked before anything is written. Indices of the new memories."""
        s, m = self._session(session_id)
        start = s.first()["next_memory_idx"]
        rows = [(session_id, start + i, key, text, None) for i, (key, text) in enumerate(memories)]
        new = self.spark.createDataFrame(rows, schema.MEMORIES).withColumn("estimated_tokens", token_estimate(F.col("text")))
        try:
            planner.plan(self._planned_input(m.unionByName(new), s), self.context, boundary=F.col("cut")).collect()  # at most 100 segments of one session
        except Exception as e:
            for said in ("memory is too large for a fresh segment", "segment limit exceeded"):
                if said in str(e):
                    raise CommandError(said) from None
            raise
        changed = self.segments(session_id).agg(F.max("segment_id")).first()[0] if start else None
        self.store.append("memories", session_id, new)
        self.store.replace("sessions", session_id, s.withColumn("next_memory_idx", F.lit(start + len(rows)).cast("bigint")))
        self.resident -= {(session_id, changed)}
        return [r[1] for r in rows]

    def add_memory(self, session_id: str, text: str, key: str | None = None) -> int:
        return self.add_memories(session_id, [(key, text)])[0]

    def next_segment(self, session_id: str) -> int:
        s, m = self._session(session_id)
        row = s.first()
        if m.isEmpty() or row["next_memory_idx"] in row["boundaries"]:
            raise CommandError("next segment requires a memory since the last one")
        self.store.replace("sessions", session_id, s.withColumn("boundaries", F.array_append("boundaries", F.col("next_memory_idx"))))
        return row["next_memory_idx"]

    # --- plans and indexes ---

    def _planned_input(self, memories: DataFrame, session: DataFrame) -> DataFrame:
        cuts = session.select("session_id", "boundaries")
        return memories.join(cuts, "session_id").select("session_id", "memory_idx", F.col("estimated_tokens").alias("tokens"), "id", "text", F.array_contains("boundaries", F.col("memory_idx")).alias("cut"))

    def segments(self, session_id: str) -> DataFrame:
        s, m = self._session(session_id)
        return planner.segments(planner.plan(self._planned_input(m, s), self.context, boundary=F.col("cut")))

    def members(self, session_id: str) -> DataFrame:
        s, m = self._session(session_id)
        return planner.members(self._planned_input(m, s), self.segments(session_id))

    def _hashed(self, session_id: str) -> DataFrame:
        system = self._session(session_id)[0].first()["system_text"]
        return segment_hashes(self.members(session_id), F.lit(system))

    def index_session(self, session_id: str) -> int:
        """Builds the postings of the segments that have none of their content; the number of these segments."""
        missing = [r["segment_id"] for r in self.status(session_id)["states"] if r["state"] == "MISSING"]
        if missing:
            members = self.members(session_id).where(F.col("segment_id").isin(missing))
            write_index(ops.postings(members), self.index_root, SCORER)
        self.resident |= {(session_id, r) for r in missing}
        if self._session(session_id)[0].first()["kv_persist"]:
            self.save_session(session_id)
        return len(missing)

    def save_session(self, session_id: str) -> None:
        """Writes the manifest of all segments, from now on kept up to date by index_session."""
        hashed = self._hashed(session_id).join(self.segments(session_id), ["session_id", "segment_id"])
        now = F.unix_millis(F.current_timestamp())
        rows = hashed.select(
            "session_id", "segment_id", "first_idx", (F.col("last_idx") + 1).alias("last_idx_excl"), F.col("hash").alias("content_hash"), F.col("total").cast("bigint").alias("token_count"),
            (F.col("total") * 4).cast("bigint").alias("bytes"), now.alias("created_ms"), now.alias("last_access_ms"),
        )
        self.store.replace("manifest", session_id, rows)
        self.store.replace("sessions", session_id, self._session(session_id)[0].withColumn("kv_persist", F.lit(True)))

    def status(self, session_id: str) -> dict:
        hashed = self._hashed(session_id)
        mine = [seg for s, seg in self.resident if s == session_id]
        plan = hashed.withColumn("resident", F.col("segment_id").isin(mine) if mine else F.lit(False))
        there = [int(x.removeprefix("segment_id=")) for x in self.store.names_in(session_index(self.index_root, SCORER, session_id)) if x.startswith("segment_id=")]
        stored = F.col("segment_id").isin(there) if there else F.lit(False)
        entries = self.store.read("manifest", session_id).select("session_id", "segment_id", F.col("content_hash").alias("hash"), stored.alias("on_disk"))
        states = mf.reconciled(plan, entries).orderBy("segment_id").collect()  # at most 100 segments
        tokens = self.segments(session_id).agg(F.sum("total")).first()[0] or 0
        return {"states": states, "segment_count": len(states), "indexed": bool(states) and all(r["state"] != "MISSING" for r in states), "total_tokens": tokens}

    def list_sessions(self) -> list[str]:
        """Names of the sessions that can be loaded, in order."""
        return [r[0] for r in self.store.loadable().select("session_id").orderBy("session_id").toLocalIterator()]

    def list_statuses(self) -> DataFrame:
        """Counts and flags of each session that can be loaded, from its manifest, in order of name."""
        sessions = self.store.loadable()
        entries = self.store.read("manifest").select("session_id", "segment_id", "token_count", F.lit(True).alias("on_disk"))
        resident = self.spark.createDataFrame(sorted(self.resident), "session_id string, segment_id int")
        return mf.status_unplanned(sessions, self.store.read("memories"), entries, resident).orderBy("session_id")

    def restore_session(self, session_id: str) -> dict:
        """The session's status, and why its plan can't be taken from its manifest (null if it can)."""
        s, m = self._session(session_id)
        system = F.lit(s.first()["system_text"])
        entries = self.store.read("manifest", session_id).withColumnRenamed("content_hash", "hash")
        reason = mf.restored(s.select("session_id"), m, entries, lambda rows: segment_hashes(rows, system), self.context).first()["reason"]
        return self.status(session_id) | {"reason": reason}

    def clear_session(self, session_id: str) -> None:
        self._session(session_id)
        self.resident = {x for x in self.resident if x[0] != session_id}

    def delete_session(self, session_id: str) -> None:
        self._session(session_id)
        for name in ("sessions", "memories", "manifest"):
            self.store.replace(name, session_id, None)
        self.store.remove(session_index(self.index_root, SCORER, session_id))
        self.clear_resident(session_id)

    def clear_resident(self, session_id: str) -> None:
        self.resident = {x for x in self.resident if x[0] != session_id}

    # --- search ---

    def search(self, session_id: str, query: str, query_context: str = "", top_k: int | None = None) -> DataFrame:
        """(rank, memory_idx, segment_id, id, text). query_context is not scored."""
        if not self.status(session_id)["indexed"]:
            raise CommandError("search requires an indexed session")
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        index = read_index(self.spark, self.index_root, SCORER, ops.POSTINGS).where(F.col("session_id") == session_id)
        found = ops.search_index(asked, index, self.members(session_id), self.top_k if top_k is None else top_k)
        ids = self._session(session_id)[1].select("memory_idx", "id")
        return found.join(ids, "memory_idx", "left").select("rank", "memory_idx", "segment_id", "id", "text").orderBy("rank")

    def oneshot_search(self, memories: DataFrame, query: str, system: str = "", top_k: int | None = None) -> DataFrame:
        """(rank, id, segment_id, text) of memories (pos, id, text), which are planned by the whole context and kept nowhere."""
        rows = memories.select(F.lit("__oneshot__").alias("session_id"), F.col("pos").cast("bigint").alias("memory_idx"), "id", "text", token_estimate(F.col("text")).alias("tokens"))
        placed = planner.member_rows(rows, context=self.context, oneshot=True)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        found = ops.search(asked, placed, self.top_k if top_k is None else top_k)
        return found.join(rows.select("memory_idx", "id"), "memory_idx", "left").select("rank", "id", "segment_id", "text").orderBy("rank")
