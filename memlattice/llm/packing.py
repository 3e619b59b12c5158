"""Packing of documents into sequences of WINDOW tokens.

A document of n tokens gives n // WINDOW full sequences; what remains is cut into a body, a multiple of
GRAIN tokens, and a tail of less than GRAIN. Bodies are packed whole by non-negative least squares: all
shallow combinations of body lengths that fill a window exactly (up to three different lengths, or two with
repetitions) are the columns, the histogram of body lengths over all documents is the target, and the
solution says how often each combination is used. Counts are rounded down; the bodies left over, and the
tails, are packed greedily, one behind the other, each cut where a window ends. Only the last window can be
short: it is split into powers of two, so nothing is padded.

Every place follows by arithmetic from a document's rank among those of its body length, the full
sequences and tail tokens before it. Tasks count these for their own rows, a small table of a row for each
task gives the offsets, and documents are never ordered or gathered.

Defined cases: a null text is empty and gives one token, the end. Repeated rows are packed as often as they
occur; an empty table gives no pieces. A document may be longer than any number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm import _text
from memlattice.llm._shared import written
from memlattice.llm.tokens import encoder

WINDOW = 4096
GRAIN = 64
END = 2


def combinations(cells: int) -> np.ndarray:
    """Columns: how often each length 1 .. cells - 1 occurs in a combination that sums to `cells`."""
    found = set()
    for a in range(1, cells):
        if cells % a == 0:
            found.add(((a, cells // a),))
        for b in range(a + 1, cells):
            for m in range(1, (cells - b) // a + 1):
                if (cells - m * a) % b == 0 and cells > m * a:
                    found.add(((a, m), (b, (cells - m * a) // b)))
            if cells - a - b > b:
                found.add(((a, 1), (b, 1), (cells - a - b, 1)))
    out = np.zeros((cells - 1, len(found)))
    for j, combo in enumerate(sorted(found)):
        for length, times in combo:
            out[length - 1, j] = times
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2_000) -> np.ndarray:
    """min |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * scale or len(passive) >= a.shape[0]:
            break
        passive.append(j)
        while passive:
            z = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z > 1e-10 * scale).all():
                break
            low = z <= 1e-10 * scale
            old = x[passive]
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300)) if low.any() else 1.0
            now = old + min(1.0, max(0.0, step)) * (z - old)
            keep = ~(low & (now <= 1e-9 * scale))
            if keep.all():
                keep[np.flatnonzero(low)[np.argmin(now[low])]] = False
            x[:] = 0
            passive = [p for p, k in zip(passive, keep, strict=True) if k]
            x[passive] = np.maximum(now[keep], 0)
        else:
            continue
        x[:] = 0
        x[passive] = z
    return x


@dataclass
class Plan:
    """Where bodies go. slots[k]: ranges of ranks of length k as arrays (first rank, first sequence, times a sequence, offset)."""

    window: int
    grain: int
    full: int
    combined: int
    taken: np.ndarray  # bodies of each length that are in a combination
    left_at: np.ndarray  # where those left over begin in the stream
    tails_at: int
    stream: int
    slots: list[np.ndarray] = field(default_factory=list)

    def last(self) -> list[tuple[int, int]]:
        """(begin, size) in the stream of the sequences behind the last full window."""
        at, rest = self.stream // self.window * self.window, self.stream % self.window
        out = []
        for bit in reversed(range(self.window.bit_length())):
            if rest >> bit & 1:
                out.append((at, 1 << bit))
                at += 1 << bit
        return out


def plan_for(histogram: np.ndarray, full: int, tails: int, window: int = WINDOW, grain: int = GRAIN) -> Plan:
    """histogram[k]: documents with a body of k grains, k from 0."""
    cells = window // grain
    columns = combinations(cells)
    have = histogram[1:].astype(np.int64)
    times = np.floor(nnls(columns, have.astype(float)) + 1e-7).astype(np.int64)
    used = np.flatnonzero(times)
    counts = columns[:, used].astype(np.int64)
    times = times[used]
    while len(used) and (over := counts @ times - have).max() > 0:  # the fit may exceed a count
        k = int(np.argmax(over))
        j = int(np.argmax(np.where(counts[k] > 0, times, -1)))
        times[j] -= max(1, -(-int(over[k]) // int(counts[k, j]) // 8))
        times = np.maximum(times, 0)
    taken = np.zeros(cells, np.int64)
    slots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(cells)]
    sequence = full
    for j in range(len(used)):
        if not times[j]:
            continue
        offset = 0
        for k in np.flatnonzero(counts[:, j]) + 1:
            m = int(counts[k - 1, j])
            slots[k].append((int(taken[k]), sequence, m, offset))
            taken[k] += m * int(times[j])
            offset += m * int(k) * grain
        sequence += int(times[j])
    left = (histogram - taken) * np.arange(cells) * grain
    left[0] = 0
    ends = np.cumsum(left)
    return Plan(window, grain, full, sequence - full, taken, ends - left, int(ends[-1]), int(ends[-1]) + tails, [np.array(s, np.int64).reshape(-1, 4) for s in slots])


def pieces_of(plan: Plan, n: int, full_before: int, rank: int, tail_before: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document's pieces; the counts of what lies before it are global."""
    window, grain = plan.window, plan.grain
    out = [(i * window, window, full_before + i, 0) for i in range(n // window)]
    start = n // window * window
    k, tail = divmod(n - start, grain)
    if k:
        if rank < plan.taken[k]:
            first, sequence, times, offset = plan.slots[k][np.searchsorted(plan.slots[k][:, 0], rank, "right") - 1]
            nth, slot = divmod(rank - int(first), int(times))
            out.append((start, k * grain, int(sequence) + nth, int(offset) + slot * k * grain))
        else:
            out += _streamed(plan, start, k * grain, int(plan.left_at[k]) + (rank - int(plan.taken[k])) * k * grain)
    if tail:
        out += _streamed(plan, start + k * grain, tail, plan.tails_at + tail_before)
    return out


def _streamed(plan: Plan, start: int, length: int, at: int) -> list[tuple[int, int, int, int]]:
    out = []
    base, whole = plan.full + plan.combined, plan.stream // plan.window
    while length:
        if at < whole * plan.window:
            sequence, offset = divmod(at, plan.window)
            room = plan.window - offset
        else:
            sequence, (begin, size) = next((whole + i, x) for i, x in enumerate(plan.last()) if x[0] <= at < sum(x))
            offset, room = at - begin, begin + size - at
        some = min(length, room)
        out.append((start, some, base + sequence, offset))
        start, length, at = start + some, length - some, at + some
    return out


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, grain: int = GRAIN, end: int = END) -> DataFrame:
    """(id, part, n, full_before, rank, tail_before, ids): ids are 16-bit, and the three counts hold within the part."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path)
        full, tails, ranks = 0, 0, np.zeros(window // grain, np.int64)
        for b in batches:
            for lo, hi, buf, offsets in _text.blocks(b.column(1)):
                ids, first = encode.encode(buf, offsets)
                n = np.diff(first) + 1
                ids = np.insert(ids, first[1:], np.uint16(end)).astype("<u2")
                first = first + np.arange(len(first))
                q, rest = np.divmod(n, window)
                k, t = np.divmod(rest, grain)
                order = np.argsort(k, kind="stable")
                begin = np.searchsorted(k[order], np.arange(window // grain))
                rank = np.empty(len(k), np.int64)
                rank[order] = np.arange(len(k)) - begin[k[order]] + ranks[k[order]]
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part)), *map(pa.array, (n, full + np.cumsum(q) - q, rank, tails + np.cumsum(t) - t)), column],
                    names=["id", "part", "n", "full_before", "rank", "tail_before", "ids"],
                )
                full, tails = full + int(q.sum()), tails + int(t.sum())
                ranks += np.bincount(k, minlength=window // grain)

    return docs.select(id_col, text).mapInArrow(_text.trimmed(run), f"id {kind}, part long, n long, full_before long, rank long, tail_before long, ids binary")


GROUP = 1_000
PARTS = 10_000  # rows of offsets (of about 600 bytes) up to which they are sent to the executors; beyond, they are joined


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, grain: int = GRAIN, end: int = END) -> DataFrame:
    """(id_col, start, length, doc_tokens, sequence_id, offset, ids): ids of the piece, as little-endian unsigned 32-bit numbers."""
    spark, cells = docs.sparkSession, window // grain
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(tokenized(docs, path, id_col, text, window, grain, end), "tokens", "zstd")
    rest = F.col("n") % window
    measure = {"full": F.expr(f"n div {window}"), "tails": rest % grain} | {f"k{i}": (F.floor(rest / grain) == i).cast("long") for i in range(cells)}
    parts = written(rows.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in measure.items()]), "parts")
    total = parts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in measure]).first()
    plan = plan_for(np.array([total[f"k{i}"] for i in range(cells)], np.int64), total["full"], total["tails"], window, grain)
    # A row for each task that read the input: summed within groups of them, and over the groups.
    grouped = parts.withColumn("_group", F.expr(f"part div {GROUP}"))
    within, over = Window.partitionBy("_group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("_group").agg(*[F.sum(k).alias(k) for k in measure])
    sums = sums.select("_group", *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"_{k}") for k in measure])
    shifted = grouped.select("part", "_group", *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(k) for k in measure]).join(sums, "_group")
    shift = lambda k: F.col(k) + F.col(f"_{k}")
    offsets = shifted.select("part", shift("full").alias("_full"), shift("tails").alias("_tails"), F.array(*[shift(f"k{i}") for i in range(cells)]).alias("_ranks"))
    offsets = F.broadcast(offsets) if parts.count() <= PARTS else offsets
    placed = rows.join(offsets, "part").select(
        "id", "n", (F.col("full_before") + F.col("_full")).alias("full_before"),
        (F.col("rank") + F.get("_ranks", F.floor(rest / grain).cast("int"))).alias("rank"), (F.col("tail_before") + F.col("_tails")).alias("tail_before"), "ids",
    )
    told = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        for b in batches:
            n, full, rank, tail = (b.column(i).to_pylist() for i in range(1, 5))
            at, cols, size = [], [[] for _ in range(6)], 0

            def batch(at=at, cols=cols, b=b):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names=names)

            for i in range(len(b)):
                ids = np.frombuffer(b.column(5)[i].as_buffer(), "<u2").astype("<u4")
                for start, length, sequence, offset in pieces_of(told.value, n[i], full[i], rank[i], tail[i]):
                    at.append(i)
                    for c, x in zip(cols, (start, length, n[i], sequence, offset, ids[start : start + length].tobytes()), strict=True):
                        c.append(x)
                    size += length
                if size > 1 << 20:
                    yield batch(at, cols)
                    at, cols, size = [], [[] for _ in range(6)], 0
            yield batch(at, cols)

    return placed.mapInArrow(_text.trimmed(run), f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
