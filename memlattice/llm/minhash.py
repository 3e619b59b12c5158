"""Near-duplicate documents: circulant MinHash, bands, exact Jaccard verification, connected components.

A document's set is that of its word shingles, as 64-bit hashes. Two permutations of the 32-bit numbers
make all coordinates of the signature: the first scatters the shingles, the second, circularly shifted by
k, gives coordinate k as the least value over the set. BANDS bands of ROWS coordinates put documents into
buckets: two documents at Jaccard similarity 0.8 miss each other in all buckets with a probability of
(1 - 0.8 ** ROWS) ** BANDS, about 3e-7.

Equal sets are one class from the start, so a group of copies is a single node. Classes that share a bucket
are candidates; only their sets are fetched. They are compared in blocks of about BLOCK bytes of sets, inside a
task, each block's intersections by one matrix product; a block gives the links of a spanning forest, so no row
stands for a pair of documents. First each class is compared within a slice of those that have the same centre
(the least class of its buckets), together with the centre: one comparison block for each slice, linear in the
members, which ties large groups of near copies together. Buckets that are still in several components, and whose
classes were not all in one slice, are compared whole: the classes of such buckets that hang together form a group,
a group beyond BLOCK is split into blocks by set size (a link needs a ratio of at least percent / 100) and
component, and every pair of blocks that could hold a link is one comparison. So no candidate pair is left out.

Defined cases: null and empty texts have an empty set, n_shingles 0, and are linked with nothing: each is
its own component. Texts with fewer words than a shingle are one shingle. Repeated rows are copies. A null
id is no id: the component is named by the least id in it that is not null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm import _text
from memlattice.llm._shared import forget, written
from memlattice.llm.graph import components

ROWS, BANDS = 7, 64
IN_MEMORY = 600_000  # candidate classes of 24 bytes, or rows of jobs of 16, that are sent to the executors; beyond, they are joined
MARKS = 27  # 1 << MARKS bits are sent instead of more candidate classes: 16 MB
BLOCK = 1 << 20  # bytes of sets in a block
ROW = 2_048  # bytes that a set counts for besides its shingles, so that a block holds BLOCK / ROW sets at most


def _mix32(x: np.ndarray) -> None:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t


def signature(shingles: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """The circulant MinHash coordinates of a set of 64-bit hashes."""
    first = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    first *= np.uint32(0x9E3779B1)
    _mix32(first)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    step = 512
    for i in range(0, len(first), step):
        y = first[None, i : i + step] + shifts
        _mix32(y)
        np.minimum(out, y.min(1), out=out)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(-1, rows).astype(np.uint64)
    h = _text.mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return _text.chained(h, *parts.T).view(np.int64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    low = _text.LOWER[buf]
    starts, ends, first = _text.spans(low, offsets)
    h = _text.word_hashes(low, starts, ends)
    m = max(0, len(h) - words + 1)
    g = _text.chained(*[h[k : k + m] for k in range(words)]) if m else h[:0]
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            x = np.sort(g[a : b - words + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            yield _text.chained(np.full(1, 7 * (b - a), np.uint64), *[h[k : k + 1] for k in range(a, b)])
        else:
            yield h[:0]


def node_of(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    one, two = _text.mix(shingles), _text.mix(shingles ^ np.uint64(0xA0761D6478BD642F))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64) ^ np.uint64(len(shingles))], ">u8").tobytes()


def signed(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, n_shingles, node, bands); node and bands are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in _text.blocks(b.column(1)):
                n, node, band = [], [], []
                for x in shingle_sets(buf, offsets, words):
                    n.append(len(x))
                    node.append(node_of(x) if len(x) else None)
                    band.append(bands(signature(x)) if len(x) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["id", "n_shingles", "node", "bands"])

    return docs.select(id_col, text).mapInArrow(_text.trimmed(run), f"id {kind}, n_shingles long, node binary, bands array<long>")


def _named(wanted: DataFrame) -> DataFrame:
    """(one, two, c): 16 bytes that name a class and the id of its first row."""
    half = [F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("long") for at in (1, 9)]
    return wanted.select(half[0].bitwiseXOR(F.xxhash64("id")).alias("one"), half[1].alias("two"), "c")


def _marks(wanted: DataFrame) -> np.ndarray:
    """1 << MARKS bits, those set that the names of wanted point to."""
    words = wanted.groupBy(F.shiftrightunsigned("one", 70 - MARKS).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(one & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << MARKS - 6, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(c, shingles) for the wanted classes (c, node, id), from the row of docs that has the id; rows may be repeated.

    Up to IN_MEMORY classes are looked up where texts are read, so their sets are not shuffled. Beyond, bits of fixed size
    leave out nearly all other rows there, and a join decides.
    """
    wanted = written(_named(wanted), "wanted")  # read twice
    few = wanted.count() <= IN_MEMORY
    if few:
        names = np.array([x.to_numpy() for x in wanted.toArrow().columns], np.int64)
        told = names[:, np.argsort(names[0].view(np.uint64))]
    else:
        told = _marks(wanted)
    told = docs.sparkSession.sparkContext.broadcast(told)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, number = told.value[0].view(np.uint64), told.value[1].view(np.uint64), told.value[2]
        seen = np.zeros(len(one), bool)
        for b in batches:
            for x, first, second in named(b):
                c, sets = [], []
                for i in range(len(x)):
                    at = int(np.searchsorted(one, first[i]))
                    while at < len(one) and one[at] == first[i] and two[at] != second[i]:
                        at += 1
                    if at < len(one) and one[at] == first[i] and not seen[at]:
                        seen[at] = True
                        c.append(number[at]), sets.append(x[i].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(sets, pa.binary())], names=["c", "shingles"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, first, second in named(b):
                at = np.flatnonzero(told.value[first >> np.uint64(70 - MARKS)] >> (first & np.uint64(63)) & np.uint64(1))
                sets = pa.array([x[i].astype("<u8").tobytes() for i in at], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), sets], names=["one", "two", "shingles"])

    def named(b: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """Blocks of sets that are not empty, with both halves of their names."""
        ids = b.column(2).to_numpy().view(np.uint64)
        for lo, hi, buf, offsets in _text.blocks(b.column(1)):
            sets = list(shingle_sets(buf, offsets, words))
            there = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
            sets = [sets[i] for i in there]
            names = np.frombuffer(b"".join(map(node_of, sets)), ">u8").astype(np.uint64).reshape(-1, 2)
            yield sets, names[:, 0] ^ ids[lo:hi][there], names[:, 1].copy()

    rows = docs.select(id_col, text, F.xxhash64(id_col).alias("_id"))
    if few:
        sets = written(rows.mapInArrow(_text.trimmed(looked_up), "c long, shingles binary"), "sets")
    else:
        rows = rows.mapInArrow(_text.trimmed(marked), "one long, two long, shingles binary")
        sets = written(rows.join(wanted, ["one", "two"]).select("c", "shingles"), "sets")
    forget(wanted)
    return sets


def forest(sets: list[np.ndarray], percent: int, columns: int = 4_096) -> np.ndarray:
    """For each set the least index of the sets it hangs together with by links of 100 * intersection >= percent * union."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, inverse = owner[keep], number[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    kinds = int(shared.sum())
    both = np.zeros((m, m), np.float32 if size.max() < 1 << 24 else np.float64)
    for at in range(0, kinds, columns):
        lo, hi = np.searchsorted(inverse, (at, at + columns))
        x = np.zeros((m, min(columns, kinds - at)), both.dtype)
        x[owner[lo:hi], inverse[lo:hi] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        least = np.where(linked, label[None, :], m).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compared(jobs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest for each job; jobs: (c, job). A repeated row of sets counts once.

    Sets are far larger than jobs, so they are shuffled by job only, unless there are more than IN_MEMORY rows of jobs.
    """
    jobs = written(jobs, "jobs")  # counted, then read
    few = jobs.count() <= IN_MEMORY
    rows = sets.join(F.broadcast(jobs) if few else jobs, "c").select("job", "c", "shingles")
    rows = rows.repartition("job").sortWithinPartitions("job", "c")

    def links(c: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(c) > 1:
            _text.one_thread()
            label, c = forest(sets, percent), np.array(c)
            at = np.flatnonzero(label != np.arange(len(c)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(c[label[at]]), pa.array(c[at])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, c, held = None, [], []
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if keys[i] != job:
                    yield from links(c, held)
                    job, c, held = keys[i], [], []
                for k in range(i, j):
                    if not c or c[-1] != ids[k]:
                        c.append(int(ids[k]))
                        held.append(np.frombuffer(batch.column(2)[k].as_buffer().to_pybytes(), "<u8"))
        yield from links(c, held)

    out = written(rows.mapInArrow(_text.trimmed(run), "a long, b long"), "linked")
    forget(jobs)
    return out


def _slices(home: DataFrame) -> DataFrame:
    """(c, job) for classes (c, centre, weight): the members of a centre, dealt over slices of about BLOCK bytes, and the centre in each."""
    many = home.groupBy("centre").agg(F.ceil(F.sum("weight") / BLOCK).alias("slices"))
    return home.join(many, "centre").select("c", "centre", F.xxhash64("centre", F.pmod(F.xxhash64("c"), F.col("slices"))).alias("job"))


def _blocks(classes: DataFrame, percent: int) -> DataFrame:
    """(c, job) for classes (c, root, n, weight, g): every two classes of a group g that could be linked, and aren't yet, meet in a job.

    A group of up to BLOCK bytes is a job. Larger ones are cut by size (parts in which sets differ by less than a link
    allows, so that linked sets lie in the same or in neighbouring parts) and by component where that alone exceeds BLOCK.
    """
    group = classes.groupBy("g").agg((F.sum("weight") > BLOCK).alias("large"))
    told = classes.join(group, "g")
    small = told.where(~F.col("large")).select("c", F.xxhash64("g").alias("job"))
    part = F.floor(F.log("n") / F.log(F.lit(101.0 / percent))).cast("long")
    large = told.where("large").select("c", "root", "weight", "g", part.alias("part"))
    pure = large.groupBy("g", "part", "root").agg(F.when(F.sum("weight") > BLOCK, F.col("root")).otherwise(F.lit(-1)).alias("mark"))
    large = large.join(pure, ["g", "part", "root"])
    cells = large.groupBy("g", "part", "mark").agg(F.ceil(F.sum("weight") / BLOCK).alias("blocks"))
    large = written(large.join(cells, ["g", "part", "mark"]).select("c", "g", "part", "mark", F.xxhash64("g", "part", "mark", F.pmod(F.xxhash64("c"), F.col("blocks"))).alias("block")), "blocks")
    blocks = large.select("g", "part", "mark", "block").distinct()
    one = blocks.select("g", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("p"), F.col("mark").alias("m"), F.col("block").alias("x"))
    pairs = one.join(blocks.withColumnRenamed("block", "y"), ["g", "part"])
    pairs = pairs.where((F.col("m") != F.col("mark")) | (F.col("m") == -1)).where((F.col("p") < F.col("part")) | (F.col("x") <= F.col("y")))
    pairs = pairs.select("x", "y", F.xxhash64("x", "y").alias("job"))
    sides = pairs.select("job", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return small.unionByName(large.select("c", "block").join(sides, "block").select("c", "job"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, node, root, component_id, kept) for each row of docs; node names the class of equal sets, root the component."""
    rows = written(signed(docs, id_col, text, words), "signed")
    sized = rows.where("node is not null")
    classes = sized.groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbered once: the table is written
    bucket = Window.partitionBy("key").orderBy("c")
    spread = classes.select("c", F.explode("bands").alias("key"))
    spread = spread.select("key", "c", F.lag("c").over(bucket).alias("_before"), F.lead("c").over(bucket).alias("_after"), F.first("c").over(bucket).alias("centre"))
    buckets = written(spread.where("_before is not null or _after is not null").select("key", "c", "centre"), "buckets")
    sizes = classes.select("c", "n", (8 * F.col("n") + ROW).alias("weight"))
    home = buckets.groupBy("c").agg(F.min("centre").alias("centre"))
    sets = _sets(docs, home.select("c").join(classes.select("c", "node", "id"), "c"), id_col, text, words)
    sliced = written(_slices(home.join(sizes, "c")), "slices")
    jobs = sliced.where("c <> centre").select("c", "job").unionByName(sliced.select(F.col("centre").alias("c"), "job").distinct())
    links = _compared(jobs, sets, percent)
    roots = components(links)
    forget(links)
    # Buckets in several components, whose classes were not all compared with one another.
    placed = buckets.join(roots, F.col("c") == F.col("node"), "left").select("key", "c", "centre", F.coalesce("root", "c").alias("root"))
    placed = written(placed.join(sliced.select("c", "job"), "c"), "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("job").alias("i"), F.max("job").alias("j"))
    left = written(placed.join(split.where("a <> b and i <> j").select("key"), "key").select("c", "centre", "root").distinct(), "open")
    groups, more = None, None
    forget(buckets)
    if not left.isEmpty():
        groups = components(left.select(F.col("centre").alias("a"), F.col("c").alias("b")))
        grouped = left.select("c", "root").distinct().join(groups.select(F.col("node").alias("c"), F.col("root").alias("g")), "c", "left").withColumn("g", F.coalesce("g", "c"))
        more = _compared(_blocks(grouped.join(sizes, "c"), percent), sets, percent)
        if not more.isEmpty():
            first, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
            forget(first)
    named = classes.select("c", "node", "id").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("node", "id", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = written(named.join(least, "root").select("node", "root", "component_id"), "classes")
    forget(classes, sets, sliced, placed, left, groups, more, roots)
    out = rows.select("id", "n_shingles", "node").where("node is not null").join(of_class, "node")
    empty = rows.where("node is null").select("node", "id", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    out = out.unionByName(empty)
    return out.select(F.col("id").alias(id_col), "n_shingles", "node", "root", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates, that of the least id (of the least set among rows of one id; null ids last).

    Rows without words are linked with nothing and all stay. Columns and their order are those of docs.
    """
    first = near_duplicates(docs, words, percent, id_col, text).where("root is not null").groupBy("root")
    first = first.agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "node")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.node").alias("_set"))
    name = "node"
    while name in docs.columns or name + "key" in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [node_of(x) if len(x) else None for _, _, buf, offsets in _text.blocks(b.column(b.schema.names.index(text))) for x in shingle_sets(buf, offsets, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.binary())], names=[*b.schema.names, name])

    key = name + "key"  # the id without null, so that the join and what follows it share one shuffle
    tagged = docs.mapInArrow(_text.trimmed(run), schema).withColumn(key, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    first = first.select(F.col("_set").alias(name), F.coalesce(F.col("_id").cast("string"), F.lit("")).alias(key))
    some = tagged.where(F.col(name).isNotNull()).join(first, [name, key], "left_semi")
    return some.dropDuplicates([name, key]).unionByName(tagged.where(F.col(name).isNull())).select(*docs.columns)
