"""What SQL can't say, against plain loops."""

import collections
import math
import random
import re
import struct

from memlattice import catalog
from memlattice.functions import hashing
from memlattice.operators import search


def test_segment_hash(spark, sf):
    members = collections.defaultdict(list)
    for r in catalog.placed(spark, sf).collect():
        members[(r["session_id"], r["segment_id"])].append((r["memory_idx"], r["text"]))
    want = {}
    for key, ms in members.items():
        data = struct.pack("<Q", 0) + b"".join(struct.pack("<qQ", i, len(t.encode())) + t.encode() for i, t in sorted(ms))
        state = hashing.BASIS
        for byte in data:
            state = (state ^ byte) * hashing.PRIME % 2**64
        want[key] = f"{state:016x}"
    assert {(r["session_id"], r["segment_id"]): r["hash"] for r in catalog.q_segment_hash(spark, sf).collect()} == want


def plain_bm25(query, items):
    """{id: score} of items {id: text} that share a term."""
    docs = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in items.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    terms = set(re.findall("[a-z0-9]+", query.lower()))
    out = collections.defaultdict(float)
    for w in terms:
        df = sum(w in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(w):
                out[i] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return {i: round(x, 6) for i, x in out.items()}


def plain_segments(texts, context):
    """Segment of each text, planned by the whole context."""
    out, soft = [], context * 85 // 100
    for t in texts:
        n = -(-len(t.encode()) // 4)
        guess = out and state["est"] + max(1, n) + 4
        if not out or (guess > soft and state["total"] + n > soft):
            state = {"est": n + 10, "total": n + 10, "seg": state["seg"] + 1 if out else 0}
        else:
            total = state["total"] + n
            state = {"est": total if guess > soft else guess, "total": total, "seg": state["seg"]}
        out.append(state["seg"])
    return out


def plain_top(query, texts, segments, keep):
    """Places of the best of each segment, segment by segment, and how many segments have any."""
    out, used = [], 0
    for s in sorted(set(segments)):
        scores = plain_bm25(query, {i: t for i, (t, p) in enumerate(zip(texts, segments, strict=True)) if p == s})
        top = sorted(scores, key=lambda i: (-scores[i], i))[:keep]
        out += top
        used += bool(top)
    return out, used


def plain_refine(query, items, keep, passes, size, context):
    """items: [(id, group, text)] in order."""
    top, used = plain_top(query, [t for _, _, t in items], [i // size for i, _, _ in items], keep)
    first = [items[k][0] for k in top]
    current, last, made, seen = first, [], 0, []
    for n in range(1, passes + 1):
        if used <= 1 or set(current) in seen:
            break
        seen.append(set(current))
        chosen = [x for x in items if x[0] in set(current)]
        groups = list(dict.fromkeys(g for _, g, _ in chosen))
        rows = [r for g in groups for r in [(None, f"session {g}"), *((i, t) for i, h, t in chosen if h == g)]]
        texts = [t for _, t in rows]
        top, _ = plain_top(query, texts, plan := plain_segments(texts, context), min(len(rows), len(groups) + keep))
        hits = [k for k in top if rows[k][0] is not None]
        current, used, made = [rows[k][0] for k in hits], len({plan[k] for k in hits}), n
        last = current
    order = last + [i for i in first if i not in set(last)]
    return [(r + 1, i, made) for r, i in enumerate(order)]


def test_refine(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS memory_idx", "source AS group", "text")
    asked = catalog.passages(spark, sf).where("query_id < 6")
    items = sorted(tuple(r) for r in docs.collect())
    longest = max(-(-len(t.encode()) // 4) for _, _, t in items) + 10
    seen = set()
    for keep, passes, size, context in ((3, 2, 50, 2 * longest), (2, 4, 20, longest), (1, 2, 1_000, longest)):
        got = collections.defaultdict(list)
        for r in search.refine(asked, docs, keep, passes, size, catalog._materialise(spark), context).collect():
            got[r["query_id"]].append((r["rank"], r["memory_idx"], r["passes"]))
        for q in asked.collect():
            want = plain_refine(q["query"], items, keep, passes, size, context)
            seen |= {n for _, _, n in want}
            assert sorted(got[q["query_id"]]) == want
    rnd = random.Random(4)
    small = [(i, "st"[i % 2], " ".join(rnd.choice(["cat", "dog", "sat", "hat", "mat", "red"]) for _ in range(rnd.randint(4, 12)))) for i in range(90)]
    one = spark.createDataFrame([(0, "cat hat"), (1, "red"), (2, "zebra")], "query_id long, query string")
    for keep, passes, size, context in ((3, 5, 5, 60), (1, 3, 9, 40), (2, 1, 4, 50)):
        got = collections.defaultdict(list)
        for r in search.refine(one, spark.createDataFrame(small, "memory_idx long, group string, text string"), keep, passes, size, catalog._materialise(spark), context).collect():
            got[r["query_id"]].append((r["rank"], r["memory_idx"], r["passes"]))
        for q in one.collect():
            want = plain_refine(q["query"], small, keep, passes, size, context)
            seen |= {n for _, _, n in want}
            assert sorted(got[q["query_id"]]) == want
    assert {0, 1, 2} <= seen


def test_refine_takes_terms_of_every_length(spark, tmp_path):
    texts = [(0, "s", "a cat sat"), (1, "s", "nothing alike"), (2, "t", "the cat")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "my cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["passes"]) for r in catalog.q_refine(spark, str(tmp_path)).collect())
    assert got == [(7, *x) for x in plain_refine("my cat", texts, 3, 2, 200, catalog.REFINED)] and len(got) == 2


def test_refine_writes_texts_for_no_query(spark, tmp_path):
    """Texts are long and queries many: what the passes write must stay below the texts, however many queries ask for them."""
    rnd = random.Random(7)
    items = [(i, "st"[i % 2], " ".join([f"w{rnd.randrange(10**9)}" for _ in range(1_500)] + rnd.choices(["cat", "dog", "hat", "red"], k=4))) for i in range(60)]
    asked = [(q, " ".join(rnd.sample(["cat", "dog", "hat", "red"], 2))) for q in range(12)]
    written = []

    def write(df):
        path = f"{tmp_path}/pass-{len(written)}"
        df.write.parquet(path)
        written.append(sum(p.stat().st_size for p in (tmp_path / path).glob("*.parquet")))
        return spark.read.schema(df.schema).parquet(path)

    rows = spark.createDataFrame(items, "memory_idx long, group string, text string")
    got = collections.defaultdict(list)
    for r in search.refine(spark.createDataFrame(asked, "query_id long, query string"), rows, 3, 2, 6, write, 60_000).collect():
        got[r["query_id"]].append((r["rank"], r["memory_idx"], r["passes"]))
    for q, query in asked:
        assert sorted(got[q]) == plain_refine(query, items, 3, 2, 6, 60_000)
    assert sum(written) < sum(len(t) for _, _, t in items) / 3


def test_refine_plans_as_many_segments_as_it_takes(spark):
    """A pass of more than a stored session's segments is done whole."""
    items = [(i, "s", f"cat {'red ' * (i % 4)}w{i} " + "dog " * 9) for i in range(2_000)]
    rows = spark.createDataFrame(items, "memory_idx long, group string, text string")
    got = search.refine(spark.createDataFrame([(0, "cat red")], "query_id long, query string"), rows, 4, 1, 8, catalog._materialise(spark), 60).collect()
    assert sorted((r["rank"], r["memory_idx"], r["passes"]) for r in got) == plain_refine("cat red", items, 4, 1, 8, 60)
