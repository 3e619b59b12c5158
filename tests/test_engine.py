"""Behaviour of planner, manifest, commands, requests and sources on inline fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memlattice import schema
from memlattice.commands import CommandError, Engine
from memlattice.functions import hashing, text
from memlattice.operators import chunker, fusion, metrics, ranks, search, usage
from memlattice.plans import manifest, planner
from memlattice.sources import readers, requests, sinks
from memlattice.streaming import append


def plain_plan(tokens, cuts=(), context=700, empty=10):
    """The packing rule as a loop."""
    soft, out = context * 85 // 100, []
    for i, t in enumerate(tokens):
        guess = out and out[-1]["est"] + max(1, t) + 4
        exact = out and out[-1]["total"] + t
        if not out or i in cuts or (guess > soft and exact > soft):
            out.append({"first": i, "est": t + empty, "exact": t + empty, "total": t + empty})
        else:
            out[-1].update(est=exact if guess > soft else guess, exact=exact if guess > soft else 0, total=exact)
    return [(s["first"], s["est"], s["exact"]) for s in out]


def test_planner_random(spark):
    rnd = random.Random(7)
    cases = {f"s{k}": ([rnd.randint(1, 400) for _ in range(rnd.randint(1, 60))], rnd.sample(range(60), 3)) for k in range(40)}
    rows = [(s, i, t, i in cuts) for s, (ts, cuts) in cases.items() for i, t in enumerate(ts)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, memory_idx long, tokens int, cut boolean")
    got = planner.segments(planner.plan(df, boundary=F.col("cut"))).orderBy("session_id", "segment_id").collect()
    for s, (ts, cuts) in cases.items():
        assert [(r["first_idx"], r["estimated_tokens"], r["exact_tokens"]) for r in got if r["session_id"] == s] == plain_plan(ts, cuts)


def test_planner_errors(spark):
    one = lambda *ts: spark.createDataFrame([("s", i, t) for i, t in enumerate(ts)], "session_id string, memory_idx long, tokens int")
    with pytest.raises(Exception, match="memory is too large for a fresh segment"):
        planner.plan(one(590)).collect()
    assert planner.segments(planner.plan(one(590), oneshot=True)).count() == 1
    with pytest.raises(Exception, match="segment limit exceeded"):
        planner.plan(one(*[500] * 101)).collect()
    assert planner.segments(planner.plan(one())).count() == 0


def test_hash(spark):
    assert hashing.fnv1a(b"") == hashing.BASIS
    df = spark.createDataFrame([("s", 0, 1, "b"), ("s", 0, 0, "a"), ("t", 0, 0, "a")], "session_id string, segment_id int, memory_idx long, text string")
    got = {r["session_id"]: r["hash"] for r in hashing.segment_hashes(df).collect()}
    again = {r["session_id"]: r["hash"] for r in hashing.segment_hashes(df.orderBy("memory_idx"), F.lit("system")).collect()}
    assert got["s"] != got["t"] and got["s"] != again["s"]


def test_commands(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.create_session("demo")
    with pytest.raises(CommandError, match="already exists"):
        e.create_session("demo")
    with pytest.raises(CommandError, match="invalid session id"):
        e.create_session("../bad")
    with pytest.raises(CommandError, match="not found"):
        e.add_memory("nobody", "x")
    e.add_system("demo", "be brief")
    assert e.add_memories("demo", [("a", "red apples are sweet"), (None, "green pears"), ("", "apples and pears")]) == [0, 1, 2]
    with pytest.raises(CommandError, match="without memories"):
        e.add_system("demo", "late")
    with pytest.raises(CommandError, match="indexed"):
        e.search("demo", "apples")
    e.next_segment("demo")
    with pytest.raises(CommandError):
        e.next_segment("demo")
    e.add_memory("demo", "apples once more", "z")
    assert e.index_session("demo") == 2
    assert e.index_session("demo") == 0
    found = e.search("demo", "apples").collect()
    assert [(r["rank"], r["memory_idx"], r["segment_id"]) for r in found] == [(1, 2, 0), (2, 0, 0), (3, 3, 1)]
    assert len(e.search("demo", "apples", top_k=1).collect()) == 2
    e.save_session("demo")
    e.clear_session("demo")
    assert {r["state"] for r in e.status("demo")["states"]} == {"DISK_ONLY"}
    e.add_memory("demo", "a pear")
    assert [r["state"] for r in e.status("demo")["states"]] == ["DISK_ONLY", "MISSING"]
    one = e.oneshot_search(spark.createDataFrame([(0, "k", "an apple"), (1, None, "a pear")], "pos long, id string, text string"), "apple").collect()
    assert [(r["rank"], r["id"]) for r in one] == [(1, "k")]
    assert e.list_sessions() == ["demo"]
    assert e.restore_session("demo")["reason"] == "partial manifest coverage: covered=4/5"
    (row,) = e.list_statuses().collect()
    assert (row["session_id"], row["memory_count"], row["segment_count"], row["saved_segments"], row["indexed"]) == ("demo", 5, 2, 2, True)
    e.delete_session("demo")
    assert not (tmp_path / "store" / "index" / "scorer_key=bm25" / "session_id=demo").exists()
    assert e.list_sessions() == []


def test_indexes_are_stored_and_built_once(spark, tmp_path):
    root = str(tmp_path / "store")
    e = Engine(spark, root)
    e.create_session("a", kv_persist=True)
    e.add_memories("a", [(None, "red apples " * 60), (None, "green pears " * 60), (None, "apples and pears " * 60)])
    first = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "memories").rglob("part-*.parquet")}
    n = e.index_session("a")
    assert n == len(e.status("a")["states"]) > 1
    again = Engine(spark, root)  # nothing is resident here
    assert {r["state"] for r in again.status("a")["states"]} == {"DISK_ONLY"} and again.index_session("a") == 0
    assert again.restore_session("a")["reason"] is None
    want = [(r["rank"], r["memory_idx"]) for r in search.search(spark.createDataFrame([(0, "apples")], "query_id long, query string"), again.members("a"), 0).orderBy("rank").collect()]
    assert [(r["rank"], r["memory_idx"]) for r in again.search("a", "apples").collect()] == want
    again.add_memory("a", "plums")
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "memories").rglob("part-*.parquet")}
    assert first.items() < now.items()  # appended, not written again
    assert again.index_session("a") == 1


def test_manual_cuts_count_when_memories_are_added(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.create_session("a")
    e.add_memories("a", [(None, f"memory {i}") for i in range(101)])
    s, _ = e.store.load("a")
    e.store.replace("sessions", "a", s.withColumn("boundaries", F.sequence(F.lit(1).cast("long"), F.lit(99).cast("long"))))
    assert e.segments("a").count() == 100
    e.next_segment("a")
    with pytest.raises(CommandError, match="segment limit exceeded"):
        e.add_memory("a", "one more")
    assert e.segments("a").count() == 100


def test_store_rules(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    for name in ("good", "bad"):
        e.create_session(name)
        e.add_memories(name, [(None, "x"), (None, "y")])
    m = e.store.read("memories", "bad")
    e.store.append("memories", "bad", m.unionByName(m.withColumn("memory_idx", F.lit(9).cast("long"))))
    with pytest.raises(ValueError, match="^invalid memory index in store$"):
        e.store.load("bad")
    assert e.list_sessions() == ["good"]


def test_restore_order_of_rules(spark):
    sessions = spark.createDataFrame([(x,) for x in "abcde"], "session_id string")
    memories = spark.createDataFrame([(s, i, f"t{i}") for s in "abcd" for i in range(4)], "session_id string, memory_idx long, text string")
    digest = lambda rows: hashing.segment_digests(rows).withColumnRenamed("sha", "hash")
    cut = spark.createDataFrame([(s, k, 2 * k, 2 * k + 2) for s in "abcd" for k in (0, 1)], "session_id string, segment_id int, first_idx long, last_idx_excl long")
    held = memories.join(cut, "session_id").where("memory_idx between first_idx and last_idx_excl - 1")
    entries = cut.join(digest(held.select("session_id", "segment_id", "memory_idx", "text")), ["session_id", "segment_id"]).withColumn("token_count", F.lit(5))
    entries = entries.withColumn("scorer", F.when(F.col("session_id") == "b", "other").otherwise("mine"))
    entries = entries.withColumn("first_idx", F.expr("CASE WHEN session_id = 'c' AND segment_id = 1 THEN 1 ELSE first_idx END"))  # overlaps
    entries = entries.withColumn("hash", F.expr("CASE WHEN session_id IN ('c', 'd') AND segment_id = 1 THEN 'x' ELSE hash END"))
    got = {r["session_id"]: r["reason"] for r in manifest.restored(sessions, memories, entries, digest, 700, "mine").collect()}
    assert got == {"a": None, "b": "model cache key mismatch", "c": "segment memory coverage is invalid: segment=1", "d": "segment content hash mismatch: segment=1", "e": None}


def plain_blocks(lines, rule, target=30, window=10):
    out, at = [], 0
    blank = [i + 1 for i, x in enumerate(lines) if not x.strip()]
    while at < len(lines):
        want = min(at + target, len(lines))
        near = [b for b in blank if (max(at + 1, want - window) if rule == "nearest" else want) <= b <= min(len(lines), want + window)]
        end = len(lines) if want == len(lines) else (min(near, key=lambda b: (abs(b - want), b)) if rule == "nearest" else min(near)) if near else want
        out.append((at + 1, end, "\n".join(lines[at:end])))
        at = end
    return [x for x in out if x[2].strip()]


def test_blocks(spark):
    rnd = random.Random(5)
    texts = [[rnd.choice(["", " ", "x", "y z"]) if rnd.random() < p else f"line {i}" for i in range(n)] for p in (0.0, 0.1, 0.9, 1.0) for n in (1, 29, 31, 200, 3_000)]
    docs = spark.createDataFrame([(i, "\n".join(t) + "\n") for i, t in enumerate(texts)], "doc_id long, text string")
    for rule in ("nearest", "forward"):
        got = chunker.blocks(docs, rule).orderBy("doc_id", "start_line").collect()
        for i, t in enumerate(texts):
            assert [(r["start_line"], r["end_line"], r["text"]) for r in got if r["doc_id"] == i] == plain_blocks(t, rule)


def test_merge_and_limits(spark):
    rows = spark.createDataFrame([(0, 2, 1, 7), (0, 1, 1, 7), (0, 1, 2, 8), (0, 2, 2, 9)], "query_id int, segment_id int, seg_rank int, memory_idx long")
    assert [(r["rank"], r["memory_idx"], r["segment_id"]) for r in search.merged(rows, ["query_id"]).orderBy("rank").collect()] == [(1, 7, 1), (2, 8, 1), (3, 9, 2)]
    assert search.limited(rows, 1).count() == 2 and search.limited(rows, 0).count() == 4
    local = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (4, 9, 2), (4, -1, 3)], "segment_id int, local_idx int, pos int")
    members = spark.createDataFrame([(4, 0, 10), (4, 1, 11)], "segment_id int, local_idx int, memory_idx long")
    assert [r["memory_idx"] for r in search.resolved(local, members).orderBy("pos").collect()] == [11, 10]


def test_dcg_variants(spark):
    q = spark.createDataFrame([(0,)], "query_id long")
    r = spark.createDataFrame([(0, i + 1, i) for i in range(3)], "query_id long, rank long, item long")
    g = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, item long")
    assert metrics.ndcg(q, r, g, "item", "a", (3,)).first()["ndcg"] == pytest.approx(0.8155, abs=1e-4)
    assert metrics.ndcg(q, r, g, "item", "b", (3,)).first()["ndcg"] == pytest.approx(0.6934, abs=1e-4)
    none = metrics.recall(q, r, g.limit(0), "item", (3,)).first()
    assert (none["recall_any"], none["recall_all"]) == (0.0, 0.0)


def test_ranks_in_cells(spark):
    rnd = random.Random(11)
    data = [(g, rnd.choice([1.0, 2.5, rnd.random() * 1e6, -rnd.random()]), i) for i, g in enumerate(rnd.choice("abc") for _ in range(3_000))] + [("one", 7.0, -1)] + [("same", 3.0, k) for k in range(5_000, 5_009)]
    df = spark.createDataFrame(data, "g string, v double, i long")
    got = {(r["g"], r["i"]): r["rank"] for r in ranks.ranked_in_cells(df, ["g"], "v", ["i"]).collect()}
    median = {r["g"]: r["m"] for r in metrics.upper_median(df, "g", "v", "m").collect()}
    for g in {x[0] for x in data}:
        own = sorted((v, i) for h, v, i in data if h == g)
        assert [got[(g, i)] for _, i in own] == list(range(1, len(own) + 1))
        assert median[g] == own[len(own) // 2][0]
    every = {r["i"]: r["rank"] for r in ranks.ranked_in_cells(df, [], "v", ["i"]).collect()}
    assert [every[i] for _, i in sorted((v, i) for _, v, i in data)] == list(range(1, len(data) + 1))
    assert ranks.ranked_in_cells(df.limit(0), [], "v", ["i"]).count() == 0
    rows = df.select(F.lit(0).alias("query_id"), F.length("g").alias("segment_id"), F.col("i").alias("seg_rank"), (F.col("i") % 700).alias("memory_idx"))
    key = lambda d: sorted((r["rank"], r["memory_idx"]) for r in d.collect())
    assert key(search.merged(rows, ["query_id"], large=True)) == key(search.merged(rows, ["query_id"]))


def test_lru(spark):
    e = spark.createDataFrame([("a", 0, 4, 1), ("a", 1, 4, 3), ("b", 0, 4, 2)], "session_id string, segment_id int, bytes long, last_access long")
    kept = lambda budget, safe: {(r["session_id"], r["segment_id"]) for r in manifest.kept_within(e, budget, safe).collect() if r["kept"]}
    assert kept(8, F.lit(False)) == {("a", 1), ("b", 0)}
    assert kept(8, F.col("last_access") == 1) == {("a", 0), ("a", 1)}
    assert len(kept(0, F.lit(False))) == 3


def test_ranges_and_paths(spark):
    h = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 8, 9), (1, 2, 2), (1, 0, 4), (1, 9, 8)], "doc_id long, start_line long, end_line long")
    assert fusion.ranges_as_text(fusion.merged_ranges(h, ["doc_id"]), ["doc_id"]).first()["ranges"] == "1-5,8-9"
    r = spark.createDataFrame([(0, 1, "x/b.py"), (0, 2, "src/a.py")], "query_id long, rank long, path string")
    t = spark.createDataFrame([(0, "a.py")], "query_id long, target string")
    assert fusion.first_match_ranks(r, t).first()["rank"] == 2


def test_requests(spark):
    cases = {
        "add-memory": [('{"id":"e","text":"m"}', True), ('{"id":null,"text":"m"}', True), ('{"text":"m","metadata":1}', False), (json.dumps({"text": "m", "id": "x" * 4097}), False), ('{"id":"a"}', False), ("", False)],
        "create-session": [("{}", True), ('{"kv_persist":true}', True), ('{"kv-persist":true}', True), ('{"kv_persist":"yes"}', False), ('{"kv_persist":true,"kv-persist":true}', False)],
        "search": [('{"query":"q","top_k":0}', True), ('{"query":"q","top_k":2147483648}', False), ('{"query":"q","top_k":1.5}', False), ("[]", False)],
        "oneshot-search": [('{"query":"q","memories":[{"text":"a"},{"id":"b","text":"c"}]}', True), ('{"query":"q","memories":{}}', False), ('{"query":"q","memories":["x"]}', False), ('{"query":"q","memories":[{"text":"a","file":"f"}]}', False), ('{"query":"q","memories":[{"text":7}]}', False), ('{"query":"q","memories":[{"text":"a","id":7}]}', False), ('{"query":"q","memories":[{"text":"a","id":null}]}', True), (json.dumps({"query": "q", "memories": [{"text": "a", "id": "x" * 4097}]}), False), ('{"query":"q","memories":[]}', False), ('{"query":"q","memories":[{"text":"a"}],"system":7}', False)],
    }
    for command, bodies in cases.items():
        df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, body string")
        got = requests.validated(df, command).orderBy("i").collect()
        assert [r["ok"] for r in got] == [ok for _, ok in bodies], (command, got)
    out = requests.error_responses(spark.createDataFrame([("session not found: a",)], "message string")).first()
    assert out["status"] == 404 and json.loads(out["body"])["error"]["details"] == {"session_id": "a"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"x"}\nbroken\n')
    kind = "id string, text string"
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), kind, strict=False).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), kind).collect()
    (tmp_path / "m.json").write_text('{"memories":[{"text":"a"},{"id":"b","text":"c"}]}')
    assert readers.json_memories(spark, str(tmp_path / "m.json")).count() == 2
    src = tmp_path / "src"
    for p in ("a.py", "node_modules/b.py", "c.bin", "d/e.go", "d/F.TSX", "CMakeLists.txt", "notes.txt", "WORKSPACE", "x.pyx", "site-packages/y.py", "target/z.rs"):
        (src / p).parent.mkdir(parents=True, exist_ok=True)
        (src / p).write_text("x\n")
    assert [r["path"].split("/src/")[1] for r in readers.source_files(spark, str(src)).collect()] == ["CMakeLists.txt", "a.py", "d/F.TSX", "d/e.go", "site-packages/y.py", "target/z.rs"]
    assert [r["path"].split("/src/")[1] for r in readers.source_files(spark, str(src), repository=True).collect()] == ["CMakeLists.txt", "WORKSPACE", "a.py", "d/F.TSX", "d/e.go", "target/z.rs", "x.pyx"]
    readers.write_sidecar(spark.createDataFrame([("1", "x")], kind), str(tmp_path / "side"))
    assert readers.read_sidecar(spark, str(tmp_path / "side"), kind).count() == 1
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(["[Mon]", "", " a ", "[Tue]", "b"])], "d int, pos int, line string")
    assert [(r["section"], r["line_no"], r["text"]) for r in readers.sectioned(lines, ["d"]).orderBy("line_no").collect()] == [("Mon", 2, "a"), ("Tue", 4, "b")]
    hay = spark.createDataFrame([("q", ["answer_1"], ["d"], [[("user", "hi", True), ("assistant", "yo", None)]])], "question_id string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>")
    assert [r["id"] for r in readers.haystack(hay).orderBy("turn_pos").collect()] == ["noans_1_header", "answer_1_1", "noans_1_2"]
    assert readers.answerable(hay).count() == 1


def test_text(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "x string").select(c(F.col("x"))).first()[0]
    assert one(text.log_line, "a\nb" + "é" * 100) == "a b" + "é" * 78 + "..."
    assert one(text.url_segment, "a b/c") == "a%20b%2Fc"
    assert one(text.is_procedural, "") and one(text.is_procedural, "Let me see") and not one(text.is_procedural, "It is 4")
    assert one(lambda c: text.invokes(c, "rg"), "cd x && rg foo") and not one(lambda c: text.invokes(c, "rg"), "argh")
    assert one(text.media_type_is_json, " Application/JSON ; charset=x") and not one(text.media_type_is_json, "text/plain")
    assert one(text.media_type_is_json, "\tapplication/json\t") and not one(text.media_type_is_json, "") and not one(text.media_type_is_json, None)
    assert [one(text.size_bytes, x) for x in ("18446744073709551615", "0018446744073709551615", "16777215tib", "16777216tib", "99999999999999999999999", "99999999999999999999999k")] == [2**64 - 1, 2**64 - 1, 16777215 * 1024**4, None, 2**64 - 1, None]
    assert one(lambda c: text.abbreviated(F.length(c) * 1000), "abc") == "3.0k"


def test_stream_append(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, "a b"), ("s", 1, "b c")], "session_id string, memory_idx long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append.append_memories(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2
    full = append.postings(rows)
    assert append.extended(append.postings(rows.limit(1)), rows).exceptAll(full).isEmpty()


def test_usage(spark):
    df = spark.createDataFrame([("p", "m1", 1, 5), ("p", "m1", 2, 7), ("p", None, 3, 1)], "parent string, message_id string, seq int, tokens int")
    assert usage.subagent_tokens(df).first()["tokens"] == 8
    assert usage.distinct_turns(df).first()["subagent_turns"] == 2
    u = spark.createDataFrame([({"prompt_tokens": 3, "output_tokens": 4},)], "u map<string,long>").select(usage.normalised(F.col("u")).alias("u")).select("u.*").first()
    assert (u["input_tokens"], u["total_tokens"]) == (3, 7)


def test_agent_tokens(spark):
    say = lambda parent, mid, n: {"parent_tool_use_id": parent, "message": {"id": mid, "role": "assistant", "content": [], "usage": {"input_tokens": n, "output_tokens": 1, "other": 9}}}
    back = lambda *ids, n: {"message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i} for i in ids]}, "tool_use_result": {"totalTokens": n}}
    call = lambda i, name, parent=None: {"parent_tool_use_id": parent, "message": {"id": "c", "role": "assistant", "content": [{"type": "tool_use", "name": name, "id": i}]}}
    logs = {
        "new": [{"type": "system", "subtype": "task_started", "tool_use_id": "t1"}, {"type": "system", "subtype": "task_started", "task_id": "t2"}, call("t9", "Task"), say("t1", "m", 5), say("t1", "m", 7), say("t2", "m", 1), say("t9", "m", 100), back("t1", "t2", n=20), back("t9", n=50)],
        "old": [call("a", "Agent"), call("b", "Read"), call("c", "Task", "a"), say("a", "m1", 2), say("a", None, 3), say("c", "m1", 50), back("a", n=4), back("b", n=40)],
        "none": [say(None, "m", 5)],
    }
    rows = [(s, i, json.dumps(e)) for s, es in logs.items() for i, e in enumerate(es)] + [("none", 9, "not json")]
    got = {r["sample"]: r["tokens"] for r in usage.agent_tokens(spark.createDataFrame(rows, "sample string, seq int, body string"), "sample", "seq").collect()}
    assert got == {"new": 8 + 2 + 20, "old": 3 + 4 + 4, "none": 0}


def test_nested_usage(spark):
    bodies = ['{"usage":{"input_tokens":1,"usage":{"completion_tokens":2.9}},"a":[{"usage":{"prompt_tokens":4,"input_tokens":3}}]}', "broken", None, '{"usage":[{"usage":{"output_tokens":true}}]}']
    got = usage.nested_totals(spark.createDataFrame([("k", b) for b in bodies], "k string, body string"), ["k"]).first()
    assert (got["input_tokens"], got["output_tokens"], got["prompt_tokens"], got["total_tokens"], got["total_reported_tokens"]) == (4, 2, 4, None, 6)


def test_answers_and_judgements(spark):
    rows = spark.createDataFrame([("a", 1, None, "top old"), ("a", 2, None, "top new"), ("a", 3, "p", "inner"), ("b", 1, "p", "x"), ("b", 2, "p", "y")], "k string, seq int, parent string, text string")
    assert {r["k"]: r["text"] for r in usage.latest_answer(rows, "k").collect()} == {"a": "top new", "b": "y"}
    judged = spark.createDataFrame([("m", 3.0, None), ("m", None, {"x": 1.0, "y": 0.5})], "k string, total_score double, scores map<string,double>")
    got = usage.judged(judged, "k").first()
    assert (got["samples"], got["total"], got["average"]) == (2, 4.5, 2.25)
    total = usage.overall(judged.selectExpr("1 AS n"), ["n"]).first()
    assert (total["samples"], total["n"]) == (2, 2) and usage.overall(judged.limit(0).selectExpr("1 AS n"), ["n"]).first()["n"] == 0


def test_small_rules(spark, tmp_path):
    one = lambda c, *xs: spark.range(1).select(c(*[F.lit(x) for x in xs])).first()[0]
    assert one(lambda k: search.effective_top_k(k, 5), 0) == 0 and one(lambda k: search.effective_top_k(k.cast("int"), 5), None) == 5
    assert [one(sinks.fetch_count, *x) for x in ((10, 2, 3), (4, 2, 3))] == [5, 4]
    assert one(text.first_present, "", "b") == "b" and one(lambda a, b: text.first_present(a.cast("string"), b), None, "") is None
    assert one(lambda t: text.time_text(t.cast("timestamp")), "2024-05-06 07:08:09") == "2024-05-06 07:08:09" and one(lambda t: text.time_text(t.cast("timestamp")), None) == "unknown time"
    assert one(text.chunk_text, "f.py", 3, 9, "body") == "// f.py:3-9\nbody"
    assert one(text.dashed_repository, "a/b.c_d-e") == "a-b-c_d-e"
    assert [one(text.int_id, x) for x in (" 7 ", "x", "7.5", "99999999999")] == [7, None, None, None]
    bodies = ['{"n":3}', '{"n":"4"}', '{"n":true}', '{"n":1.5}', '{"n":"x"}', "{}"]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", requests.coerced_int(F.col("b"), "n").alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [3, 4, None, None, None, None]
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("z")
    assert sorted(r["text"] for r in readers.whole_texts(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()) == ["x\ny\n", "z"]
    held = spark.createDataFrame([(5,), (None,), (7,)], "snapshot_bytes long")
    assert manifest.resident_bytes(held).first()["bytes"] == 12 and manifest.resident_bytes(held.limit(0)).first()["bytes"] == 0
    hits, chunks = spark.createDataFrame([(1, "a"), (2, "?")], "rank int, chunk_id string"), spark.createDataFrame([("a", "f", 1), ("b", "g", 2)], "chunk_id string, file string, line int")
    assert [tuple(r) for r in fusion.located(hits, chunks).collect()] == [(1, "f", 1)]


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "t string, event_type string, value double").selectExpr("CAST(t AS timestamp) AS ts", "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = append.windowed_counts(spark, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("windowed").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_limits():
    assert schema.soft_limit(700) == 595 and schema.soft_limit(1) == 1
