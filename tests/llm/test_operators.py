"""The ten operators against brute force, exact round trips and held-out accuracy; and their odd cases."""

import base64
import collections
import functools
import hashlib
import html.parser
import itertools
import math
import pathlib
import random
import re
import statistics
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memlattice.llm import _shared, _text, graph, langid, lm_score, minhash, packing, piece_viterbi, quality, queries, spotsigs, tokens, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict() for r in df.collect()]


def held(doc_id, n, k):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % n == k


# --- the kit ---


def test_spans_and_hashes():
    texts = ["a b  c", "", None, "\n x", "é ü\tz ", "q" * 5_000_000, "last word"]
    for lo, hi, buf, offsets in _text.blocks(pa.array(texts), most=20):
        starts, ends, first = _text.spans(buf, offsets)
        h = _text.word_hashes(buf, starts, ends)
        for i in range(lo, hi):
            words = (texts[i] or "").encode().split()
            a, b = first[i - lo], first[i - lo + 1]
            assert [bytes(buf[s:e]) for s, e in zip(starts[a:b], ends[a:b], strict=True)] == words
            for w, x in zip(words, h[a:b], strict=True):
                alone = np.frombuffer(w, np.uint8)
                assert _text.word_hashes(alone, np.array([0]), np.array([len(alone)]))[0] == x


# --- 1 ---


def plain_base(t):
    words = WORD.findall(t or "")
    where = collections.defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality(spark, sf, documents, odd):
    for docs in (documents, odd):
        got = {(r["doc_id"], r["n_words"]): r for r in rows(quality.judged(docs))}
        for d in docs.collect():
            n = plain_base(d["text"])
            r = got[(d["doc_id"], n[0])]
            assert tuple(r[c] for c in quality._COUNTS) == n
            assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
            assert not (r["kept"] and r["base_failed"])
    kept = [r["kept"] for r in rows(quality.judged(documents)) if not r["base_failed"]]
    assert sum(kept) > 0.9 * len(kept)
    assert quality.judged(odd.limit(0)).count() == 0


def test_quality_rejects_planted_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng, junk = random.Random(3), []
    for lang in ("en", "de", "es", "fr"):
        plain = [r["text"] for r in docs.where((F.col("lang") == lang) & F.length("text").between(600, 6000)).orderBy("doc_id").limit(12).collect()]
        for i in range(8):
            words = plain[i].split()
            filled = " ".join(w + rng.choice(["***", "###", "%%%", "&&&"]) for w in words)
            garbled = "".join(rng.choice("qxzjkvwpbgfy") if c.isalpha() else c for c in plain[i])
            repeated = " ".join(words[:12] * 20)
            junk += [(-len(junk) - k, t, lang, name) for k, (name, t) in enumerate([("filled", filled), ("garbled", garbled), ("repeated", repeated)], 1)]
    told = spark.createDataFrame(junk, "doc_id long, text string, lang string, kind string")
    got = rows(quality.judged(docs.unionByName(told.drop("kind"))))
    kept = {r["doc_id"]: r["kept"] for r in got}
    for lang in ("en", "de", "es", "fr"):
        for kind in ("filled", "garbled", "repeated"):
            out = [not kept[i] for i, _, g, k in junk if (g, k) == (lang, kind)]
            assert sum(out) >= 6, (lang, kind, sum(out))
    plain = [r["kept"] for r in got if r["doc_id"] > 0 and not r["base_failed"]]
    assert sum(plain) > 0.9 * len(plain)


def one_language(text):
    """(alphabet, codes) of a text under an alphabet of its own letters."""
    letters = [c for c, _ in collections.Counter(c for c in text.lower() if c.isalpha()).most_common(quality.OWN)]
    alphabet = np.zeros((1, 1 << 16), np.uint8) + quality._SIGN
    alphabet[0, [ord(c) for c in letters]] = quality._LETTERS + np.arange(len(letters))
    alphabet[0, 32] = 0
    raw = text.lower().encode()
    return alphabet, quality._codes(alphabet, np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


@pytest.mark.parametrize("letters", ["abc d", "абв г", "漢字仮 名"])
def test_kneser_ney_sums_to_one(letters):
    rng = np.random.default_rng(1)
    alphabet, codes = one_language("".join(rng.choice(list(letters), 4000)))
    code, n = np.unique(codes, return_counts=True)
    m = quality.kneser_ney(["x"], alphabet, np.zeros(len(code), np.int64), code, n)
    for context in (code[5] >> 5, np.uint32(7 << 10 | 9 << 5 | 3)):
        every = np.array([(int(context) << 5 | s) & 0xFFFFF for s in range(32)], np.uint32)
        assert (10 ** m.log10(np.zeros(32, np.int64), every)).sum() == pytest.approx(1, abs=1e-5)


def plain_symbols(text, own):
    out = []
    for c in text or "":
        kind, low = unicodedata.category(c)[0], c.lower()
        low = low if len(low) == 1 else c
        if kind in "LM":
            out.append(3 + own.index(low) if low in own else 3 + (ord(low) * 0x9E3779B1 % 2**32 >> 16) % 29)
        else:
            out.append(0 if kind == "Z" or c.isspace() else 1 if kind == "N" else 2)
    return out


def plain_model(texts):
    """A function from four symbols to the log10 probability of the last, by modified Kneser-Ney."""
    counts = {4: collections.Counter(tuple(([0, 0, 0] + s)[i : i + 4]) for s in texts for i in range(len(s)))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    counts[1].update({(x,): 0 for x in range(32)})
    parts = {}
    for k, c in counts.items():
        ones, twos, threes, fours = [max(1, sum(v == j for v in c.values())) for j in (1, 2, 3, 4)]
        y = ones / (ones + 2 * twos)
        d = [min(hi, max(0.1, x)) for x, hi in ((1 - 2 * y * twos / ones, 0.9), (2 - 3 * y * threes / twos, 1.8), (3 - 4 * y * fours / threes, 2.7))]
        total, mass = collections.Counter(), collections.Counter()
        for g, v in c.items():
            cut = min(v, d[0] if v == 1 else d[1] if v == 2 else d[2])
            total[g[:-1]] += v
            mass[g[:-1]] += cut
        parts[k] = (d, total, mass)

    @functools.cache
    def p(g):
        if not g:
            return 1 / 32
        d, total, mass = parts[len(g)]
        v = counts[len(g)].get(g, 0)
        if not total[g[:-1]]:
            return p(g[1:])
        cut = min(v, d[0] if v == 1 else d[1] if v == 2 else d[2])
        return (v - cut) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p(g[1:])

    return lambda g: math.log10(p(g))


def test_perplexity_and_bands(spark, documents):
    docs = documents.select("doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in rows(quality.judged(docs))}
    texts = docs.collect()
    for lang in {r["lang"] for r in texts}:
        mine = [r for r in texts if r["lang"] == lang]
        n = collections.Counter(c.lower() if len(c.lower()) == 1 else c for r in mine for c in r["text"] or "" if unicodedata.category(c)[0] in "LM")
        own = sorted(n, key=lambda c: (-n[c], c))[: quality.OWN]
        symbols = {r["doc_id"]: plain_symbols(r["text"], own) for r in mine}
        log10 = plain_model(symbols.values())
        for i, s in symbols.items():
            if got[i]["log10_perplexity"] is None:
                assert not got[i]["n_words"]
                continue
            want = -sum(log10(tuple(([0, 0, 0] + s)[k : k + 4])) for k in range(len(s))) / len(s)
            assert got[i]["log10_perplexity"] == pytest.approx(want, abs=2e-5)
        passed = [got[i] for i in symbols if not got[i]["base_failed"]]
        median = lambda xs, cell: (math.floor(statistics.median_low(xs) / cell) + 0.5) * cell if xs else 0.0
        middle = median([r["log10_perplexity"] for r in passed], quality.CELL)
        root = lambda r: math.sqrt(r["word_chars"] + r["n_words"])
        below = max(median([(middle - r["log10_perplexity"]) * root(r) for r in passed if r["log10_perplexity"] < middle], quality.ROOT_CELL), quality.ROOT_CELL / 2)
        above = max(median([r["log10_perplexity"] - middle for r in passed if r["log10_perplexity"] > middle], quality.CELL), quality.CELL / 2)
        for r in passed:
            assert r["upper"] == pytest.approx(middle + quality.UPPER * above)
            assert r["lower"] == pytest.approx(middle - quality.LOWER * below / root(r))
            assert r["kept"] == (r["lower"] <= r["log10_perplexity"] <= r["upper"])


def test_quality_sees_other_scripts(spark):
    rnd = random.Random(12)
    cases = {"ru": "абвгдежзиклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里"}
    docs, planted = [], []
    for g, letters in cases.items():
        parts = ["".join(rnd.choice(letters) for _ in range(2)) for _ in range(25)]
        for k in range(80):
            text = " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(120))
            docs.append((len(docs), text, g))
        for k in range(6):
            text = " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(120))
            planted.append((-1 - len(planted), text, g))
    got = {r["doc_id"]: r["kept"] for r in rows(quality.judged(spark.createDataFrame(docs + planted, "doc_id long, text string, lang string")))}
    assert not any(got[i] for i, _, _ in planted)
    assert sum(got[i] for i, _, _ in docs) > 0.95 * len(docs)


# --- 2 ---


def plain_components(texts, words, percent=80):
    """component of each (id, text) index by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return sets, [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(documents, odd, words):
    for docs in (documents, odd):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        sets, roots = plain_components(texts, words)
        want = collections.Counter()
        for (i, _), s, r in zip(texts, sets, roots, strict=True):
            ids = [x for (x, _), q in zip(texts, roots, strict=True) if q == r and x is not None]
            least = min(ids) if ids and s else i
            want[(i, len(s), least, i is not None and i == least)] += 1
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(minhash.near_duplicates(docs, words)))
        assert got == want
        one = minhash.deduplicated(docs, words)
        assert one.columns == docs.columns
        empty = sum(1 for s in sets if not s)
        assert one.count() == len({r for r, s in zip(roots, sets, strict=True) if s}) + empty
    assert minhash.near_duplicates(odd.limit(0), words).count() == 0


def test_chains_of_links(spark):
    """Each text is near the next only; and the star centre of a bucket need not be near all of it."""
    base = [f"w{i}" for i in range(40)]
    texts = [(k, " ".join(base[3 * k :] + [f"v{i}" for i in range(3 * k)])) for k in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    _, roots = plain_components(texts, 2)
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, 2))}
    assert [got[k] for k in range(8)] == roots


def passage_texts(n=70, seed=4):
    """Texts around one passage, with sets at similarities on either side of 0.8, and a few groups of near copies."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"q{rnd.randint(0, 25)}" for _ in range(rnd.randint(4, 14))] for _ in range(n)]
    copies = [f"c{i}" for i in range(80)]
    texts += [copies[:k] + ["x"] + copies[k:] for k in range(0, 80, 2)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_blocks_leave_no_link_out(spark, monkeypatch):
    docs = spark.createDataFrame(passage_texts(), "doc_id long, text string")
    _, roots = plain_components(passage_texts(), 2)
    for block in (1 << 20, 9_000, 3_000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(docs, 2))}
        assert [got[k] for k in range(len(roots))] == roots


@pytest.mark.parametrize("few", [600_000, 3, 0])
def test_classes_beyond_memory_are_joined(spark, odd, monkeypatch, few):
    """The same with marks, of which nearly all are set, and joins; rows of an id and a text are repeated."""
    docs = spark.createDataFrame(passage_texts() * 2, "doc_id long, text string").repartition(5)
    _, roots = plain_components(passage_texts(), 2)
    monkeypatch.setattr(minhash, "IN_MEMORY", few)
    monkeypatch.setattr(minhash, "MARKS", 8)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in rows(minhash.near_duplicates(docs, 2)))
    assert got == {(k, r): 2 for k, r in enumerate(roots)}
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {(r["doc_id"], r["component_id"]) for r in rows(minhash.near_duplicates(odd, 2))}
    assert {(1, 1), (2, 1), (13, 1), (6, 6), (7, 6), (3, 3), (None, None)} <= got and len(got) == len(set(i for i, _ in texts))


def test_sets_are_shuffled_once(spark, monkeypatch):
    """Whatever Spark would broadcast by itself: sets go to disk where texts are read, and from there to the comparisons."""
    plans = collections.defaultdict(list)

    def noted(df, label):
        plans[label].append(df._jdf.queryExecution().executedPlan().toString())
        return _shared.written(df, label)

    monkeypatch.setattr(minhash, "written", noted)
    monkeypatch.setattr(minhash, "BLOCK", 3_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        minhash.near_duplicates(spark.createDataFrame(passage_texts(), "doc_id long, text string"), 2).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans["linked"]) == 2
    for plan, most in [(plans["sets"][0], 0), *[(x, 1) for x in plans["linked"]]]:
        assert plan.count("Exchange hashpartitioning") <= most, plan


def test_forest():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    sets += [np.sort(rng.integers(0, 2**63, 9_000).astype(np.uint64))] * 2
    label = minhash.forest(sets, 60, columns=16)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(x & y) >= 60 * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert label.tolist() == [root(i) for i in range(len(sets))]


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "keep"), (2, "a b c d e f", "keep"), (3, "x", "keep")], "doc_id long, text string, nodekey string")
    got = rows(minhash.deduplicated(docs))
    assert sorted((r["doc_id"], r["nodekey"]) for r in got) == [(1, "keep"), (3, "keep")]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["root"] for r in rows(graph.components(spark.createDataFrame(links, "a long, b long")))}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert all(got.get(x, x) == root(x) for x in parent)


def test_few_links_take_few_tables(spark, monkeypatch):
    """The driver's work for few links doesn't grow with their chains; beyond the bound, stars give the same."""
    chain = [(i, i + 1) for i in range(0, 400, 2)] + [(i + 1, i + 2) for i in range(398, -1, -2)] + [(1000, -5), (7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "a long, b long")
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, label: tables.append(label) or _shared.written(df, label))
    got = {r["node"]: r["root"] for r in rows(graph.components(links))}
    assert got == {i: 0 for i in range(1, 401)} | {1000: -5}
    assert len(tables) == 2
    assert rows(graph.components(links.limit(0))) == []
    monkeypatch.setattr(graph, "ALONE", 0)
    assert {r["node"]: r["root"] for r in rows(graph.components(links))} == got
    assert len(tables) > 8


def test_reachable_by_hand():
    nodes, roots = graph.reachable(np.array([9, 9, 9, 4, -3]), np.array([1, 2, 3, 5, 4]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {-3: -3, 1: 1, 2: 1, 3: 1, 4: -3, 5: -3, 9: 1}
    rng = np.random.default_rng(6)
    order = rng.permutation(20_000)
    nodes, roots = graph.reachable(order[:-1], order[1:])
    assert nodes.tolist() == list(range(20_000)) and not roots.any()


def test_circulant_signature():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = minhash.signature(x[:900], 2000), minhash.signature(x[100:], 2000)
    assert abs((a == b).mean() - 0.8) < 0.05


# --- 3 ---


def full_viterbi(p, s):
    best = [(0.0, [])] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - p.longest), e):
            node = p.trie
            for c in s[b:e]:
                node = node.get(c) if node else None
            if node and "" in node and (best[e] is None or best[b][0] + node[""][1] > best[e][0]):
                best[e] = (best[b][0] + node[""][1], best[b][1] + [node[""][0]])
        if "" not in p.trie.get(s[e - 1], {}) and (best[e] is None or best[e - 1][0] + p.unknown > best[e][0]):
            best[e] = (best[e - 1][0] + p.unknown, best[e - 1][1] + p.of_unknown(s[e - 1]))
    return best[-1][1]


def test_streaming_viterbi():
    p = piece_viterbi.codec(PIECES).pieces
    rnd = random.Random(3)
    for _ in range(300):
        s = "▁" + "".join(rnd.choice("aabthe▁▁re\n\r;in é☃𓀀\tx") for _ in range(rnd.randint(1, 60)))
        run, got = piece_viterbi.StreamingViterbi(p), []
        for k in range(0, len(s), 7):
            got += run.feed(s[k : k + 7])
            assert len(run.text) <= 7 + 3 * p.longest
        assert got + run.finish() == full_viterbi(p, s)


@pytest.mark.parametrize("fitted", [False, True])
def test_pieces_round_trip(spark, documents, odd, fitted):
    scores = piece_viterbi.fit(documents, PIECES) if fitted else None
    p = piece_viterbi.codec(PIECES, scores).pieces
    for docs in (documents, odd):
        for d in docs.join(piece_viterbi.encoded(docs.dropDuplicates(["doc_id"]), PIECES, scores=scores), "doc_id").collect():
            assert d["decoded"] == (d["text"] or "")
            ids = np.frombuffer(d["ids"], "<u2").tolist()
            assert d["n_ids"] == len(ids)
            if d["text"] and len(d["text"]) < 800:
                assert ids == full_viterbi(p, "▁" + d["text"].replace(" ", "▁"))
    assert piece_viterbi.encoded(odd.limit(0), PIECES).count() == 0


def test_piece_scores(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [r["text"] or "" for r in documents.collect()]
    want = np.bincount([i for t in texts for i in sp.encode(t)], minlength=sp.get_piece_size()) + 0.5
    got = np.exp(np.frombuffer(piece_viterbi.fit(documents, PIECES), "<f4"))
    assert got.sum() == pytest.approx(1, abs=1e-4) and np.abs(got - want / want.sum()).sum() < 0.01
    none = np.frombuffer(piece_viterbi.fit(documents.limit(0), PIECES), "<f4")
    assert np.ptp(none) == 0

    def borders(pieces, ids):
        return set(np.cumsum([len(pieces.raw[i]) for i in ids]).tolist())

    shares = []
    for scores in (None, piece_viterbi.fit(documents, PIECES)):
        c, both, either = piece_viterbi.codec(PIECES, scores), 0, 0
        for t in texts:
            x, y = borders(c.pieces, sp.encode(t)), borders(c.pieces, c.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist())
            both, either = both + len(x & y), either + len(x | y)
        shares.append(both / either)
    assert shares[1] > 0.8 > shares[0]


def test_long_stretches_are_searched_in_portions(monkeypatch):
    c = piece_viterbi.codec(PIECES)
    text = "abcthere" * 3_000
    whole = full_viterbi(c.pieces, text[:2_000])
    monkeypatch.setattr(piece_viterbi, "PORTION", 100)
    assert c.search(text[:2_000]) == whole
    widest = []
    monkeypatch.setattr(piece_viterbi.StreamingViterbi, "_drop", lambda self, upto, drop=piece_viterbi.StreamingViterbi._drop: (drop(self, upto), widest.append(len(self.text))))
    c.search(text)
    assert max(widest) <= 100 + 3 * c.pieces.longest


# --- 4 ---


def test_stretches_end_where_no_piece_goes_on():
    """Words and what follows them are searched once each, not in every pairing; ids are those of a search of the whole text."""
    p = piece_viterbi.Codec(PIECES)
    words, tails = ["house", "garden", "Stra\u00dfe", "\u6f22\u5b57", "x\u2581 \u2581y"], ["0", "12", "345;", ")!", "\t", "\n \u2581", "\U0001f600", "  "]
    texts = [f"{w}{t} {w} {t}{w}" for w in words for t in tails]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, first = p.encode(buf, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    for t, i, j in zip(texts, first[:-1], first[1:], strict=True):
        whole = p.search(piece_viterbi.BLANK * p.pieces.dummy + t)
        score = lambda ids: sum(scores.get(x, p.pieces.unknown) for x in ids)
        scores = {}
        stack = [p.pieces.trie]
        while stack:
            for k, v in stack.pop().items():
                if k == "":
                    scores[v[0]] = v[1]
                else:
                    stack.append(v)
        assert ids[i:j].tolist() == whole or score(ids[i:j].tolist()) == pytest.approx(score(whole))
        assert p.decode(ids[i:j].tolist()).decode() == t.replace(piece_viterbi.BLANK, " ")
    digits = [f"{w}{k}" for w in ("house", "garden", "river") for k in range(1000)]
    p.cache.clear()
    p.encode(np.frombuffer(" ".join(digits).encode(), np.uint8), np.array([0, len(" ".join(digits))]))
    assert len(p.cache.keys) < 50  # before: one for each of 3,000 words


def test_pieces_of_texts_without_any():
    ids, first = piece_viterbi.codec(PIECES).encode(np.zeros(0, np.uint8), np.array([0, 0, 0]))
    assert len(ids) == 0 and first.tolist() == [0, 0, 0]


def test_lm_scores(spark, sf, documents):
    got = rows(queries.op4_attention_lm(spark, sf))
    texts = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOWER)) + [None] for r in documents.collect()}
    c = collections.Counter()
    for i, w in texts.items():
        if not held(i, 5, 1):
            c.update(w)
    total, kinds = sum(c.values()), len(c)
    for r in got:
        w = texts[r["doc_id"]]
        base = sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), total, held(r["doc_id"], 5, 1))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def plain_attention(m, own):
    """log10 probability of a text's classes, position by position."""
    w, total = m.w, 0.0
    e = w["emb"][[lm_score.CLASSES, *own[:-1]]].astype(float)
    for t in range(len(own)):
        low = max(0, t // lm_score.BLOCK * lm_score.BLOCK - lm_score.BLOCK)
        s = np.array([e[t] @ w["q"] @ (e[j] @ w["k"]) * lm_score.DIM**-0.5 + w["near"][t - j] for j in range(low, t + 1)])
        a = np.exp(s - s.max())
        z = (e[t] + (a / a.sum()) @ (e[low : t + 1] @ w["v"]) @ w["o"]) @ w["out"] + w["bias"]
        total += z[own[t]] - z.max() - np.log(np.exp(z - z.max()).sum())
    return total / math.log(10)


def test_lm_score_by_hand(spark, documents):
    """A text's score is that of its words' classes by attention, and of each word in its class by counts."""
    model, vocabulary = lm_score.fit(documents, ~queries.fold(5, 1), BPE)
    got = {r["doc_id"]: r["score"] for r in rows(lm_score.scored(documents, model, vocabulary))}
    t = Tokenizer.from_file(BPE)
    texts = {r["doc_id"]: WORD.findall((r["text"] or "").translate(LOWER)) for r in documents.collect()}
    first = {w: (t.encode(w, add_special_tokens=False).ids or [0])[0] for ws in texts.values() for w in ws}
    c = collections.Counter(w for i, ws in texts.items() if not held(i, 5, 1) for w in ws)
    n = collections.Counter(i for i in c.elements() for i in [first[i]])
    order = sorted(n, key=lambda i: (-n[i], i))
    cls = {i: k if k < lm_score.OWN else lm_score.OWN + k % 16 for k, i in enumerate(order)}
    cls |= {i: lm_score.OWN + i % 16 for i in set(first.values()) - set(cls)}
    end = lm_score.CLASSES - 1
    size, kinds = collections.Counter(), collections.Counter()
    for w, k in c.items():
        size[cls[first[w]]] += k
        kinds[cls[first[w]]] += 1
    size[end], kinds[end] = sum(not held(i, 5, 1) for i in texts), 1
    for i, ws in texts.items():
        if len(ws) > 200:
            continue
        own = [cls[first[w]] for w in ws] + [end]
        counts = [c[w] for w in ws] + [size[end]]
        within = sum(math.log10((k + 0.5) / (size[x] + 0.5 * (kinds[x] + 1))) for k, x in zip(counts, own, strict=True))
        assert got[i] == pytest.approx(plain_attention(model.attention, own) + within, rel=1e-4)


def test_rare_words_are_joined(spark, sf, documents, monkeypatch):
    whole = {r["doc_id"]: r for r in rows(queries.op4_attention_lm(spark, sf))}
    monkeypatch.setattr(lm_score, "HEAD", 500)
    for r in rows(queries.op4_attention_lm(spark, sf)):
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9) and r["n_known"] == whole[r["doc_id"]]["n_known"]


def test_attention_learns_from_texts_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SAMPLE", 0)
    docs = spark.createDataFrame([(i, "one two three four " * 40) for i in range(6_000)], "doc_id long, text string").coalesce(1)
    model, _ = lm_score.fit(docs, F.lit(True), BPE)
    fresh = lm_score.Attention.fresh(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    fresh.w["bias"] = model.attention.w["bias"]
    words = [x.encode() for x in ("one two three four " * 10).split()]
    classes = np.append(model.of_id[lm_score.first_ids(BPE, words)], lm_score.CLASSES - 1).astype(np.int16)
    score = [lm_score.log10_classes(m, classes, np.array([0, len(classes)]))[0] for m in (model.attention, fresh)]
    assert score[0] > score[1] + 5


def test_windows_score_each_token_once():
    rng = np.random.default_rng(4)
    m = lm_score.Attention.fresh(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    m.w["near"] = rng.normal(0, 0.5, len(m.w["near"])).astype(np.float32)
    sizes = [1, 31, 32, 33, 200]
    classes, first = rng.integers(0, lm_score.CLASSES, sum(sizes)).astype(np.int16), np.concatenate([[0], np.cumsum(sizes)])
    got = lm_score.log10_classes(m, classes, first, rows=3)
    w = m.w
    for i, n in enumerate(sizes):
        own, total = classes[first[i] : first[i + 1]].astype(int), 0.0
        e = w["emb"][[lm_score.CLASSES, *own[:-1]]].astype(float)
        for t in range(n):
            low = max(0, t // lm_score.BLOCK * lm_score.BLOCK - lm_score.BLOCK)
            s = np.array([e[t] @ w["q"] @ (e[j] @ w["k"]) * lm_score.DIM**-0.5 + w["near"][t - j] for j in range(low, t + 1)])
            a = np.exp(s - s.max())
            h = e[t] + (a / a.sum()) @ (e[low : t + 1] @ w["v"]) @ w["o"]
            z = h @ w["out"] + w["bias"]
            total += z[own[t]] - z.max() - np.log(np.exp(z - z.max()).sum())
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-4)


def test_attention_gradients():
    rng = np.random.default_rng(6)
    m = lm_score.Attention.fresh(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, pad, target, _ = lm_score.laid_out(rng.integers(0, lm_score.CLASSES, 70).astype(np.int16), np.array([0, 40, 70]))
    t = np.maximum(target[1:], 0)[:, :, None].astype(np.int64)

    def loss():
        z, kept = m.forward(x, pad)
        z = z - z.max(2, keepdims=True)
        lp = z - np.log(np.exp(z).sum(2, keepdims=True))
        return -(np.take_along_axis(lp, t, 2)[:, :, 0] * (target[1:] >= 0)).sum(), lp, kept

    _, lp, kept = loss()
    d = np.exp(lp)
    np.put_along_axis(d, t, np.take_along_axis(d, t, 2) - 1, 2)
    g = m.backward(d * (target[1:] >= 0)[:, :, None], kept)
    for k in m.w:
        flat = m.w[k].reshape(-1)
        for i in rng.choice(len(flat), 3):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()[0]
            flat[i] = keep - 1e-5
            down = loss()[0]
            flat[i] = keep
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=2e-3), k


def test_attention_of_wanted_positions():
    """Logits and gradients of some positions are those of all, with padding and the other positions left out."""
    rng = np.random.default_rng(9)
    m = lm_score.Attention.fresh(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    x, pad, target, _ = lm_score.laid_out(rng.integers(0, lm_score.CLASSES, 100).astype(np.int16), np.array([0, 1, 65, 100]))
    wanted = np.flatnonzero(target[1:].ravel() >= 0)
    every, kept = m.forward(x, pad)
    some, kept_some = m.forward(x, pad, wanted)
    assert len(some) == 100 and np.allclose(some, every.reshape(-1, lm_score.CLASSES)[wanted], atol=1e-5)
    d = np.zeros_like(every)
    d.reshape(-1, lm_score.CLASSES)[wanted] = part = rng.normal(size=some.shape).astype(np.float32)
    whole, own = m.backward(d, kept), m.backward(part, kept_some)
    assert all(np.allclose(whole[k], own[k], rtol=1e-3, atol=1e-3) for k in m.w)


@pytest.mark.parametrize("by", [1, 60, 300])
def test_exponentials_of_any_size(by):
    z = np.random.default_rng(3).normal(size=(4, 5, 128)) * by
    y, total, c = lm_score._exp(z.astype(np.float32))
    want = z - z.max(2, keepdims=True)
    want -= np.log(np.exp(want).sum(2, keepdims=True))
    got = z.max(2, keepdims=True) - c - np.log(total)
    assert np.isfinite(y).all() and got == pytest.approx(want.max(2, keepdims=True), abs=1e-2)


def test_a_task_hands_on_each_word_once():
    hashes = np.array([5, 7, 5 + (9 << 44), 7, 5, 6 + (9 << 44), 6 + (9 << 44)], np.uint64)
    one, of = lm_score._distinct(hashes)
    assert sorted(hashes[one].tolist()) == sorted(set(hashes.tolist())) and (hashes[one][of] == hashes).all()
    told, texts = lm_score._Counts(), ["a b a \u00e9", "B c", "", "a \u00e9 c c"]
    for t in texts:
        buf = np.frombuffer(t.encode(), np.uint8)
        told.add(*lm_score._lower_words(buf, np.array([0, len(buf)]))[:3])
    got = [x for b in told.taken(2) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(got) == sorted((w.encode(), n) for w, n in {"a": 3, "b": 2, "\u00e9": 2, "c": 3}.items())
    assert list(told.taken()) == []


def test_lm_odd(spark, odd):
    for docs, learn in ((odd, F.lit(True)), (odd, F.lit(False)), (odd.limit(0), F.lit(True))):
        model, vocabulary = lm_score.fit(docs, learn, BPE)
        got = rows(lm_score.scored(docs, model, vocabulary))
        assert len(got) == docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


# --- 5 ---


def check_packing(docs, got, window=4096):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = collections.Counter()
    for (i, s), times in texts.items():
        want[(i, np.array([*t.encode(s, add_special_tokens=False).ids, 2], "<u4").tobytes())] += times
    ids = [(k, v) for k, v in want.items()]
    size = collections.Counter()
    for r in got:
        assert r["length"] * 4 == len(r["ids"])
        assert any(k[0] == r["doc_id"] and k[1][4 * r["start"] : 4 * (r["start"] + r["length"])] == r["ids"] and len(k[1]) == 4 * r["doc_tokens"] for k, _ in ids)
        size[(r["doc_id"])] += r["length"]
    for i in size:
        assert size[i] == sum(len(k[1]) // 4 * v for k, v in ids if k[0] == i)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


def test_packing(documents, odd):
    for docs in (documents, odd):
        check_packing(docs, rows(packing.packed(docs, BPE)))
    assert packing.packed(odd.limit(0), BPE).count() == 0


def test_nnls():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a = np.abs(rng.normal(size=(12, 40)))
        x = np.where(rng.random(40) < 0.2, rng.random(40), 0)
        b = a @ x
        got = packing.nnls(a, b)
        assert (got >= 0).all() and np.linalg.norm(a @ got - b) < 1e-4 * np.linalg.norm(b)
    columns = packing.combinations(64)
    assert (np.arange(1, 64) @ columns == 64).all()
    histogram = np.concatenate([[5], rng.integers(0, 400, 63)])
    plan = packing.plan_for(histogram, 3, 1000)
    assert (plan.taken <= histogram).all() and (plan.taken * np.arange(64)).sum() == 64 * plan.combined
    assert plan.combined > 0.8 * (histogram * np.arange(64)).sum() / 64


def test_tokens_equal_the_tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("aBé ñ.,!'sdon’t <|endoftext|> 12\n\t&İΣß́x☃") for _ in range(rnd.randint(0, 80))) for _ in range(800)]
    for lo, hi, buf, offsets in _text.blocks(pa.array(texts)):
        ids, first = tokens.encoder(BPE).encode(buf, offsets)
        for i in range(lo, hi):
            assert ids[first[i - lo] : first[i - lo + 1]].tolist() == t.encode(texts[i], add_special_tokens=False).ids, texts[i]


def test_first_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aBéthe.,'s-dn’t<|1&İΣß́x☃") for _ in range(rnd.randint(1, 12))) for _ in range(3_000)] + ["don't", "word,", "Wordé", "é", "a\u0301b"]
    got = tokens.encoder(BPE).first_ids([w.encode() for w in words])
    assert got == [(t.encode(w, add_special_tokens=False).ids or [0])[0] for w in words]


# --- 6 ---


def test_language(spark, sf, documents, odd):
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    out = [r for r in rows(queries.op6_language_id(spark, sf)) if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.9 * len(out)
    got = rows(langid.identify(odd, langid.fit(odd, F.lit(True))))
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1 and (letters or r["lang_rejected"])
    none = rows(langid.identify(odd, langid.fit(odd, F.lit(False))))
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(odd.limit(0), None).count() == 0


def plain_language(model, text):
    folded = b" " + bytes(int(langid._FOLD[b]) for b in text.encode()) + b" "
    total, support, n = np.zeros(len(model.languages)), 0.0, 0
    for size in langid.SIZES:
        for i in range(len(folded) - size + 1):
            g = folded[i : i + size]
            if b" " in g[1:-1] or g == b"  ":
                continue
            h = g[0]
            for b in g[1:]:
                h = h * 0x01000193 % 2**32 ^ b
            bucket = (h ^ size * 0x9E3779B1 % 2**32) * 0x85EBCA6B % 2**32 >> 32 - langid.BITS
            total, support, n = total + model.scores[bucket], support + model.support[bucket], n + 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    best = int(p.argmax())
    return model.languages[best], p[best], bool(p[best] < model.threshold or support / max(n, 1) < model.least)


def test_language_by_hand(spark, documents, odd):
    model = langid.fit(documents, F.lit(True))
    for docs in (documents, odd.where("length(text) < 1000")):
        for r in rows(langid.identify(docs, model)):
            if any(c.isalpha() for c in r["text"] or "") and len(r["text"]) < 3_000:
                lang, score, rejected = plain_language(model, r["text"])
                assert r["lang_pred"] == lang and r["lang_score"] == pytest.approx(score, rel=1e-4) and r["lang_rejected"] == rejected
    seven = langid.fit(documents.repartition(7), F.lit(True))
    assert np.array_equal(model.scores, seven.scores) and (model.threshold, model.least) == (seven.threshold, seven.least)


def test_rare_languages_are_drawn_and_copies_are_not(spark):
    copies = [("copied text", "xx")] * 3_000
    docs = spark.createDataFrame(copies + [(f"many words {i}", "en") for i in range(3_000)] + [(f"few {i}", "qq") for i in range(3)], "text string, lang string")
    got = collections.Counter(langid.sample(docs, F.lit(True), "lang", 300).column(1).to_pylist())
    assert got["qq"] == 3 and got["xx"] == 1 and 250 <= got["en"] <= 300


def test_a_language_left_out_of_training_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 40").select("doc_id", "text", "lang")
    model = langid.fit(docs, F.col("lang") != "en", most=900)
    share = {r["lang"]: r["x"] for r in langid.identify(docs, model).groupBy("lang").agg(F.avg(F.col("lang_rejected").cast("int")).alias("x")).collect()}
    assert share["en"] > 0.8 and max(share[k] for k in ("de", "es", "fr")) < 0.01


# --- 7 ---


def test_warc_round_trip():
    page = "<html><head><title> A &amp; B</title><style>p{}</style></head><body><p>One <b>two</b><br>three<!-- no --><script>x</script><a href='/u?a=1&amp;b=2'>link</a></p></body>"
    headers, block = warc.response_of("7", "http://example.org/x", page)
    (back, again), = warc.read_records(warc.serialized(headers, block))
    assert again == block and back == {k: v for k, v in headers.items() if v}
    assert warc.split_http(block)[2].decode() == page
    (mh, about), (ch, text) = warc.derived(headers, block)
    assert text.decode() == "One two\nthree link"
    assert {mh["WARC-Refers-To"], ch["WARC-Refers-To"]} == {headers["WARC-Record-ID"]} and mh["WARC-Record-ID"] != ch["WARC-Record-ID"]
    assert b"title: A & B\r\n" in about and b"outlink: /u?a=1&b=2\r\n" in about and headers["WARC-Payload-Digest"].encode() in about
    assert ch["WARC-Block-Digest"] == warc.digest(text) and ch["WARC-Target-URI"] == "http://example.org/x"
    both = b"".join(warc.serialized(h, b, compress=True) for h, b in [(headers, block), (mh, about), (ch, text)])
    assert [b for _, b in warc.read_records(both)] == [block, about, text]


class PlainPage(html.parser.HTMLParser):
    """Text, title and links of a well-formed page, by the standard library's parser."""

    HIDDEN = {"head", "script", "style", "noscript", "template"}
    BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title, self.links = [], 0, "", False, []
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(self.out).split("\0")) if x)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.in_title = tag == "title"
        self.out += ["\0"] * (tag in self.BLOCKS)
        if tag == "a" and dict(attrs).get("href") is not None and dict(attrs)["href"] not in self.links:
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        self.in_title = False
        self.out += ["\0"] * (tag in self.BLOCKS)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.out.append(data)


def sha(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_warc_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = collections.defaultdict(dict)
    for r in rows(queries.op7_warc_derivatives(spark, sf)):
        assert got[r["page_id"]].setdefault(r["record_type"], r) is r
    assert len(got) == pages.count() and len({x["record_id"] for r in got.values() for x in r.values()}) == 2 * len(got)
    assert len({r["metadata"]["refers_to"] for r in got.values()}) == len(got)
    for p in pages.collect():
        payload = (p["html"] or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        plain, about, text = PlainPage(p["html"] or ""), got[p["page_id"]]["metadata"], got[p["page_id"]]["conversion"]
        fields = [("title", " ".join(plain.title.split())), ("http-status", "200 OK"), ("http-header-content-type", "text/html; charset=utf-8"), ("http-header-content-length", str(len(payload)))]
        fields += [("source-payload-digest", sha(payload)), ("source-block-digest", sha(block)), ("text-digest", sha(plain.text.encode()))] + [("outlink", x) for x in plain.links]
        want = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
        assert text["text"] == plain.text and (text["block_digest"], text["content_length"]) == (sha(plain.text.encode()), len(plain.text.encode()))
        assert (about["block_digest"], about["content_length"]) == (sha(want), len(want))
        assert about["refers_to"] == text["refers_to"] and {about["target_uri"], text["target_uri"]} == {p["url"]}
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "http://a/", "<p>x"), (2, "http://a/", "<p>x")], "page_id long, url string, html string").withColumn("block", F.lit(1))
    assert warc.derivatives(warc.responses(odd)).count() == 8
    assert warc.derivatives(warc.responses(odd.limit(0))).count() == 0


def test_warc_files(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(20)
    responses = warc.responses(pages)
    records = responses.unionByName(warc.derivatives(responses)).drop("page_id")
    files = warc.as_files(records, most=20_000).collect()
    assert len(files) > 1
    for f in files:
        (tmp_path / f"{f['part']}-{f['number']}.warc.gz").write_bytes(f["content"])
    again = warc.from_files(spark.read.format("binaryFile").load(str(tmp_path)))
    key = lambda df: sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=str)
    assert key(again) == key(records)
    assert again.where("refers_to_target_uri = target_uri and refers_to_date = date").count() == 40
    assert warc.as_files(records.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<a ", "<a href=", "<div ", "<script ", "<title ", "<!--", "<", "&#99999", "</script", "<a href='", '<p title="', "<head>", "<svg><title>"])
def test_warc_time_grows_with_the_length(part):
    page = part * (1_000_000 // len(part))
    begin = time.time()
    warc.derived(*warc.response_of("1", "u", page))
    warc.derived(*warc.response_of("1", "u", page + ">"))
    warc.derived(*warc.response_of("1", "u", "&#" + "9" * 10_000 + ";" + page.replace(" ", "> ")))
    assert time.time() - begin < 6


def test_warc_charset():
    page = "<p>Grüße</p>"
    block = warc.http_response(page.encode("latin-1"), {"Content-Type": "text/html; charset=ISO-8859-1"})
    (_, _), (_, text) = warc.derived({"WARC-Record-ID": "x"}, block)
    assert text.decode() == "Grüße"
    for said in ("no-such", "base64"):
        assert warc.decoded(page.encode(), [("Content-Type", f"text/html; charset={said}")]) == page


# --- 8 ---


def test_cascade_is_exact(spark, monkeypatch):
    keys = [f"k{i}" for i in range(5000)]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,), ("k1",)], "key string").withColumn("listed", F.lit(1))
    listed = url_filter.keys_of(spark, keys[::7] + ["absent"])
    cascade = url_filter.build_cascade(universe, listed, listed.count())
    assert len(cascade.levels) > 1
    got = {r["key"] for r in rows(universe.where(cascade.contains(F.col("key"))))}
    assert got == set(keys[::7])
    assert not url_filter.build_cascade(universe, listed.limit(0), 0).levels
    url_filter.build_cascade(universe.limit(0), url_filter.keys_of(spark, ["a"]), 1)
    for most in (10**6, 100):  # a longer list is joined
        monkeypatch.setattr(url_filter, "MAX_LISTED", most)
        told = rows(url_filter.with_membership(universe, "key", listed.unionAll(listed), "there"))
        assert len(told) == 5002 and all(r["there"] == (r["key"] in set(keys[::7])) and r["listed"] == 1 for r in told)


def test_url_rules(spark):
    urls = ["http://EXAMPLE.org/es/1", "https://a.example.org/en/12?x", "example.org/es/", None, "http://org", "x://b.com/fr/#", "x://com/de/1", "x://nocom/de/1", "ftp://example.org/fr/", "://", "http://example.org/es", "http://b.com/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    pages = pages.withColumns({c: F.lit("mine") for c in ("rule", "allow", "block", "_allow", "_block", "listed", "key")})
    got = sorted(rows(url_filter.judge_urls(pages, queries.URL_RULES)), key=lambda r: r["page_id"])
    want = ["example.org/es/", "example.org/en/1", None, None, None, "com/fr/", "com/de/", None, "org/", None, "org/", None, None]
    assert [r["rule"] for r in got] == want
    # com has one ruled page, which is blocked, so its other page goes with it; b.com has one that is allowed
    assert [r["verdict"] for r in got] == ["block", "block", "allow", "allow", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert all(r[c] == "mine" for r in got for c in ("allow", "block", "_allow", "_block", "listed", "key"))
    listed = url_filter.keys_of(spark, ["org", "b.com"])
    got = sorted(rows(url_filter.judge_urls(pages, queries.URL_RULES, listed)), key=lambda r: r["page_id"])
    assert [r["page_id"] for r in got if r["verdict"] == "block"] == [0, 1, 4, 6, 11]
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


# --- 9 ---


def test_toxicity(spark, documents, labels, odd):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))] for _ in range(900)]
    marks = [rnd.random() < 0.2 for _ in texts]
    for t, m in zip(texts, marks, strict=True):
        for _ in range(3 if m else 0):
            t[rnd.randrange(len(t))] = rnd.choice(["vilex", "nastor", "grubby"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, ~queries.fold(4, 2))
    out = [r for r in rows(toxicity.score(docs, model)) if held(r["doc_id"], 4, 2)]
    right = sum((r["toxic_score"] >= 0.3) == marks[r["doc_id"]] for r in out)
    assert right >= 0.95 * len(out)
    for d, k in ((odd, labels), (odd, labels.limit(0)), (odd.limit(0), labels), (odd, labels.where("toxic = 1"))):
        got = rows(toxicity.score(d, toxicity.fit(d, k, F.lit(True))))
        assert len(got) == d.count() and all(0 <= r["toxic_score"] <= 1 for r in got)


def test_class_models_sum_to_one():
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}word{i}" for i, (a, b) in enumerate(itertools.product("abcdef", "ghij"))]
    texts = [[" ".join(rnd.choices(vocabulary, range(1, len(vocabulary) + 1), k=300)) for _ in range(6)] for _ in range(2)]
    texts[0].append("rare once " + texts[0][0])
    uni, bi, stems = toxicity.fit_counts([pa.array(t) for t in texts])
    model = toxicity.Model(uni, bi, stems, np.zeros(3), 0.5)
    known = sorted({w for t in texts for x in t for w in x.split()})
    words = known + sorted({w[: toxicity.STEM] + "~" for w in known})  # one unseen word for each stem
    words = [w.replace("~", "zzz") for w in words]
    for before in (None, vocabulary[-1], "rare"):
        total = np.zeros(2)
        for w in words:
            raw = f"{before} {w}".encode() if before else w.encode()
            h, stem, first = toxicity._words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            total += [np.exp(x[-1]) for x in toxicity.log_likelihoods(model, h, stem, first)]
        assert total == pytest.approx([1, 1], abs=1e-4)


def test_toxicity_model_depends_on_no_partitioning(spark):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60))) for i in range(600)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    one, seven = (toxicity.fit(docs.repartition(n), known.repartition(n), F.lit(True), most=40) for n in (1, 7))
    assert np.array_equal(one.scale, seven.scale) and np.array_equal(one.unigrams.keys, seven.unigrams.keys)
    assert all(np.array_equal(one.bigrams.values[k], seven.bigrams.values[k]) for k in ("toxic", "ordinary"))


def test_toxicity_query_finds_held_out_texts(spark):
    got = {r["doc_id"]: r for r in rows(queries.op9_toxicity(spark, "/root/testdata/sf0.1"))}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").collect()}
    out = [(marks[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in marks]
    toxic = [p for m, p in out if m]
    assert sum(toxic) >= 0.75 * len(toxic)
    assert sum(p for m, p in out if not m) <= 0.03 * sum(not m for m, _ in out)


# --- 10 ---


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if not words:
        return set()
    stop, out = set(spotsigs.ANCHORS), set()
    content = [(i, w) for i, w in enumerate(words) if w not in stop]
    for i, w in enumerate(words):
        if w in stop and (i + 1 == len(words) or words[i + 1] not in stop):
            after = [x for j, x in content if j > i][: spotsigs.CHAIN]
            out.add((w, *after, *[""] * (spotsigs.CHAIN - len(after))))
    return out or {tuple(words)}


def test_signatures(spark, documents, odd):
    for docs in (documents, odd):
        got = docs.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect()
        for r in got:
            assert len(r["s"]) == len(plain_signatures(r["text"])), r["text"]
        for a, b in itertools.islice(itertools.combinations(got, 2), 200):
            x, y = plain_signatures(a["text"]), plain_signatures(b["text"])
            assert len(set(a["s"]) & set(b["s"])) == len(x & y)


def test_spotsigs_query(spark, documents, odd):
    for docs in (documents, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), odd.where("doc_id = 1")):
        texts = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        got = {r["doc_id"]: r for r in rows(spotsigs.edit_likeness(docs))}
        for k, (i, t) in enumerate(texts):
            after = texts[(k + 1) % len(texts)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            r, x = got[i], plain_signatures(t)
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            for column, other in (("near_edited", edited), ("near_next", after)):
                y = plain_signatures(other)
                assert r[column] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    assert spotsigs.edit_likeness(odd).count() == odd.count()
    assert spotsigs.edit_likeness(odd.limit(0)).count() == 0


def test_following_in_parts(spark):
    ids = sorted(random.Random(1).sample(range(10**6), 500))
    got = {r["bucket"]: r["next"] for r in rows(spotsigs._following(spark.createDataFrame([(i,) for i in ids], "bucket long"), width=1000, one_task=20))}
    assert [got[i] for i in ids] == [*ids[1:], None]


def test_spotsigs_pairs(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(["the", "of", "and"]) + f" c{rnd.randint(0, 60)} d{rnd.randint(0, 9)}" for _ in range(30)) for _ in range(12)]
    texts = base + [t.replace("c1 ", "c2 ", 1) for t in base] + base[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = spotsigs.similar_pairs(docs, 0.8)
    of = {r["id"]: r["class_id"] for r in rows(members)}
    want = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = plain_signatures(texts[a]), plain_signatures(texts[b])
        if of[a] != of[b] and len(x & y) >= 0.8 * len(x | y):
            want.add((min(of[a], of[b]), max(of[a], of[b])))
        assert (of[a] == of[b]) == (x == y)
    assert {(r["a"], r["b"]) for r in rows(pairs)} == want


# --- pipeline ---


def test_pipeline_filters_decide_by_their_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    every = ids(docs)
    kept = corpus_pipeline.language_id(spark, docs, sf)
    told = {r["doc_id"] for r in rows(langid.identify(docs, langid.fit(docs, F.lit(True)))) if not r["lang_rejected"]}
    assert ids(kept) == told and kept.columns == docs.columns
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert told <= letters and len(told) > 0.99 * len(letters)
    out = every - ids(corpus_pipeline.toxic(spark, docs, sf))
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    toxic, clean = {i for i, m in marks.items() if m and i in every}, {i for i, m in marks.items() if not m and i in every}
    assert len(out & toxic) > 0.85 * len(toxic) and len(out & clean) < 0.02 * len(clean)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    assert out == {r["doc_id"] for r in rows(toxicity.score(docs, model)) if r["toxic_score"] >= toxicity.THRESHOLD}


def test_scratch_tables_go(spark, documents):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    minhash.near_duplicates(documents, 2).count()
    new = {x.name.split("-")[0] for x in set(folder.iterdir()) - before}
    assert new <= {"signed", "classes", "blocks"}


def test_pipeline(spark, sf, odd, documents, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "packing"]
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for start, docs in enumerate((documents, odd)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{start}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            out = spark.read.parquet(path)
            if k < 3:
                assert out.columns == docs.columns and out.count() <= docs.count()
            if name == "near_duplicates":
                texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
                sets, roots = plain_components(texts, 5)
                assert out.count() == len({r for r, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)
            if name == "packing":
                assert {r["doc_id"] for r in rows(out.select("doc_id"))} == {r["doc_id"] for r in rows(docs.select("doc_id"))}
            docs = out


def test_lm_gradients_against_differences():
    rng = np.random.default_rng(2)
    m = lm_score.Attention({k: v.astype(np.float64) for k, v in lm_score.Attention.fresh(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)).w.items()})
    x, pad, _, _ = lm_score.laid_out(rng.integers(0, lm_score.CLASSES, 90).astype(np.int16), np.array([0, 50, 90]))
    logits, kept = m.forward(x, pad)
    d = rng.normal(size=logits.shape)
    g = m.backward(d, kept)
    for name, w in m.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        before, ends = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = before + step
            ends.append((m.forward(x, pad)[0] * d).sum())
        w[at] = before
        assert abs((ends[0] - ends[1]) / 2e-5 - g[name][at]) < 1e-4 * abs(g[name][at]), name


def test_every_language_has_a_model_of_its_own(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 4 = 0")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).coalesce(2)
    judged = lambda: {r["doc_id"]: (r["kept"], round(r["log10_perplexity"] or 0, 9)) for r in rows(quality.judged(docs))}
    want = judged()
    monkeypatch.setattr(quality, "LANGUAGES", 2)
    assert judged() == want and len(want) == docs.count()
