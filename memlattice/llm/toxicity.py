"""Toxicity by two class-conditional Kneser-Ney models.

A bigram model of toxic and one of ordinary labelled texts, over continuation counts (in how many different
contexts an expression occurs, so that copies of a text add nothing), with the absolute discounts of modified
Kneser-Ney. Both back off to one shared distribution, that of the word's first STEM bytes, and this to the number of
classes in which such a stem occurs. Expressions that a class knows from fewer than LEAST contexts are left to the
shared backoff whole, as a count cutoff does: what is known of them is chance, and of thousands of such words the
chance differences would outweigh an insult. Probabilities sum to one over the known words and one unseen word for each
stem. Words are runs of letters and digits in lower case.

A text's evidence is the difference of its log-likelihoods under the two models divided by its number of
words; and, as an insult in a long text would vanish in the mean, the largest such difference over windows
of WINDOW words (every word lies in one or two), there without the first SLIGHT of each word's difference,
which the text's language or subject can make up, and without immediate repetitions. A logistic calibration of the
two numbers, fitted on a part of the learning rows whose counts the models didn't see, gives a score between 0 and 1.

The models are fitted on a sample: at most SAMPLE toxic texts and ORDINARY * SAMPLE ordinary ones, up to BYTES
bytes of text, the first in order of a hash of the id (so that no partitioning changes them). One task counts and
calibrates; only the tables of expressions beyond the cutoff reach the driver and the executors. All texts are scored
whole.

Defined cases: a null text counts as empty; empty texts (no word) have evidence 0 and get the calibration's
score for it. With only one class (or nothing) labelled, every score is the share of toxic labels (0 if
there are none). Several labels for one id: the largest counts. Several texts of one id: the least teaches. Null labels
and ids teach nothing. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm import _text

SAMPLE = 1_500
ORDINARY = 4
BYTES = 48 << 20
LEAST = 5
WINDOW = 24
SLIGHT = 2.0
STEM = 4
UNKNOWN = -16.0
THRESHOLD = 0.3

_WORD = np.full(256, 32, np.uint8)  # letters and digits in lower case, parts of UTF-8 sequences; all else separates
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = _WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


@dataclass
class Model:
    unigrams: _text.SortedTable  # toxic, ordinary: log probabilities; *_weight: of the backoff behind the word
    bigrams: _text.SortedTable  # toxic, ordinary
    stems: _text.SortedTable  # toxic, ordinary: of an unknown word with the stem
    scale: np.ndarray  # bias, mean evidence, window evidence
    prior: float


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their first STEM bytes, and where each text's words begin."""
    folded = _WORD[buf]
    starts, ends, first = _text.spans(folded, offsets)
    return _text.word_hashes(folded, starts, ends), _text.word_hashes(folded, starts, np.minimum(ends, starts + STEM)), first


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (0 at a text's start), and the hash of both."""
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return before, _text.chained(before, h)


def _discounted(n: np.ndarray) -> tuple[np.ndarray, float]:
    """Counts less their discount, and the mass taken off: D3+ of the counts of counts from LEAST on, and all of what is below."""
    twos, threes, fours = [max(1.0, float((n == k).sum())) for k in (2, 3, 4)]
    ones = max(1.0, float((n == 1).sum()))
    d = float(np.clip(3 - 4 * ones / (ones + 2 * twos) * fours / threes, 0.5, 2.9))
    cut = np.where(n < LEAST, n, d)
    return n - cut, float(cut.sum())


def _trigrams(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """By block of texts: hashes of (word two before, word before, word), of the word before, the word, both, and the word's stem."""
    for _, _, buf, offsets in _text.blocks(column):
        h, stem, first = _words(buf, offsets)
        v, g = _pairs(h, first)
        u = np.zeros_like(v)
        u[1:] = v[:-1]
        u[v == 0] = 0
        yield _text.chained(u, g), v, h, g, stem


def _contexts(column: pa.Array) -> list[np.ndarray]:
    """The distinct (word two before, word before, word) of all texts, as hashes; copies of a text add nothing. Read twice, so that only what stays is held."""
    keys = [x[0] for x in _trigrams(column)]
    size = np.cumsum([0, *map(len, keys)])
    new = np.zeros(int(size[-1]), bool)
    if len(new):
        keys = np.concatenate(keys)
        new[np.unique(keys, return_index=True)[1]] = True
    del keys
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for i, (_, *columns) in enumerate(_trigrams(column)):
        mine = new[size[i] : size[i + 1]]
        for held, x in zip(parts, columns, strict=True):
            held.append(x[mine])
    return [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]


def _unigrams(counts: list[np.ndarray], shared: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Discounted shares of either class over its shared distribution, and the weights of the latter."""
    out, weights = [], []
    for n, s in zip(counts, shared, strict=True):
        left, mass = _discounted(n)
        total = max(n.sum(), 1.0)
        weights.append(mass / total if n.sum() else 1.0)
        out.append(left / total + weights[-1] * s)
    return out, weights


def fit_counts(texts: list[pa.Array]) -> tuple[_text.SortedTable, _text.SortedTable, _text.SortedTable]:
    """texts: those of the toxic and of the ordinary class. Tables of words, of pairs and of stems."""
    grams, before, word, count, stem = [], [], [], [], []
    for column in texts:
        found = _contexts(column)
        g, at, n = np.unique(found.pop(2), return_index=True, return_counts=True)
        grams.append(g), count.append(n.astype(np.float64))
        for held in (before, word, stem):
            held.append(found.pop(0)[at])
    vocabulary, where, inverse = np.unique(np.concatenate(word), return_index=True, return_inverse=True)
    stems, of_word = np.unique(np.concatenate(stem)[where], return_inverse=True)
    split = np.split(inverse, [len(word[0])])
    contexts = [np.bincount(x, minlength=len(vocabulary)).astype(np.float64) for x in split]  # words before, by word and class
    by_stem = [np.bincount(of_word, weights=n, minlength=len(stems)) for n in contexts]
    classes = (by_stem[0] > 0).astype(np.float64) + (by_stem[1] > 0)
    shared = classes / max(classes.sum(), 1)
    each, _ = _unigrams(by_stem, [shared, shared])
    types = np.bincount(of_word, minlength=len(stems)) + 1.0  # the words of a stem, and one more for those unseen
    uni, weights = _unigrams(contexts, [(p / types)[of_word] for p in each])
    small = lambda x: x.astype(np.float32)
    stem_table = _text.SortedTable(stems, toxic=small(np.log(weights[0] * each[0] / types)), ordinary=small(np.log(weights[1] * each[1] / types)))
    del stem, inverse, split, where
    # Only pairs that a class knows from enough contexts are held; the others count for the words that they begin with.
    pool = np.unique(np.concatenate([g[n >= LEAST] for g, n in zip(grams, count, strict=True)]))
    heads = np.unique(np.concatenate(before))
    v_at = np.searchsorted(heads, vocabulary)
    v_at[v_at == len(heads)] = 0
    pv, pw, lefts, lams, behinds, weights = np.zeros_like(pool), np.zeros_like(pool), [], [], [], []
    for c in range(2):
        left = _discounted(count[c])[0]
        head = np.searchsorted(heads, before[c])
        behinds.append(np.maximum(np.bincount(head, weights=count[c], minlength=len(heads)), 1))
        lams.append(1 - np.bincount(head, weights=left, minlength=len(heads)) / behinds[c])
        del head
        at, hit = _text.SortedTable.find_in(grams[c], pool)
        lefts.append(np.where(hit, left[at], 0.0) if len(left) else np.zeros(len(pool)))
        pv[hit], pw[hit] = before[c][at[hit]], word[c][at[hit]]
        weights.append(small(np.log(np.where(heads[v_at] == vocabulary, lams[c][v_at], 1.0))) if len(heads) else small(np.zeros(len(vocabulary))))
    inverse, w_at = np.searchsorted(heads, pv), np.searchsorted(vocabulary, pw)
    bi = [np.log(lefts[c] / behinds[c][inverse] + lams[c][inverse] * uni[c][w_at]) for c in range(2)]
    keep = (lefts[0] > 0) | (lefts[1] > 0)
    # A word below the cutoff in both classes has the probability of an unseen word of its stem; it is known only if it weighs as a context.
    own = (contexts[0] >= LEAST) | (contexts[1] >= LEAST) | (weights[0] != 0) | (weights[1] != 0)
    table = _text.SortedTable(vocabulary[own], toxic=small(np.log(uni[0][own])), ordinary=small(np.log(uni[1][own])), toxic_weight=weights[0][own], ordinary_weight=weights[1][own])
    return table, _text.SortedTable(pool[keep], toxic=small(bi[0][keep]), ordinary=small(bi[1][keep])), stem_table


def log_likelihoods(model: Model, h: np.ndarray, stem: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word under the toxic and under the ordinary model. Words of unknown stem: the same for both."""
    before, g = _pairs(h, first)
    if not len(model.stems.keys) or not len(h):
        return np.zeros(len(h)), np.zeros(len(h))
    at, hit = model.bigrams.find(g)
    u, known = model.unigrams.find(h)
    new = np.flatnonzero(~known)
    p, stemmed = model.stems.find(stem[new])
    c, seen = np.zeros_like(u), np.zeros(len(u), bool)
    c[1:], seen[1:] = u[:-1], known[:-1]
    seen &= before != 0
    out = []
    for name in ("toxic", "ordinary"):
        lower = model.unigrams.values[name][u].astype(np.float64) if len(model.unigrams.keys) else np.zeros(len(h))
        lower[new] = np.where(stemmed, model.stems.values[name][p], UNKNOWN)
        if len(model.unigrams.keys):
            lower += np.where(seen, model.unigrams.values[f"{name}_weight"][c], 0.0)
        if len(model.bigrams.keys):
            lower[hit] = model.bigrams.values[name][at[hit]]
        out.append(lower)
    return out[0], out[1]


def evidence(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: mean difference of the log-likelihoods by word, and the largest of a window."""
    h, stem, first = _words(buf, offsets)
    toxic, ordinary = log_likelihoods(model, h, stem, first)
    n = np.diff(first)
    out = np.zeros((len(n), 2))
    gap = toxic - ordinary
    out[:, 0] = _text.per_text(gap, first) / np.maximum(n, 1)
    strong = np.sign(gap) * np.maximum(np.abs(gap) - SLIGHT, 0)
    for k in (1, 2):  # a word said over and over counts once
        strong[k:][h[k:] == h[:-k]] = 0
    total = np.concatenate([[0.0], np.cumsum(strong)])
    step = WINDOW // 2
    windows = np.maximum(1, -(-(n - WINDOW) // step) + 1)
    text = np.repeat(np.arange(len(n)), windows)
    k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    a = first[text] + np.maximum(0, np.minimum(k * step, n[text] - WINDOW))
    b = np.minimum(a + WINDOW, first[text + 1])
    x = (total[b] - total[a]) / WINDOW
    out[:, 1] = np.maximum.reduceat(x, np.cumsum(windows) - windows)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * np.array([0, 1, 1]) * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return w


def train(toxic: pa.Array, ordinary: pa.Array, prior: float) -> Model:
    """A fifth of either class calibrates; prior: the share of toxic texts among all labelled."""
    parts = [[column.take(pa.array(np.flatnonzero((np.arange(len(column)) % 5 == 0) == k))) for k in (True, False)] for column in (toxic, ordinary)]
    uni, bi, stems = fit_counts([parts[0][1], parts[1][1]])
    model = Model(uni, bi, stems, np.zeros(3), prior)
    if not len(toxic) or not len(ordinary):
        model.prior = float(len(toxic) > 0)
        return model
    xs = [np.concatenate([evidence(model, buf, offsets) for _, _, buf, offsets in _text.blocks(p[0])]) for p in parts]
    y = np.repeat([1.0, 0.0], [len(xs[0]), len(xs[1])])
    weight = np.repeat([prior / len(xs[0]), (1 - prior) / len(xs[1])], [len(xs[0]), len(xs[1])]) * len(y)
    model.scale = _logistic(np.concatenate(xs), y, weight)
    return model


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score and evidence of each text."""
    found = [evidence(model, buf, offsets) for _, _, buf, offsets in _text.blocks(column)]
    x = np.concatenate(found) if found else np.zeros((0, 2))
    if not model.scale.any():
        return np.full(len(x), model.prior), x
    z = model.scale[0] + x @ model.scale[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), x


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """learn: which rows of docs may teach."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg((F.max(label) > 0).alias("_mark"))
    # Ids, labels and lengths alone say which texts to read; these are few, and no other text is shuffled.
    known = docs.where(learn & F.col(text).isNotNull()).groupBy(id_col).agg(F.max(F.octet_length(text)).cast("bigint").alias("_bytes")).join(marks, id_col)
    n = {r[0]: r[1] for r in known.groupBy("_mark").count().collect()}
    toxic, other = n.get(True, 0), n.get(False, 0)
    order = [F.xxhash64(id_col), F.col(id_col)]
    first = lambda mark, k: known.where(F.col("_mark") == mark).orderBy(*order).limit(k)
    drawn = first(True, most).unionByName(first(False, ORDINARY * most))
    sofar = F.sum("_bytes").over(Window.orderBy(*order))  # over the few drawn rows
    drawn = drawn.withColumn("_sofar", sofar).where(F.col("_sofar") <= BYTES).select(id_col, "_mark")
    found = docs.where(learn & F.col(text).isNotNull()).select(id_col, text).join(F.broadcast(drawn), id_col)
    found = found.groupBy(id_col, "_mark").agg(F.min(text).alias("_text")).select("_mark", "_text").repartition(1)
    prior = toxic / max(toxic + other, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("_mark", pa.bool_()), ("_text", pa.string())]))
        order = np.argsort([hash_order(x.as_py()) for x in t.column(1)], kind="stable")
        mark = np.array(t.column(0).to_pylist(), bool)[order]
        classes = [t.column(1).take(pa.array(order[mark == k], pa.int64())).combine_chunks() for k in (True, False)]
        del t
        model = pickle.dumps(train(*classes, prior))
        del classes
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = found.mapInArrow(_text.trimmed(run), "model binary").first()
    none = pa.array([], pa.string())
    return pickle.loads(got[0]) if got else train(none, none, prior)


def hash_order(text: str) -> int:
    raw = text.encode()
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) >> 1


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("toxic_score", "toxic_evidence", "toxic_window")) -> DataFrame:
    """Adds score, evidence by word and largest window evidence to docs, as `names` (replacing columns of these names). keep: the columns of docs to return, all by default."""
    docs = docs.drop(*names)
    told = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, x = scores(told.value, b.column(b.schema.names.index(text)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], pa.array(p), pa.array(x[:, 0]), pa.array(x[:, 1])], names=[*kept, *names])

    return docs.mapInArrow(_text.trimmed(run), schema)
