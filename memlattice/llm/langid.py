"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams (of SIZES bytes) of each word with a blank at either side, A-Z in lower case, hashed
into BUCKETS rows. A text is the mean of its subwords' embeddings; a linear softmax over it gives the
languages. Embeddings and softmax are trained by stochastic gradient descent in numpy. As the softmax is
linear, the trained model is kept as one vector of language scores for each bucket (at most BUCKETS x
languages floats: its size does not grow with the corpus), and a text's logits are the mean of these.

Calibration: a temperature is fitted on a tenth of the sample that training did not see. A text is rejected if its
score is under a threshold, at most 1/2, or its support (the mean logarithm of its subwords' shares in the training
texts) is under a limit: a softmax alone is sure of texts in a language that it never saw. Both are what the share
REJECT of all rightly identified labelled texts outside the sample fall under; with fewer than 1 / REJECT of these,
the threshold is the least score in the tenth, and there is no limit of support.

Training takes a sample of about SAMPLE distinct labelled texts, drawn by a hash of the text up to a bound for each
language (what rare ones don't fill is left to the others), so that a rare language is learned and copies push
none out; a bounded sample is enough for a few thousand parameters a language.
Every text is scored whole.

Defined cases: a null text, or one without any letter, gives `und` with score 0 and is rejected. With no
labelled texts at all there is no language to learn, and every text gives `und`. Very long texts are scored
in blocks. Rows repeated are scored alike; an empty table gives no rows; columns of the input keep their names and values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlattice.llm import _text

BITS = 16
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
DIM = 12
SAMPLE = 3_000
LEAST = 100  # texts of a language that are drawn however many languages there are
REJECT = 0.0005
CELLS = (0.001, 0.01)  # of the histograms of score and support

# Bytes: letters keep their lower case, every other ASCII character reads as a blank, others stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    support: np.ndarray  # BUCKETS: log share of the subwords of the training texts
    least: float


def subwords(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: buckets of the n-grams, and where each text's begin. A blank stands before and behind every text; an n-gram holds one only at its ends, so it lies in one text."""
    texts = len(offsets) - 1
    folded = np.full(len(buf) + texts + 1, 32, np.uint8)
    folded[np.arange(1, len(buf) + 1) + np.repeat(np.arange(texts), np.diff(offsets))] = _FOLD[buf]
    begin = offsets + np.arange(texts + 1)  # the blank before each text
    blank = folded == 32
    run = folded.astype(np.uint32)
    inside = np.ones(len(folded), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(folded) - n + 1
        if m <= 0:
            return
        run = run[:m] * np.uint32(0x01000193) ^ folded[n - 1 :].astype(np.uint32)
        inside = inside[:m] & (~blank[n - 2 : n - 2 + m] if n > 2 else ~(blank[:m] & blank[1 : 1 + m]))  # the byte before the last
        if n in SIZES:
            at = np.flatnonzero(inside)
            h = (run[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            yield h >> np.uint32(32 - BITS), np.searchsorted(at, begin)


def _logits(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean language scores and mean support of each text; texts without subwords get the bias alone."""
    k = len(model.languages)
    total, support, number = np.zeros((len(offsets) - 1, k)), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for buckets, first in subwords(buf, offsets):
        number += np.diff(first)
        support += _text.per_text(model.support[buckets].astype(np.float64), first)
        for j in range(k):
            total[:, j] += _text.per_text(model.scores[:, j][buckets].astype(np.float64), first)
    return total / np.maximum(number, 1)[:, None] + model.bias, support / np.maximum(number, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: pa.Array, langs: list[str], epochs: int = 4, seed: int = 7) -> Model | None:
    """Fits the model to a sample of texts. The last tenth calibrates."""
    languages = sorted(set(langs))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in langs])
    bags, sizes = [], []
    for _, _, buf, offsets in _text.blocks(texts):
        parts = list(subwords(buf, offsets))
        for i in range(len(offsets) - 1):
            ids = np.concatenate([b[f[i] : f[i + 1]] for b, f in parts]) if parts else np.zeros(0, np.uint32)
            ids, n = np.unique(ids, return_counts=True)
            sizes.append(n.sum())
            bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held, fit = order[: len(bags) // 10], order[len(bags) // 10 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.3, out.shape).astype(np.float32)
    steps, done = epochs * max(1, len(fit) // 16), 0
    for _ in range(epochs):
        for i in range(0, len(fit), 16):
            rate = 6.0 * max(0.05, 1 - done / steps)
            done += 1
            some = fit[i : i + 16]
            ids = np.concatenate([bags[j][0] for j in some])
            w = np.concatenate([bags[j][1] for j in some])
            row = np.repeat(np.arange(len(some)), [len(bags[j][0]) for j in some])
            mean = np.zeros((len(some), DIM), np.float32)
            np.add.at(mean, row, emb[ids] * w[:, None])
            delta = _softmax(mean @ out + bias)
            delta[np.arange(len(some)), y[some]] -= 1
            delta /= len(some)
            back = delta @ out.T
            out -= rate * 0.2 * mean.T @ delta
            bias -= rate * 0.02 * delta.sum(0)
            np.add.at(emb, ids, -rate * 20 * w[:, None] * back[row])
    count = np.full(BUCKETS, 0.5)
    for j in fit:
        count[bags[j][0]] += bags[j][1] * sizes[j]
    model = Model(languages, emb @ out, bias, 1.0, 0.0, np.log(count / count.sum()).astype(np.float32), -np.inf)
    check = held if len(held) else fit
    logit = np.array([(model.scores[bags[j][0]] * bags[j][1][:, None]).sum(0) + bias for j in check])
    loss = [(-np.log(np.maximum(_softmax(logit / t)[np.arange(len(check)), y[check]], 1e-12)).mean(), t) for t in np.geomspace(0.1, 10, 41)]
    model.temperature = float(min(loss)[1])
    p = _softmax(logit / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y[check]])
    model.threshold = float(min(0.5, right[int(REJECT * len(right))])) if len(right) else 0.0
    return model


def _has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(c.isalpha() for c in text) if not text.isascii() else any(map(str.isalpha, text))


def predict(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it was rejected, for each text."""
    n = len(column)
    langs, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    if model is None:
        return langs, score, rejected
    for lo, hi, buf, offsets in _text.blocks(column):
        letters = _text.per_text(LETTER[buf], offsets)
        logits, support = _logits(model, buf, offsets)
        p = _softmax(logits / model.temperature)
        best, top = p.argmax(1), p.max(1)
        for i in range(lo, hi):
            if not letters[i - lo] and not _has_letter(column[i].as_py()):
                continue
            langs[i], score[i] = model.languages[best[i - lo]], top[i - lo]
            rejected[i] = score[i] < model.threshold or support[i - lo] < model.least
    return langs, score, rejected


def calibrate(docs: DataFrame, learn: Column, label: str, text: str, model: Model, drawn: set[int]) -> None:
    """Sets the limits of score and support to the share REJECT of all rightly identified texts that were not drawn for training.

    Their cells are counted by Spark. Fewer than 1 / REJECT such texts don't tell that share, and leave the limits.
    """
    told = docs.sparkSession.sparkContext.broadcast((model, drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = told.value
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for b in batches:
            for lo, hi, buf, offsets in _text.blocks(b.column(0)):
                logits, support = _logits(m, buf, offsets)
                p = _softmax(logits / m.temperature)
                right = np.array([m.languages[k] == x for k, x in zip(p.argmax(1), b.column(1).slice(lo, hi - lo).to_pylist(), strict=True)], bool)
                right &= np.array([hash_text(x) not in known for x in b.column(0).slice(lo, hi - lo).to_pylist()], bool)
                for i, x in enumerate((p.max(1), support)):
                    found[i] = np.concatenate([found[i], np.floor(x[right] / CELLS[i]).astype(np.int64)])
            for i in range(2):
                cells, n = np.unique(found[i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), i, np.int32)), pa.array(cells), pa.array(n)], names=["kind", "cell", "n"])
                found[i] = np.zeros(0, np.int64)

    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(text, label)
    counts = rows.mapInArrow(_text.trimmed(run), "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()  # some thousand cells
    limits = []
    for i in range(2):
        cells = sorted((r["cell"], r["n"]) for r in counts if r["kind"] == i)
        total, seen = sum(n for _, n in cells), 0
        if total * REJECT < 1:
            break
        for cell, n in cells:
            seen += n
            if seen > REJECT * total:
                limits.append(cell * CELLS[i])
                break
    if len(limits) == 2:
        model.threshold, model.least = float(min(0.5, limits[0])), float(limits[1])
    told.unpersist()


LETTER = np.zeros(256, bool)  # ASCII letters; texts without any are looked at by character
LETTER[65:91] = LETTER[97:123] = True


def sample(docs: DataFrame, learn: Column, label: str, most: int, text: str = "text") -> pa.Table:
    """Distinct (text, label) to learn from: up to a bound for each label, at most `most` in all unless LEAST for each label are more."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(text)
    n = {r[0]: r[1] for r in rows.groupBy(label).agg(F.approx_count_distinct(h, 0.02)).collect()}
    each = max(LEAST, _bound(list(n.values()), most))
    share = {k: min(1.0, 1.3 * each / max(v, 1)) for k, v in n.items() if 1.3 * each < v}  # 1.3: a label has its bound beyond chance and the count's error
    for_label = F.coalesce(*[F.when(F.col(label) == k, F.lit(int(v * 1_000_003))) for k, v in share.items()], F.lit(1_000_003))
    drawn = rows.where(F.pmod(h, F.lit(1_000_003)) < for_label).select(text, label).distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy(h, text))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= each).select(text, label).toArrow()


def _bound(counts: list[int], most: int) -> int:
    """The largest bound under which counts, cut to it, sum to `most` at most."""
    left = most
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return share
        left -= n
    return most


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model | None:
    """Trains on a sample of the rows to learn from; rows without text or language teach nothing."""
    found = _sorted_sample(docs, learn, lang, most, text)
    model = train(found.column(0).combine_chunks(), found.column(1).to_pylist())
    drawn = {hash_text(x) for x in found.column(0).to_pylist()}
    del found
    _text.give_back()
    if model is not None:
        calibrate(docs, learn, lang, text, model, drawn)
    return model


def _sorted_sample(docs: DataFrame, learn: Column, label: str, most: int, text: str) -> pa.Table:
    """The sample in an order that no plan changes, so that training is repeatable."""
    found = sample(docs, learn, label, most, text)
    return found.take(pa.array(np.argsort(np.array([hash_text(x) for x in found.column(0).to_pylist()], dtype=np.uint64), kind="stable"))) if len(found) else found


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected")) -> DataFrame:
    """Adds language, score and whether it is rejected to docs, as `names` (replacing columns of these names). keep: the columns of docs to return, all by default."""
    docs = docs.drop(*names)
    told = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    schema = T.StructType([*[docs.schema[c] for c in kept], *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType()))])

    def run(batches):
        for b in batches:
            langs, score, rejected = predict(told.value, b.column(b.schema.names.index(text)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)) for c in kept], pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*kept, *names])

    return docs.mapInArrow(_text.trimmed(run), schema)
