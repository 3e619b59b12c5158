"""Encoding and decoding with the pieces of a SentencePiece model, by a streaming Viterbi search.

The best segmentation of a text is the one with the largest sum of piece scores. The search reads the text
once. A boundary's best path is known when all pieces that end there have been tried, and pieces are at most
`longest` characters, so only that many boundaries are open at a time: they are the window. As soon as all
paths that survive in the window come from one boundary, what lies before it can never change and its ids
are committed; state is dropped up to there. Characters without a piece are committed as their UTF-8
bytes' pieces, at a score of 10 below the least, as SentencePiece does.

Scores are log probabilities of the pieces, from fit(): Spark counts the pieces of the library's own segmentation over all
texts. The scores in a file trained as BPE are no probabilities but ranks of merges, so their sums say little; they are used
where no others are given. Either way the ids are those of the best sum, which is not always the segmentation in order of
merges; decoding is the same for all.

Texts of a corpus share most words. Where two characters stand side by side in no piece (looked up by the last byte of
one and the first of the other), every path passes the boundary between them: before blanks, and mostly between
letters, digits and signs. Ids of each stretch from one such boundary to the next are searched once and kept in a bounded
cache. The library's segmentation in fit() is cut at blanks only (no piece goes from a non-blank into one; checked when the model is opened).

Defined cases: null and empty texts have no ids and decode to the empty text. White space is kept as it is.
The character U+2581, which stands for a blank inside pieces, decodes as a blank. Repeated rows get the same ids; an empty
table gives no rows, and with no text to count all pieces are equally likely. A model file that changes texts (by a
normalizer other than writing blanks as U+2581) is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm import _text

BLANK = "▁"
CACHE = 700_000
PORTION = 4_096  # characters that are searched at a time
SHORT = 4  # windows up to which a stretch is searched at once
_END = ""  # in a node of the trie: (id, score) of the piece that ends there


class Pieces:
    """The vocabulary of a model: scores, a trie, byte pieces, and the bytes of each id."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        """scores: of each id; the file's own if not given."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        score_of = sp.get_score if scores is None else scores.__getitem__
        self.trie: dict = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.longest, least, texts = 1, 0.0, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[_END] = (i, float(score_of(i)))
                self.raw.append(piece.replace(BLANK, " ").encode())
                self.longest, least = max(self.longest, len(piece)), min(least, float(score_of(i)))
                texts.append(piece)
        self.unknown, self.unknown_id = least - 10.0, sp.unk_id()
        self.dummy = len(sp.encode("a")) > 0 and sp.id_to_piece(sp.encode("a")[0]).startswith(BLANK)
        sample = "Ａﬁé\u00a0ß  x\t"
        if sp.normalize(sample) != BLANK * self.dummy + sample.replace(" ", BLANK):
            raise ValueError(f"{path} normalizes texts, which this search doesn't")
        blanks = [c for c in "\t\n\x0b\x0c\r" if not any(c in p[1:] for p in texts)]
        if not any(BLANK in p.lstrip(BLANK) for p in texts):
            blanks.append(" ")
        self.separators = blanks
        # Bytes that a stretch can't be cut between: within a character, or last and first of two that stand side by side in a piece.
        self.inside = np.zeros((256, 256), bool)
        self.inside[:, 0x80:0xC0] = True
        written = lambda c: (c, " ") if c == BLANK else (c,)
        for a, b in {p[i : i + 2] for p in texts for i in range(len(p) - 1)}:
            for x in written(a):
                for y in written(b):
                    self.inside[x.encode()[-1], y.encode()[0]] = True

    def of_unknown(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown_id]


class StreamingViterbi:
    """feed() text in portions and take the committed ids from each call; finish() gives the rest."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # from the last committed boundary on
        self.best: list[float | None] = [0.0]  # by boundary of self.text
        self.back: list[tuple[int, int]] = [(-1, -1)]  # where the piece that ends here begins, and its id
        self.at = 0  # the next boundary to search from
        self.far = 0  # the furthest that a beginning of a piece has reached
        self.checked = 0  # where it was last looked whether the open paths have met

    def feed(self, text: str) -> list[int]:
        self.text += text
        return self._search(len(self.text) - self.pieces.longest + 1)

    def finish(self) -> list[int]:
        out = self._search(len(self.text))
        out += self._commit(len(self.text))
        return out

    def _search(self, stop: int) -> list[int]:
        trie, unknown = self.pieces.trie, self.pieces.unknown
        text, best, back = self.text, self.best, self.back
        while len(best) <= len(text):
            best.append(None)
            back.append((-1, -1))
        out: list[int] = []
        j, n, committed, checked = self.at, len(text), 0, self.checked
        while j < stop:
            score = best[j]
            if score is None:  # no path has a boundary here
                j += 1
                continue
            if self.far <= j and j > committed:  # nothing before reaches further: all paths pass here
                out += self._path(committed, j)
                committed = checked = j
            elif j - checked >= max(self.pieces.longest, (checked - committed) // 2):  # paths may meet further back; the longer they don't, the rarer it is looked
                meet, checked = self._meeting(j, max(self.far, j), committed), j
                if meet > committed:
                    out += self._path(committed, meet)
                    committed = meet
            node, k, single = trie, j, False
            while k < n:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                end = node.get(_END)
                if end is not None:
                    if k == j + 1:
                        single = True
                    total = score + end[1]
                    if best[k] is None or total > best[k]:
                        best[k] = total
                        back[k] = (j, end[0])
            if not single and (best[j + 1] is None or score + unknown > best[j + 1]):
                best[j + 1] = score + unknown
                back[j + 1] = (j, -1)
            self.far = max(self.far, k, j + 1)
            j += 1
        self.at, self.checked = max(j, self.at), checked
        self._drop(committed)
        return out

    def _meeting(self, at: int, far: int, committed: int) -> int:
        """The last boundary on the paths of all open boundaries."""
        open_ = {i for i in range(at, min(far, len(self.text)) + 1) if self.best[i] is not None}
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            if self.back[last][0] < committed:
                return committed
            open_.add(self.back[last][0])
        return min(open_, default=committed)

    def _path(self, begin: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > begin:
            start, piece = self.back[end]
            out.append([piece] if piece >= 0 else self.pieces.of_unknown(self.text[start]))
            end = start
        return [x for y in reversed(out) for x in y]

    def _commit(self, end: int) -> list[int]:
        out = self._path(0, end)
        self._drop(end)
        return out

    def _drop(self, upto: int) -> None:
        if upto:
            low = self.best[upto] or 0.0
            self.text = self.text[upto:]
            self.best = [None if x is None else x - low for x in self.best[upto:]]
            self.back = [(-1, -1)] + [(a - upto, i) for a, i in self.back[upto + 1 :]]
            self.at, self.far, self.checked = max(0, self.at - upto), max(0, self.far - upto), max(0, self.checked - upto)


class Codec:
    def __init__(self, path: str, scores: np.ndarray | None = None):
        self.pieces = Pieces(path, scores)
        self.cache = _text.IdCache(CACHE)
        # Blanks at which stretches can be cut; other white space reads like a letter.
        self.table = np.where(_text.SPACE, ord("a"), np.arange(256)).astype(np.uint8)
        for c in self.pieces.separators:
            self.table[ord(c)] = 32

    def search(self, text: str) -> list[int]:
        if len(text) <= SHORT * self.pieces.longest:
            return self._at_once(text.replace(" ", BLANK))
        run, out = StreamingViterbi(self.pieces), []
        for i in range(0, len(text), PORTION):
            out += run.feed(text[i : i + PORTION].replace(" ", BLANK))
        return out + run.finish()

    def _at_once(self, text: str) -> list[int]:
        """The same search of a text of a few windows, with nothing committed before its end."""
        trie, unknown, n = self.pieces.trie, self.pieces.unknown, len(text)
        best: list[float | None] = [0.0] + [None] * n
        back = [(0, 0)] * (n + 1)
        for j in range(n):
            score = best[j]
            if score is None:
                continue
            node = trie
            for k in range(j, n):
                node = node.get(text[k])
                if node is None:
                    break
                end = node.get(_END)
                if end is not None:
                    total, b = score + end[1], best[k + 1]
                    if b is None or total > b:
                        best[k + 1] = total
                        back[k + 1] = (j, end[0])
            if _END not in trie.get(text[j], ()):
                b = best[j + 1]
                if b is None or score + unknown > b:
                    best[j + 1] = score + unknown
                    back[j + 1] = (j, -1)
        out: list[list[int]] = []
        while n:
            start, piece = back[n]
            out.append([piece] if piece >= 0 else self.pieces.of_unknown(text[start]))
            n = start
        return [x for y in reversed(out) for x in y]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end)."""
        lead = BLANK if self.pieces.dummy else ""
        pairs = buf[:-1].astype(np.uint16) << 8 | buf[1:]
        ends = np.flatnonzero(~self.pieces.inside.ravel().take(pairs)) + 1
        return self.by_stretch(buf, offsets, ends, lambda texts, heads: [self.search(lead + t if h else t) for t, h in zip(texts, heads, strict=True)])

    def at_blanks(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where words end."""
        return _text.spans(self.table[buf], offsets)[1]

    def by_stretch(self, buf: np.ndarray, offsets: np.ndarray, ends: np.ndarray, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """encode(), cut at these ends and those of texts, where ids_of(texts, heads) gives the ids of stretches; heads: whether a text begins with it."""
        ends = np.union1d(ends, offsets[1:][offsets[1:] > offsets[:-1]])
        starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        first = np.searchsorted(starts, offsets)
        head = np.isin(starts, offsets[:-1])
        hashes = _text.word_hashes(buf, starts, ends) + head.astype(np.uint64)
        raw = buf.tobytes()
        make = lambda new: ids_of([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], head[new].tolist())
        ids, end = self.cache.ids(hashes, make)
        return ids, np.concatenate([[0], end])[first]

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.pieces.raw.__getitem__, ids))
        return out[1:] if self.pieces.dummy and out[:1] == b" " else out


@lru_cache(maxsize=2)
def codec(path: str, scores: bytes | None = None) -> Codec:
    """One codec, with its cache, for each worker process. scores: 32-bit floats, one for each id."""
    return Codec(path, None if scores is None else np.frombuffer(scores, "<f4"))


def fit(docs: DataFrame, path: str, text: str = "text") -> bytes:
    """Scores for codec(): log probabilities of the pieces in the library's segmentation of all texts, 1/2 added to each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp, c = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
        blank, counts = sp.piece_to_id(BLANK), np.zeros(sp.get_piece_size(), np.int64)

        def ids_of(texts: list[str], heads: list[bool]) -> list[list[int]]:
            # The library puts a blank before each text: it is the stretch's own, or doesn't belong to it.
            inner = [c.pieces.dummy and not h for h in heads]
            ids = sp.encode([t[1:] if i and t[:1] == " " else t for t, i in zip(texts, inner, strict=True)], num_threads=1)
            return [x[1:] if i and t[:1] != " " and x[:1] == [blank] else x for x, t, i in zip(ids, texts, inner, strict=True)]

        for b in batches:
            for _, _, buf, offsets in _text.blocks(b.column(0)):
                counts += np.bincount(c.by_stretch(buf, offsets, c.at_blanks(buf, offsets), ids_of)[0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["id", "n"])

    got = docs.select(text).mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each piece at most
    counts = np.full(len(Pieces(path).raw), 0.5)
    counts[got.column("id").to_numpy()] += got.column("n").to_numpy()
    return np.log(counts / counts.sum()).astype("<f4").tobytes()


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", decode: bool = True, scores: bytes | None = None) -> DataFrame:
    """(id_col, ids, n_ids, decoded): ids as little-endian unsigned 16-bit numbers; decoded is the text of the ids (null if not asked for)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for b in batches:
            for lo, hi, buf, offsets in _text.blocks(b.column(1)):
                ids, first = c.encode(buf, offsets)
                ids = ids.astype("<u2")
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(ids)])
                flat = ids.tolist() if decode else []
                texts = [c.decode(flat[i:j]).decode("utf-8", "replace") for i, j in zip(first[:-1], first[1:], strict=True)] if decode else [None] * (hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), column, pa.array(np.diff(first)), pa.array(texts, pa.string())], names=[id_col, "ids", "n_ids", "decoded"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_ids long, decoded string")
