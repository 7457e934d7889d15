"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Text is escaped as SentencePiece does (a dummy space in front, spaces as the
meta symbol) and cut before each run of meta symbols, which no piece crosses.
Distinct words are encoded once and remembered. Words of equal length advance
together: at each end, the substrings of each length are looked up by their
hashes in the sorted keys of the pieces, and one vectorised maximum for each
length stores the back-pointers. Characters that no piece covers become bytes.
A word of over ``LONG`` characters, as texts without spaces are, is cut where no
piece of the model that occurs there reaches across: every segmentation has those
cuts, so the parts are words of their own and advance with others of their length.
What is still long after that takes the same maxima a character at a time, over
the matches alone, which are found for a block of the text at once.

The segmentation is the one with the greatest sum of the model's piece scores,
the unigram rule of SentencePiece. A model trained as BPE states merge order as
scores; its pieces and ids are used as they are, and the result is the best
sum of those scores, which need not be the order of merges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import frugal, mix, utf8

META = "▁"
WORD = re.compile(f"{META}*[^{META}]+|{META}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = 10.0
SLICE_BYTES, MOST_WORDS = 1 << 20, 200_000
#: Characters of a word that is cut before it is encoded, and of a block of one.
LONG, BLOCK = 256, 1 << 16


class Model:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        scores = np.array([m.get_score(i) for i in range(n)])
        self.unknown = m.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        plain = []
        for i, p in enumerate(self.pieces):
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                plain.append(i)
        self.has_bytes = bool((self.byte_ids != self.unknown).all())
        #: An uncovered character scores below every piece.
        self.miss = float(scores[plain].min()) - UNKNOWN_PENALTY
        self.longest = max(len(self.pieces[i]) for i in plain)
        #: By length: sorted keys of the pieces of that length, ids and scores beside them, and which first 16 bits occur.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            own = [i for i in plain if len(self.pieces[i]) == size]
            if own:
                codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], np.uint64)
                keys = mix(prefix_sums(codes)[:, -1].copy())
                order = np.argsort(keys)
                if (np.diff(keys[order].view(np.int64)) == 0).any():
                    raise ValueError("two pieces share a key")
                present = np.zeros(1 << 16, bool)
                present[(keys >> np.uint64(48)).astype(np.int64)] = True
                self.tables[size] = (keys[order], np.array(own, np.int32)[order], scores[own][order], present)
        bodies = [b""] * n
        for i in plain:
            bodies[i] = self.pieces[i].replace(META, " ").encode()
        for v in range(256):
            if self.byte_ids[v] != self.unknown:
                bodies[self.byte_ids[v]] = bytes([v])
        bodies[self.unknown] = " ⁇ ".encode()
        self.lengths = np.array([len(x) for x in bodies], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.body = np.frombuffer(b"".join(bodies), np.uint8)


    def uncovered(self, char: str) -> np.ndarray:
        """The byte pieces of a character, or the unknown id if the model has none."""
        if not self.has_bytes:
            return np.array([self.unknown], np.int32)
        return self.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)]


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Horner prefixes of each row, a column longer than ``codes``."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + codes[:, k] + np.uint64(1)
    return out


def encode_equal(m: Model, words: list[str]) -> list[np.ndarray]:
    """Ids of words that all have the same number of characters."""
    size, n = len(words[0]), len(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64)
    prefix = prefix_sums(codes)
    power = np.ones(m.longest + 1, np.uint64)
    for k in range(m.longest):
        power[k + 1] = power[k] * BASE
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((n, size + 1), np.int16)
    piece = np.full((n, size + 1), -1, np.int32)
    for end in range(1, size + 1):
        best[:, end] = best[:, end - 1] + m.miss
        for k in range(min(end, m.longest), 0, -1):  # of equal sums the longest last piece wins
            if k not in m.tables:
                continue
            keys, ids, scores, present = m.tables[k]
            h = mix(prefix[:, end] - prefix[:, end - k] * power[k])
            some = np.flatnonzero(present[(h >> np.uint64(48)).view(np.int64)])
            at = np.searchsorted(keys, h[some])
            at[at == len(keys)] = 0
            same = keys[at] == h[some]
            some, at = some[same], at[same]
            total = best[some, end - k] + scores[at]
            win = total > best[some, end]
            some, at = some[win], at[win]
            best[some, end] = total[win]
            back[some, end] = k
            piece[some, end] = ids[at]
    ends = np.full(n, size)
    taken: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    rows = np.arange(n)
    while (ends > 0).any():
        live = ends > 0
        p = np.where(live, piece[rows, ends], -2)
        taken.append(p)
        steps.append(ends - 1)
        ends = np.where(live, ends - back[rows, ends], 0)
    if not taken:
        return [np.zeros(0, np.int32)] * n
    got = np.stack(taken[::-1], axis=1)
    real = got != -2
    flat, stop = got[real].astype(np.int32), np.cumsum(real.sum(axis=1)).tolist()
    out = [flat[a:z] for a, z in zip([0, *stop], stop, strict=False)]
    if (flat == -1).any():
        where = np.stack(steps[::-1], axis=1)
        for i in np.flatnonzero((got == -1).any(axis=1)).tolist():
            spots = where[i][real[i]].tolist()
            out[i] = np.concatenate([np.array([p], np.int32) if p >= 0 else m.uncovered(words[i][s]) for p, s in zip(out[i].tolist(), spots, strict=True)])
    return out


def matches(m: Model, codes: np.ndarray, begin: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, ends, ids, scores) of the pieces that occur in a text and end after ``begin``, by length."""
    g = np.zeros(len(codes) + 1, np.uint64)
    for k in range(1, min(m.longest, len(codes)) + 1):
        g = g[:-1] * BASE + codes[k - 1 :] + np.uint64(1)
        if k not in m.tables:
            continue
        keys, ids, scores, present = m.tables[k]
        first = max(begin - k + 1, 0)
        h = mix(g[first:].copy())
        some = np.flatnonzero(present[(h >> np.uint64(48)).view(np.int64)])
        at = np.searchsorted(keys, h[some])
        at[at == len(keys)] = 0
        same = keys[at] == h[some]
        yield k, some[same] + first + k, ids[at[same]], scores[at[same]]


def blocks(m: Model, word: str) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(place of the block, ends before it, codes, ends in it from there on) of a long word: blocks that overlap by the longest piece."""
    for at in range(0, len(word), BLOCK):
        begin = max(at - m.longest, 0)
        part = word[begin : at + BLOCK]
        yield begin, at - begin, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), at


def cut(m: Model, word: str) -> list[str]:
    """The parts of a word between the places that no occurring piece reaches across."""
    crossed = np.zeros(len(word) + 1, np.int32)
    for place, before, codes, _ in blocks(m, word):
        for k, ends, _, _ in matches(m, codes, before):
            if k > 1:
                # The places after each of a piece's characters but the last.
                np.add.at(crossed, ends + place - k + 1, 1)
                np.add.at(crossed, ends + place, -1)
    free = np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1
    cuts = [0, *free.tolist(), len(word)]
    return [word[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_long(m: Model, word: str) -> np.ndarray:
    """Ids of a word that can't be cut, by the maxima of ``encode_equal`` over its matches in order."""
    n = len(word)
    best, back, piece = [0.0] * (n + 1), np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
    for place, before, codes, at in blocks(m, word):
        found = list(matches(m, codes, before))
        ends = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        sizes = np.concatenate([np.full(len(f[1]), f[0]) for f in found]) if found else ends
        # Of equal sums the longest last piece wins.
        order = np.lexsort((-sizes, ends))
        rows = zip((ends + place)[order].tolist(), sizes[order].tolist(), np.concatenate([f[2] for f in found])[order].tolist() if found else (), np.concatenate([f[3] for f in found])[order].tolist() if found else (), strict=True)
        row = next(rows, None)
        for end in range(at + 1, min(at + BLOCK, n) + 1):
            top, size, which = best[end - 1] + m.miss, 1, -1
            while row is not None and row[0] == end:
                total = best[end - row[1]] + row[3]
                if total > top:
                    top, size, which = total, row[1], row[2]
                row = next(rows, None)
            best[end], back[end], piece[end] = top, size, which
    out: list[np.ndarray] = []
    end = n
    while end:
        p = int(piece[end])
        out.append(np.array([p], np.int32) if p >= 0 else m.uncovered(word[end - 1]))
        end -= int(back[end])
    return np.concatenate(out[::-1]).astype(np.int32)


def encode_words(m: Model, words: list[str]) -> dict[str, np.ndarray]:
    """Ids of each distinct word; at most a million characters advance at once.

    A long word is cut into parts first, which leaves its best sum as it is:
    scores that are whole numbers, as those of merges are, add up exactly, and
    other scores may round a tie differently.
    """
    out: dict[str, np.ndarray] = {}
    with np.errstate(over="ignore"):
        parted = {w: cut(m, w) for w in words if len(w) > LONG}
        parts = {p for found in parted.values() for p in found}
        by_size: dict[int, list[str]] = {}
        for w in dict.fromkeys([*(w for w in words if w not in parted), *(p for p in parts if len(p) <= LONG)]):
            by_size.setdefault(len(w), []).append(w)
        for size, own in by_size.items():
            step = max(1, (1 << 20) // size)
            for at in range(0, len(own), step):
                out.update(zip(own[at : at + step], encode_equal(m, own[at : at + step]), strict=True))
        out.update((p, encode_long(m, p)) for p in parts if len(p) > LONG)
    out.update((w, np.concatenate([out[p] for p in found])) for w, found in parted.items())
    return out


def decode_ids(m: Model, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids, without its dummy space."""
    if not len(ids):
        return b""
    n = m.lengths[ids]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1])) + np.repeat(m.offsets[ids] - (ends - n), n)
    out = m.body[at].tobytes()
    return out[1:] if out[:1] == b" " else out


def slices(b: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``size`` bytes of text, or one row."""
    _, at = utf8(b.column(column))
    begun = 0
    while begun < b.num_rows:
        end = max(begun + 1, int(np.searchsorted(at, at[begun] + size, side="right")) - 1)
        yield b.slice(begun, end - begun)
        begun = end


def split_words(text: str) -> list[str]:
    """The words of a text; those after a single space, nearly all, without their meta symbol."""
    plain = text.replace(META, " ")
    words = plain.split(" ")
    if "" not in words:
        return words
    return [w[1:] if w[1:2] not in ("", META) else w for w in WORD.findall(META + plain.replace(" ", META))]


class WordTable:
    """Ids of the distinct words met so far; forgotten when there are over ``MOST_WORDS``."""

    def __init__(self, m: Model):
        self.model = m
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column; null or empty: none."""
        if len(self.numbers) > MOST_WORDS:
            self.clear()
        numbers, known = self.numbers, len(self.numbers)
        docs = []
        for t in column.to_pylist():
            found = split_words(t) if t else []
            docs.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found)))
        if len(numbers) > known:
            new = [w if w[0] == META else META + w for w in islice(numbers, known, None)]
            coded = encode_words(self.model, new)
            parts = [coded[w] for w in new]
            self.flat = np.concatenate([self.flat, *parts])
            self.offset = np.concatenate([self.offset, self.offset[-1] + np.cumsum([len(p) for p in parts])])
        every = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        n = np.diff(self.offset)[every]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        values = self.flat[np.arange(total) + np.repeat(self.offset[every] - (ends - n), n)]
        sums = np.concatenate(([0], ends))
        bounds = sums[np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL, out: str = "piece_ids") -> DataFrame:
    """``docs`` with ``out`` (array<int>): whole texts as piece ids; null or empty: none.

    A literal meta symbol in a text is read as a space, as SentencePiece does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(model(path))
        for b in batches:
            for part in slices(b, b.schema.get_field_index(text_col)):
                ids = words.ids(part.column(part.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    clean = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(frugal(run), f"{fields}, `{out}` array<int>")


def decode(encoded: DataFrame, ids_col: str = "piece_ids", path: str = MODEL, out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``: the text of ``ids_col``; null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids_col))
            texts = [decode_ids(m, np.asarray(x.values)).decode("utf-8", "replace") if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    clean = encoded.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(frugal(run), f"{fields}, `{out}` string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(id, n_pieces, ids_sha256, decoded_sha256, round_trip) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        words = WordTable(m)
        for b in (part for whole in batches for part in slices(whole, 1)):
            data, at = utf8(b.column(1))
            n, ids_sha, text_sha, same = [], [], [], []
            for i, x in enumerate(words.ids(b.column(1))):
                ids = np.asarray(x.values).astype("<i4")
                text = decode_ids(m, ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
                same.append(text == data[at[i] : at[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(same)], names=["id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(frugal(run), f"id {kind}, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: piece count, digests, round trip."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
SQL: dict[str, str] = {}
