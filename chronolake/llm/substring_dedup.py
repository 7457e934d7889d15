"""Substring dedup by recompression.

A text is a sequence of word symbols. A round names maximal runs of one symbol,
then, with a coin for each symbol that is fixed for the round, names each pair
of a heads symbol and the tails symbol after it. A name is a 64-bit hash of
what it stands for, the same in every task, so a round is global without an
exchange and equal stretches get equal symbols inside, whatever surrounds them.
Symbols of a high level are exchanged: one that occurs earlier reveals a long
repeat, its words are compared with those of the earlier one, and its inner
windows need no look of their own. What no shared symbol settles (the ends of
repeats, short ones, and all that is unique) goes by an exchange of the
windows themselves, which compares their words as well. No name is trusted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import frugal, mix, strings
from .chunks import CHUNK_SCHEMA, Chunk, Rolling, Runs, buckets, bytes8, carried, chunk_of, cover, earlier, minima, pack_chunks, spread, with_masks
from .common import materialize

WINDOW, LEVEL = 20, 14
#: Words of a gram; the least of a window's is its minimizer.
GRAM = 3
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Masks of the first bytes of a word of up to 8.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_symbols(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch: of its length and its first, middle and last 8 bytes."""
    size = ends - starts
    eight = bytes8(text)
    h = size.astype(np.uint64)
    for at in (starts, np.maximum((starts + ends) // 2 - 4, starts), np.maximum(ends - 8, starts)):
        h += eight[at] & FIRST[np.minimum(size, 8)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return mix(h)


class Words:
    """The words of a chunk: symbols, documents, and bytes.

    ``line`` is the text with one space after each word and nothing else;
    ``line_at`` has where each word starts in it, and its length at last.
    """

    def __init__(self, c: Chunk):
        # A space after each document.
        n = len(c.sizes)
        text = np.full(len(c.bytes) + n, 0x20, np.uint8)
        for d, (a, z) in enumerate(zip(c.starts.tolist(), c.ends.tolist(), strict=True)):
            text[a + d : z + d] = c.bytes[a:z]
        self.ink = ~SPACE[text]
        after = np.zeros(len(text), bool)
        after[1:] = self.ink[:-1] & ~self.ink[1:]
        text[after] = 0x20
        self.line = text[self.ink | after]
        stop = np.flatnonzero(self.line == 0x20)
        self.line_at = np.concatenate(([0], stop + 1))
        self.symbols = word_symbols(self.line, self.line_at[:-1], stop)
        self.doc_end = np.searchsorted(np.flatnonzero(after), c.ends + np.arange(n), side="right")
        self.doc_start = np.concatenate(([0], self.doc_end[:-1]))[:n]
        self.doc = np.repeat(np.arange(n), self.doc_end - self.doc_start)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts and ends in the chunk's bytes."""
        begin, stop = self.ink.copy(), self.ink.copy()
        begin[1:] &= ~self.ink[:-1]
        stop[:-1] &= ~self.ink[1:]
        return np.flatnonzero(begin) - self.doc, np.flatnonzero(stop) + 1 - self.doc

    def runs(self, size: int, done: np.ndarray, total: int) -> tuple[Runs, np.ndarray]:
        """(runs, first words) of the windows of ``size`` words that are not ``done``."""
        n = len(self.symbols)
        at = np.flatnonzero((self.doc_end[self.doc] - np.arange(n) >= size) & ~done)
        follows = np.ones(len(at), bool)
        follows[1:] = (self.doc[at][1:] == self.doc[at][:-1]) & (at[1:] == at[:-1] + 1)
        gram = self.symbols.copy()
        width = min(GRAM, size)
        for k in range(1, width):
            gram[: max(n - k, 0)] *= np.uint64(0x94D049BB133111EB)
            gram[: max(n - k, 0)] += self.symbols[k:]
        least = minima((mix(gram) >> np.uint64(32)).astype(np.uint32), size - width + 1)[at]
        return Runs(self.line, self.line_at[at], self.line_at[at + size] if n else at, lambda w: self.doc[at[w]], follows, least, total), at


def cut_windows(size: int) -> Callable:
    """The windows of ``size`` words of a bucket's strings."""

    def cut(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
        stop = np.flatnonzero(text == 0x20)
        start = np.concatenate(([0], stop[:-1] + 1))
        lead = np.searchsorted(stop, begins)
        n = np.searchsorted(stop, ends) - lead - size + 1
        string = np.repeat(np.arange(len(n), dtype=np.int32), n)
        word = np.repeat(lead - (np.cumsum(n) - n), n) + np.arange(len(string))
        h = Rolling(word_symbols(text, start, stop)).windows(size)
        return start[word], stop[word + size - 1] + 1, h[word], string

    return cut


def whole_strings(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each string of a bucket as one window."""
    return begins, ends, word_symbols(text, begins, ends), np.arange(len(begins))


def name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = mix(a + np.uint64(salt))
    h ^= b
    h *= np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def recompress(symbols: np.ndarray, doc: np.ndarray, levels: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, first places, lengths) after each of ``levels`` rounds."""
    s, at, d = symbols, np.arange(len(symbols)), doc
    out = []
    for level in range(1, max(levels) + 1):
        if len(s):
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(s)))
            s, at, d = s[first], at[first], d[first]
            run = length > 1
            s = s.copy()
            s[run] = name(s[run], length[run].astype(np.uint64), 2 * level)
            heads = (mix(s + np.uint64(level)) >> np.uint64(63)).astype(bool)
            pair = np.zeros(len(s), bool)
            pair[:-1] = heads[:-1] & ~heads[1:] & (d[1:] == d[:-1])
            left = np.flatnonzero(pair)
            s[left] = name(s[left], s[left + 1], 2 * level + 1)
            keep = np.ones(len(s), bool)
            keep[left + 1] = False
            s, at, d = s[keep], at[keep], d[keep]
        if level in levels:
            out.append((s, at, np.diff(np.append(at, len(symbols)))))
    # A symbol's words end where the next symbol's start; documents are contiguous.
    return out


def long_symbols(w: Words, size: int, total: int) -> tuple[Runs, np.ndarray, np.ndarray]:
    """(runs, first words, lengths) of the symbols of level ``LEVEL`` of at least ``size`` words."""
    s, at, n = recompress(w.symbols, w.doc, (LEVEL,))[0]
    long = n >= size
    s, at, n = s[long], at[long], n[long]
    return Runs(w.line, w.line_at[at], w.line_at[at + n], lambda i: w.doc[at[i]], np.zeros(len(at), bool), (s >> np.uint64(32)).astype(np.uint32), total), at, n


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, carry: tuple[str, ...] = (), spacing: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept text) and ``carry`` for each row of ``docs``.

    A word goes if a window of ``size`` words over it has its word sequence
    start earlier: in a smaller id, or in the same text at an earlier word.
    Rows that repeat an id stand in the order of a hash of their texts, null
    ids before all others. Null and empty texts have no words. Words stay as
    they are; those kept are joined by one space, or, with ``spacing``, keep
    the white space between words that stood together, and a text that loses
    nothing stays whole.
    """
    chunks = pack_chunks(docs, id_col, text_col, carry=carry)
    total = buckets(chunks)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for i in range(b.num_rows):
                w = Words(chunk_of(b, i))
                sent, at, n = long_symbols(w, size, total)
                hit = sent.hits(b.column("masks")[i].as_py(), False)
                done.append(np.packbits(spread(at[hit], n[hit] - size + 1, len(w.symbols))).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k.split()[0]) for k in CHUNK_SCHEMA.split(", ")), pa.array(done, pa.binary())], names=[*(k.split()[0] for k in CHUNK_SCHEMA.split(", ")), "done"])

    symbols = with_masks(chunks, earlier(chunks, lambda b, i: long_symbols(Words(chunk_of(b, i)), size, total)[0], whole_strings, False, total))
    chunks = materialize(symbols.mapInArrow(frugal(settle), f"{CHUNK_SCHEMA}, done binary"), chunks, codec="none")

    def unsettled(b: pa.RecordBatch, i: int) -> tuple[Chunk, Words, Runs, np.ndarray, np.ndarray]:
        c = chunk_of(b, i)
        w = Words(c)
        done = np.unpackbits(np.frombuffer(b.column("done")[i].as_py(), np.uint8), count=len(w.symbols)).astype(bool)
        return c, w, *w.runs(size, done, total), done

    masks = earlier(chunks, lambda b, i: unsettled(b, i)[2], cut_windows(size), False, total)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, w, rest, at, gone = unsettled(b, i)
                gone[at[rest.hits(b.column("masks")[i].as_py(), False)]] = True
                cut = cover(gone, size)
                body, line, line_at = c.bytes.tobytes(), w.line.tobytes(), w.line_at.tolist()
                starts, ends = (x.tolist() for x in w.spans()) if spacing else ([], [])
                kept = []
                for d, (lo, hi) in enumerate(zip(w.doc_start.tolist(), w.doc_end.tolist(), strict=True)):
                    if spacing and not cut[lo:hi].any():
                        kept.append(body[c.starts[d] : c.ends[d]])
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], cut[lo:hi], [True])).astype(np.int8))).tolist()
                    stretches = [(lo + a, lo + z) for a, z in zip(edge[::2], edge[1::2], strict=True)]
                    if spacing:
                        kept.append(b" ".join([body[starts[a] : ends[z - 1]] for a, z in stretches]))
                    else:
                        kept.append(b"".join([line[line_at[a] : line_at[z]] for a, z in stretches])[:-1])
                sums = np.concatenate(([0], np.cumsum(cut)))
                words = w.doc_end - w.doc_start
                yield pa.RecordBatch.from_arrays([c.ids, pa.array(words), pa.array(sums[w.doc_end] - sums[w.doc_start]), strings(kept), *(carried(b, i) if carry else [])], names=[f.split()[0] for f in fields])

    fields = ["_id long", "_words long", "_removed long", "_kept string", *(f"_carry{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))]
    out = materialize(with_masks(chunks, masks).mapInArrow(frugal(finish), ", ".join(fields)), chunks)
    return out.toDF(id_col, "n_words", "n_removed", "kept", *carry)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left after windows of 20 words that start earlier."""
    out = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL: dict[str, str] = {}
