"""Phrase collocations with exact counts.

Texts become shards of one language: pieces of words, every word between two
blanks, so that a phrase with its blanks matches whole words only.

1. Sketch. A shard sends, for each counter that one of its phrases of 1 to 5
   words hits, the hits. Counters are dealt over buckets of a fixed size, and
   buckets grow in number with the words of the corpus, so a bucket is summed in
   bounded memory and collisions stay as rare as they are. A sum is an upper bound
   of each of its phrases; a bucket answers each shard which of the counters it
   sent have reached the threshold.
2. Automata. The phrases of a shard whose counter has are its candidates. They
   are compiled into automata (several if many), which scan the shard and
   count all overlapping matches.
3. The counts of all shards are summed, and the threshold holds for the sums.
   Every phrase that reaches it is counted in every shard it occurs in, so
   results are exact. So are its parts, which are at least as frequent.

No phrase or sketch comes to the driver, and none is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import frugal, mix, release, utf8
from .common import discard, materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of a shard, and of all shards that a task has begun.
SHARD, BEGUN = 8 << 20, 32 << 20
#: Phrase occurrences that a bucket of the sketch is meant for, and counters for each.
BUCKET, SLACK = 1 << 22, 4
#: Bytes of the phrases of one automaton.
AUTOMATON = 1 << 20
#: Bytes of a shard whose words are read at a time, phrase occurrences whose counters are, and phrases whose counts are sent at a time.
CHUNK, SLICE, SENT = 1 << 20, 1 << 20, 1 << 17

#: A-Z lower-cased, piece ends as line feeds, tabs as blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: bytes) -> Iterator[bytes]:
    """The pieces of a text that have words: words between single blanks, with one before and after."""
    for p in text.translate(FOLD).split(b"\n"):
        words = p.split()
        if words:
            yield b" " + b" ".join(words) + b" "


def shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(shard, lang, words, body): the pieces of all texts, by language, line feeds between.

    A null language is ``und``. Long texts are cut at pieces; a piece is never
    cut, as a phrase could lie across.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        begun: dict[str, list] = {}
        held = 0

        def close(langs: list[str]) -> pa.RecordBatch:
            nonlocal number, held
            rows = []
            for lang in langs:
                size, parts = begun.pop(lang)
                held -= size
                rows.append((number, lang, sum(p.count(b" ") - 1 for p in parts), b"\n".join(parts)))
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["shard", "lang", "words", "body"])

        for b in batches:
            data, at = utf8(b.column(1))
            body = data.tobytes()
            for i, lang in enumerate(b.column(0).to_pylist()):
                for p in pieces(body[at[i] : at[i + 1]]):
                    mine = begun.setdefault(lang, [0, []])
                    mine[0] += len(p) + 1
                    mine[1].append(p)
                    held += len(p) + 1
                    if mine[0] >= SHARD:
                        yield close([lang])
                if held >= BEGUN:
                    yield close(list(begun))
        if begun:
            yield close(list(begun))

    sent = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return sent.mapInArrow(frugal(run), "shard long, lang string, words long, body binary")


class Shard:
    """A shard's words with the hashes of its phrases.

    ``first`` and ``second`` are two independent 64-bit hashes of each distinct
    word, seeded by the language.
    """

    def __init__(self, lang: str, body: bytes):
        self.body = body
        data = np.frombuffer(body, np.uint8)
        blank = np.flatnonzero(data == 32).astype(np.int32)
        word = data[blank[:-1] + 1] != 10
        self.start, self.end = blank[:-1][word], blank[1:][word] + 1
        self.piece = np.cumsum(~word, dtype=np.int32)[word]
        del blank, word
        code: dict[bytes, int] = {}
        codes, at = [np.zeros(0, np.int32)], 0
        while at < len(body):
            # To the end of a piece.
            end = body.find(b"\n", at + CHUNK) + 1 or len(body)
            words = body[at:end].split()
            for w in set(words) - code.keys():
                code[w] = len(code)
            codes.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
            at = end
        self.codes = np.concatenate(codes)
        seed = xxhash.xxh64_intdigest(lang.encode())
        both = [xxhash.xxh3_128_intdigest(w, seed) for w in code]
        low = (1 << 64) - 1
        self.first, self.second = (np.array([x >> s & low for x in both], np.uint64) for s in (0, 64))

    def hashes(self, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, positions, counters) of all phrases, by length; a counter has ``bits`` bits."""
        h = self.first[self.codes]
        g = h.copy()
        for k in range(1, LONGEST + 1):
            if k > 1:
                if len(h) < k:
                    return
                g = g[: len(h) - k + 1] * STEP + h[k - 1 :]
            at = np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(h) - k + 1])
            yield k, at, mix(g[at] + np.uint64(k)) >> np.uint64(64 - bits)

    def names(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the phrases of ``k`` words at these places."""
        out = []
        for table in (self.first, self.second):
            g = table[self.codes[at]]
            for j in range(1, k):
                g = g * STEP + table[self.codes[at + j]]
            out.append(g)
        return tuple(out)

    def slices(self, bits: int, outer: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """(counters rising, hits of each, (bucket, begin, end) of each bucket in them): some whole buckets at a time."""
        found, n = np.empty(LONGEST * len(self.codes), np.uint64), 0
        for _, at, c in self.hashes(bits):
            found[n : n + len(at)] = c
            n += len(at)
        found = found[:n]
        found.sort()
        shift, at = np.uint64(bits - outer), 0
        while at < n:
            last = found[min(at + SLICE, n) - 1] >> shift
            end = int(np.searchsorted(found, (last + np.uint64(1)) << shift))
            part = found[at:end]
            new = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            counter = part[new]
            bucket = (counter >> shift).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            yield counter, np.diff(np.append(new, len(part))), list(zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            at = end

    def hits(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(counters rising, hits of each)."""
        both = [(counter, hits) for counter, hits, _ in self.slices(bits, 0)]
        return tuple(np.concatenate(x) for x in zip(*both, strict=True))


def sketch_size(words: int) -> tuple[int, int]:
    """(bits of a counter's number, bits of its bucket's) for a corpus of so many words."""
    inner = (BUCKET * SLACK - 1).bit_length()
    outer = max(0, (LONGEST * words - 1) // BUCKET).bit_length()
    return inner + outer, outer


def cells(parts: DataFrame, bits: int, outer: int) -> DataFrame:
    """(bucket, shard, cell): the hits of a shard in each bucket, 5 bytes a counter before compression.

    A cell holds the differences of counters as byte planes, then the hits;
    those above 255 travel as 255, as only whether a sum reaches ``LEAST`` is asked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, lang, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for counter, hits, buckets in Shard(lang, body).slices(bits, outer):
                    inner = (counter & np.uint64((1 << (bits - outer)) - 1)).astype(np.uint32)
                    hits = np.minimum(hits, 255).astype(np.uint8)
                    out = []
                    for _, i, j in buckets:
                        gap = np.diff(inner[i:j], prepend=np.uint32(0)).astype("<u4")
                        out.append(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4).T).tobytes() + hits[i:j].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in buckets], pa.int64()), pa.array([shard] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "shard", "cell"])

    return parts.select("shard", "lang", "body").mapInArrow(frugal(run), "bucket long, shard long, cell binary")


def _opened(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(cell, np.uint8).reshape(5, -1)
    gap = np.ascontiguousarray(data[:4].T).view("<u4").ravel()
    return np.cumsum(gap, dtype=np.uint32), data[4]


def reached(sent: DataFrame, least: int, bits: int, outer: int) -> DataFrame:
    """(shard, bucket, mask): which counters of a cell, in its order, have a sum of ``least`` or more.

    Cells without one get no answer. A bucket's counters are one array of fixed size.
    """

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << (bits - outer), np.int32)
        for cell in t.column("cell"):
            inner, hits = _opened(cell.as_py())
            # A counter stands once in a cell; beyond the threshold it need not grow.
            total[inner] = np.minimum(total[inner] + hits, least)
        hot = total >= least
        shard, mask = [], []
        for s, cell in zip(t.column("shard").to_pylist(), t.column("cell"), strict=True):
            yes = hot[_opened(cell.as_py())[0]]
            if yes.any():
                shard.append(s)
                mask.append(np.packbits(yes).tobytes())
        release()
        return pa.table({"shard": pa.array(shard, pa.int64()), "bucket": pa.array([t.column("bucket")[0].as_py()] * len(shard), pa.int64()), "mask": pa.array(mask, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(add, "shard long, bucket long, mask binary")


def candidates(shard: Shard, bits: int, outer: int, masks: dict[int, bytes]) -> Iterator[list[str]]:
    """The phrases of a shard, blanks around, whose counters reach the threshold: each once, those of an automaton at a time."""
    hot = [np.zeros(0, np.uint64)]
    for counter, _, buckets in shard.slices(bits, outer):
        for bucket, i, j in buckets:
            mask = masks.get(bucket)
            if mask:
                hot.append(counter[i:j][np.unpackbits(np.frombuffer(mask, np.uint8), count=j - i).astype(bool)])
    hot = np.concatenate(hot)
    if not len(hot):
        return
    low = np.uint64((1 << 22) - 1)
    maybe = np.zeros(1 << 22, bool)
    maybe[hot & low] = True
    places, last = [], []
    for k, at, c in shard.hashes(bits):
        use = np.flatnonzero(maybe[c & low])
        c = c[use]
        place = np.minimum(np.searchsorted(hot, c), len(hot) - 1)
        at = at[use[hot[place] == c]].astype(np.int32)
        del use, c, place
        if not len(at):
            continue
        one, two = shard.names(at, k)
        order = np.lexsort((two, one))
        one, two, at = one[order], two[order], at[order]
        # A place for each phrase.
        at = at[np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))]
        places.append(at)
        last.append(at + np.int32(k - 1))
        del one, two, order
    del hot, maybe
    if not places:
        return
    at, last = np.concatenate(places), np.concatenate(last)
    # Phrases that begin alike stand together, so that an automaton shares what they begin with.
    order = np.argsort(shard.codes[at], kind="stable")
    begin, end = shard.start[at[order]], shard.end[last[order]]
    del places, at, last, order
    size = np.cumsum(end - begin, dtype=np.int64)
    cut = [0, *(np.flatnonzero(np.diff(size // AUTOMATON)) + 1).tolist(), len(size)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield [shard.body[a:b].decode() for a, b in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)]


def matches(text: str, phrases: list[str]) -> Iterator[tuple[str, int]]:
    """Each distinct phrase with the number of its overlapping matches, by automata of bounded size."""
    phrases = sorted(set(phrases))
    at = 0
    while at < len(phrases):
        machine, size, begin = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, at
        while at < len(phrases) and (size < AUTOMATON or at == begin):
            machine.add_word(phrases[at], at - begin)
            size += len(phrases[at])
            at += 1
        machine.make_automaton()
        found = np.fromiter(map(itemgetter(1), machine.iter(text)), np.int32)
        yield from zip(phrases[begin:at], np.bincount(found, minlength=at - begin).tolist(), strict=True)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f, size) of every phrase of 1 to 5 words with f >= least, (lang, n) of all words).

    Both are written tables. Null texts are empty; null languages are ``und``.
    ``least`` is at most 255, as hits travel in a byte.
    """
    if not 0 < least <= 255:
        raise ValueError("least must be between 1 and 255")
    parts = materialize(shards(docs, text_col, lang_col), wide=True)
    words = parts.groupBy("lang").agg(F.sum("words").alias("n"))
    total = materialize(words)
    # One number.
    bits, outer = sketch_size(total.agg(F.sum("n")).first()[0] or 0)
    masks = materialize(reached(cells(parts, bits, outer), least, bits, outer))

    def packed(lang: str, found: list[tuple[str, int]]) -> pa.RecordBatch:
        # A row for each bucket of phrases: counts travel packed, and are unpacked where they are summed.
        bucket = np.array([zlib.crc32(p.encode()) for p, _ in found], np.int64) & ((1 << outer) - 1)
        order = np.argsort(bucket, kind="stable")
        new = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = pa.array(np.append(new, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array([found[i][c] for i in order.tolist()], t)) for c, t in enumerate((pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(bucket[order][new], pa.int64()), *lists], names=["lang", "part", "phrases", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, body, have = None, None, {}
        for b in batches:
            for i in np.flatnonzero(b.column(2).is_valid()).tolist():
                lang, body = b.column(1)[i].as_py(), b.column(2)[i].as_py()
            have |= {k: m for k, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if m}
        if have and body is not None:
            text, found = body.decode(), []
            for some in candidates(Shard(lang, body), bits, outer, have):
                found += [(p[1:-1], n) for p, n in matches(text, some) if n]
                if len(found) >= SENT:
                    yield packed(lang, found)
                    found = []
            if found:
                yield packed(lang, found)
            del text, found
        del body, have
        release()

    def add(t: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.chunked_array([x.flatten() for x in t.column(name).chunks]) for c, name in (("phrase", "phrases"), ("f", "counts"))})
        total = flat.group_by("phrase").aggregate([("f", "sum")])
        total = total.filter(pa.compute.greater_equal(total.column("f_sum"), least))
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * total.num_rows, pa.string()), "phrase": total.column("phrase"), "f": total.column("f_sum")})

    # A shard and its answers in one group, which sends what it has counted an automaton or more at a time.
    both = parts.select("shard", "lang", "body").unionByName(masks, allowMissingColumns=True).select("shard", "lang", "body", "bucket", "mask")
    sent = both.groupBy("shard").applyInArrow(scan, "lang string, part long, phrases array<string>, counts array<long>")
    counts = sent.groupBy("lang", "part").applyInArrow(add, "lang string, phrase string, f long")
    counts = counts.withColumn("size", F.size(F.split("phrase", " ")))
    return materialize(counts, parts, masks), total


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates of 2 words or more, by their lowest-scoring cut."""
    parted = counts.filter("size > 1").withColumn("words", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parted = parted.select(
        "lang", "phrase", F.col("f").alias("a"), "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    joined = parted.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(words, "lang")
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    joined = joined.withColumn("score", F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})"))
    best = joined.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_parts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` without those that lie inside a longer candidate that is as frequent."""
    longer = counts.filter("size > 2").withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(2, size - 1)")))
    inside = longer.withColumn("at", F.explode(F.expr("sequence(1, size - k + 1)"))).select("lang", F.expr("array_join(slice(words, at, k), ' ')").alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases.

    By score and frequency down, then phrase by its bytes. A repeated row
    counts as often as it stands there, ids are not read. Null and empty texts
    add nothing; an empty table gives no rows. A piece without a stop is held
    whole, whatever its length.
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least)
    kept = without_parts(scored(counts, words), counts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_phrases": op13_phrases}
SQL: dict[str, str] = {
    "op13_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), listed AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), total AS (
            SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM listed GROUP BY 1
        ), placed AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k
        ), f AS (
            SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, CAST(count(*) AS HUGEINT) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100
        ), parted AS (
            SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
        ), cuts AS (
            SELECT p.lang, p.phrase, p.a, p.cut, x.f AS l, y.f AS r, n, (1000 * p.a * n) // (x.f * y.f) AS score
            FROM parted p JOIN total USING (lang)
            JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.w, 1, p.cut), ' ')
            JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.w, p.cut + 1, p.k), ' ')
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), sized AS (
            SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2
        ), spread AS (
            SELECT lang, w, m, f, unnest(range(1, k - m + 2)) AS i FROM sized
        ), longer AS (
            SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(f) AS most FROM spread GROUP BY 1, 2
        ), kept AS (
            SELECT c.* FROM lowest c LEFT JOIN longer o USING (lang, phrase) WHERE o.most IS NULL OR 100 * o.most < 100 * c.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM kept QUALIFY rank <= 2000
    """,
}
