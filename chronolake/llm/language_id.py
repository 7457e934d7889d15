"""Language identification with error-correcting output codes.

Every language has a codeword; one binary n-gram classifier predicts each bit.
A classifier starts from the log odds of byte 3-grams in the languages whose
bit is 1 against the others, and is then fitted to its bit by logistic
regression: in each round every labelled training document is read, tasks sum
their gradients, and a step that does not lower the loss is taken back and halved.
A text's margins are decoded by loss: the codeword with the least weighted
logistic loss wins, a bit weighing by how seldom its classifier errs on the
training documents, and a near tie with the runner-up is flagged as ambiguous.
``keep_known`` also rejects: a text far less likely in the languages it decodes
to than labelled documents of its length is in no language that was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import frugal, utf8

BUCKETS = 1 << 13
#: Rounds of fitting, the first step, and the least error that a bit's weight takes for true.
ROUNDS, STEP, LEAST_ERROR = 4, 0.3, 1e-4
AMBIGUOUS = 0.6
#: Rejection: 3-grams of a stretch that is decoded by itself, labelled documents that a length class needs, their quantile, and how far beyond it (in nats a 3-gram).
STRETCH, CLASS_LEAST, QUANTILE, BEYOND = 64, 100, 0.99, 2.0
SCALE = 4.0

#: Bytes as features: A-Z lower-cased, a-z and all bytes of multi-byte characters kept, the rest one gap.
FOLD = np.zeros(256, np.uint64)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of each 3-gram that is not all gap."""
    x = FOLD[data]
    if len(x) < 3:
        x = np.concatenate((np.zeros(2, np.uint64), x))
    if len(x) < 3:
        return np.zeros(0, np.int64)
    key = x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)
    key = key[key > 0]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, n, counts array<long>): 3-gram counts of each label's texts.

    A task adds up its own texts and sends one row for each label, so the
    shuffle holds a row for each label and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            data, at = utf8(b.column(1))
            for i, label in enumerate(b.column(0).to_pylist()):
                have = total.setdefault(label, [0, np.zeros(BUCKETS, np.int64)])
                have[0] += 1
                have[1] += np.bincount(grams(data[at[i] : at[i + 1]]), minlength=BUCKETS)
        rows = [(k, v[0], v[1]) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))],
            names=["label", "n", "counts"],
        )

    def add(t: pa.Table) -> pa.Table:
        counts = sum(np.asarray(x.values) for x in t.column("counts"))
        return pa.table({"label": t.column("label")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": pa.array([counts.tolist()], pa.list_(pa.int64()))})

    kind = "label string, n long, counts array<long>"
    sent = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(frugal(run), kind)
    # Halfway sums first, so that one label's rows from many tasks do not meet in one.
    salted = sent.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    half = salted.groupBy("label", "salt").applyInArrow(lambda t: add(t.drop(["salt"])), kind)
    return half.groupBy("label").applyInArrow(add, kind)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of 0 and 1: all columns that split k languages if k is 5 or less,
    else 8 * ceil(log2 k) random ones with both values in each and rows distinct."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        return np.array([[(c >> i) & 1 for c in range(1, 2 ** (k - 1))] for i in range(k)], np.int8)
    rng = np.random.default_rng(seed)
    n = 8 * int(np.ceil(np.log2(k)))
    while True:
        m = rng.integers(0, 2, (k, n)).astype(np.int8)
        if (m.min(axis=0) < m.max(axis=0)).all() and len(np.unique(m, axis=0)) == k:
            return m


def gradients(docs: DataFrame, labels: list[str], n: list[int], code: np.ndarray, odds: np.ndarray, text_col: str, label_col: str) -> tuple[np.ndarray, ...]:
    """(gradient, curvature, loss, error) of the bits' logistic losses over all labelled documents.

    Every language has the same weight in all. A task sends one row of sums, and
    they are added up in 16 groups; that many rows come to the driver.
    """
    row, bits = {x: i for i, x in enumerate(labels)}, code.shape[1]
    share = 1.0 / (np.array(n) * len(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bend, rest = np.zeros((BUCKETS, bits)), np.zeros(BUCKETS), np.zeros((2, bits))
        for b in batches:
            data, at = utf8(b.column(1))
            for i, label in enumerate(b.column(0).to_pylist()):
                g = grams(data[at[i] : at[i + 1]])
                if not len(g):
                    continue
                count = np.bincount(g, minlength=BUCKETS)
                use = np.flatnonzero(count)
                x, k = count[use] / len(g), row[label]
                sign = 2 * code[k] - 1
                m = sign * (x @ odds[use]) * SCALE
                slope[use] += x[:, None] * (share[k] * SCALE * sign / (1 + np.exp(np.minimum(m, 700))))
                bend[use] += share[k] * SCALE * SCALE * x * x / 4
                rest += share[k] * np.stack([np.logaddexp(0, -m), m <= 0])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([slope.ravel(), bend, rest.ravel()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.asarray(x.values) for x in t.column("sums")).tolist()], pa.list_(pa.float64()))})

    sent = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "sums array<double>")
    salted = sent.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    rows = salted.groupBy("salt").applyInArrow(lambda t: add(t.drop(["salt"])), "sums array<double>").collect()
    total = sum(np.array(r["sums"]) for r in rows)
    slope, bend, rest = np.split(total, [BUCKETS * bits, BUCKETS * (bits + 1)])
    return slope.reshape(BUCKETS, bits), bend, *rest.reshape(2, bits)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", rounds: int = ROUNDS) -> dict:
    """The model: labels, codewords, log odds (buckets x bits) and bit weights.

    Learns every label from all rows that have one. What comes to the driver is
    one row of ``BUCKETS`` counts for each label, and in each round 16 rows of
    as many sums for each bit. No labelled row: an empty model.
    """
    known = docs.filter(F.col(label_col).isNotNull())
    rows = sorted(gram_counts(known, text_col, label_col).collect(), key=lambda r: r["label"])
    labels = [r["label"] for r in rows]
    if not labels:
        return {"labels": [], "code": np.zeros((0, 1)), "odds": np.zeros((BUCKETS, 1)), "weights": np.ones(1), "logs": np.zeros((BUCKETS, 1))}
    counts = np.array([r["counts"] for r in rows], float)
    rates = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(labels)).astype(float)
    if len(labels) == 1:
        return {"labels": labels, "code": code, "odds": np.zeros((BUCKETS, 1)), "weights": np.ones(1), "logs": np.log(rates).T}
    ones = code.T @ rates / code.sum(axis=0)[:, None]
    zeros = (1 - code).T @ rates / (1 - code).sum(axis=0)[:, None]
    odds, step, best = np.log(ones / zeros).T, STEP, None
    for _ in range(rounds + 1):
        slope, bend, loss, error = gradients(known, labels, [r["n"] for r in rows], code, odds, text_col, label_col)
        if best is None or loss.sum() < best[1].sum():
            best = (odds, loss, error, slope / (bend + bend.mean())[:, None])
        else:
            step /= 2
        odds = best[0] + step * best[3]
    weights = np.log((1 - best[2] + LEAST_ERROR) / (best[2] + LEAST_ERROR))
    return {"labels": labels, "code": code, "odds": best[0].astype(np.float32), "weights": np.clip(weights, 0.05, None), "logs": np.log(rates).T.astype(np.float32)}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", label: str = "lang_pred", score: str = "score", unsure: str = "ambiguous", scale: float = SCALE) -> DataFrame:
    """All columns of ``docs`` with ``label``, ``score`` (0 to 1) and ``unsure``.

    Columns of ``docs`` with these names are replaced.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned. The score is the share of exp(-loss) that the winner has; under
    ``AMBIGUOUS`` the row is flagged. Ties go to the first label by name.
    """
    labels, sign, w = model["labels"], 2 * model["code"] - 1, model["weights"] / model["weights"].sum()
    odds = model["odds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            data, at = utf8(column)
            seen = pa.compute.match_substring_regex(column, r"\p{L}").fill_null(False).to_pylist()
            names, scores, doubts = [], [], []
            for i in range(b.num_rows):
                if not seen[i] or not labels:
                    names.append("und")
                    scores.append(0.0)
                    doubts.append(True)
                    continue
                g = grams(data[at[i] : at[i + 1]])
                count = np.bincount(g, minlength=BUCKETS)
                use = np.flatnonzero(count)
                margin = (count[use] @ odds[use]) / max(len(g), 1)
                loss = np.logaddexp(0, -sign * margin * scale) @ w
                share = np.exp((loss.min() - loss) * scale)
                best = int(loss.argmin())
                names.append(labels[best])
                scores.append(float(share[best] / share.sum()))
                doubts.append(scores[-1] < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], names=[*b.schema.names, label, score, unsure])

    clean = docs.drop(label, score, unsure)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(frugal(run), f"{fields}, `{label}` string, `{score}` double, `{unsure}` boolean")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 by 3; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(True))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def misfit(g: np.ndarray, model: dict) -> float:
    """How unlikely the 3-grams are in the languages that decoding gives: the mean of -log(rate).

    Stretches are decoded apart, each by the codeword with the least weighted
    loss, so a text in two languages fits about as well as one in either. A
    last stretch of under half the length joins the one before.
    """
    if not len(g):
        return 0.0
    starts = np.arange(0, max(len(g) - STRETCH // 2, 1), STRETCH)
    size = np.diff(np.append(starts, len(g)))
    m = np.add.reduceat(model["odds"][g].astype(float), starts, axis=0) / size[:, None] * SCALE
    w = model["weights"] / model["weights"].sum()
    # log(1 + e^-m) = log(1 + e^m) - m, so the losses differ by the margins on a codeword's ones.
    best = ((m * w) @ model["code"].T).argmax(axis=1)
    return float(-model["logs"][g, np.repeat(best, size)].mean())


def misfits(docs: DataFrame, model: dict, text_col: str = "text", name: str = "_misfit", length: str = "_length") -> DataFrame:
    """All columns of ``docs`` with the misfit of each text and its length class: the bits of its number of 3-grams.

    The misfit of a text without a letter, or a null one, is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            data, at = utf8(column)
            found = [grams(data[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            seen = pa.compute.match_substring_regex(column, r"\p{L}").fill_null(False).to_pylist()
            fits = [misfit(g, model) if k else None for g, k in zip(found, seen, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fits, pa.float64()), pa.array([len(g).bit_length() for g in found], pa.int32())], names=[*b.schema.names, name, length])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(frugal(run), f"{fields}, `{name}` double, `{length}` int")


def levels(docs: DataFrame, model: dict, text_col: str = "text", label_col: str = "lang") -> dict[int, float]:
    """The greatest misfit that passes, by length class.

    ``BEYOND`` over the ``QUANTILE`` of all labelled documents of the class. A
    class with under ``CLASS_LEAST`` of them takes the level of the next
    shorter class that has one; with none, nothing of it is rejected. One row
    a class comes to the driver.
    """
    seen = misfits(docs.filter(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text")), model).select("_misfit", "_length")
    rows = seen.groupBy("_length").agg(F.count("*").alias("n"), F.percentile_approx("_misfit", QUANTILE, 10_000).alias("q")).collect()
    own = {r["_length"]: r["q"] + BEYOND for r in rows if r["n"] >= CLASS_LEAST}
    return {k: own[max(x for x in own if x <= k)] for k in range(min(own), 40)} if own else {}


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts whose language is undetermined.

    Those are null or have no letter (``und``), or no learned language fits
    them: their misfit is beyond the level of their length class. If no document has a
    label, nothing is learned, and texts with a letter stay; with one label
    there is nothing to decode, and no level either.
    """
    model = fit(docs)
    if not model["labels"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    if len(model["labels"]) == 1:
        return predict(docs, model, label="_lang_pred", score="_lang_score", unsure="_lang_unsure").filter(F.col("_lang_pred") != "und").select(*docs.columns)
    level = levels(docs, model)
    most = F.coalesce(F.create_map(*[F.lit(x) for k, v in sorted(level.items()) for x in (k, v)])[F.col("_length")], F.lit(float("inf"))) if level else F.lit(float("inf"))
    return misfits(docs, model).filter(F.col("_misfit") <= most).select(*docs.columns)


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
