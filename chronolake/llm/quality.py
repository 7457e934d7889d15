"""Quality of documents by a regularised quadratic discriminant.

A document becomes ``STATISTICS``: counts of its whole text as logarithms and
shares, shares by a logit so that they spread near 0 and 1. Each class of
labelled documents has a mean and a covariance of them; a class covariance is
shrunk towards the pooled one, the more the fewer documents the class has, and
that one towards its diagonal. The score of a document comes from the
difference of the classes' log densities: squared Mahalanobis distances by
Cholesky factors that are computed once, plus log determinants and priors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import frugal, utf8
from .common import materialize, own_names
from .moments import by_key, products, sums

#: Shrinkage: of a class towards the pooled covariance (at least, and as so many documents a dimension), of that towards its diagonal, and the variance that every statistic has at least.
POOL, POOL_ROWS, DIAGONAL, LEAST_VARIANCE = 0.2, 2.0, 0.1, 1e-3
#: Densities of dependent statistics are too sure of themselves: their log difference counts this much.
TEMPER = 0.25
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "log_lines", "line_words",
    "letters", "upper", "digits", "stops", "other_symbols", "blanks", "symbol_words", "short_words",
    "distinct_words", "top_word", "repeated_lines", "capital_words", "entropy",
)

WORD_END = re.compile(rb"[^\s]*[A-Za-z0-9\x80-\xff][.,;:!?'\")]{0,2}\Z")


def _table(*ranges: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(b"".join(ranges))] = 1
    return out


LOWER, UPPER = bytes(range(97, 123)), bytes(range(65, 91))
#: Columns: letters (all bytes of multi-byte characters count), upper case, digits, stops, blanks.
CLASSES = np.stack([_table(LOWER, UPPER, bytes(range(128, 256))), _table(UPPER), _table(b"0123456789"), _table(b".,;:!?'\"()-"), _table(b" \t\n\v\f\r")], axis=1)


def logit(part: float, of: float, weight: float = 1.0) -> float:
    """log odds of a share, with half a unit of ``weight`` on both sides."""
    return float(np.log((part + weight / 2) / (of - part + weight / 2)))


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text in UTF-8; an empty one has them as well."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, stops, blanks = (hist @ CLASSES).tolist()
    n = len(text)
    words = text.split()
    lines = [x for x in (x.strip() for x in text.split(b"\n")) if x]
    seen, each = Counter(words), Counter(lines)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    w = len(words)
    odd = sum(k for x, k in seen.items() if not WORD_END.match(x))
    short = sum(k for x, k in seen.items() if len(x) <= 3)
    capital = sum(k for x, k in seen.items() if len(x) > 1 and x.isupper())
    top = seen.most_common(1)[0][1] if seen else 0
    p = hist[hist > 0] / max(n, 1)
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())), float(np.log1p(len(lines))), float(np.log1p(w / max(len(lines), 1))),
        logit(letters, n - blanks), logit(upper, letters), logit(digits, n - blanks), logit(stops, n - blanks), logit(n - blanks - letters - digits - stops, n - blanks), logit(blanks, n),
        logit(odd, w), logit(short, w), float(np.log1p(len(seen)) / np.log(w + 2)), logit(top, w), logit(len(lines) - len(each), len(lines)), logit(capital, w), float(-(p * np.log(p)).sum()),
    ]


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """All columns of ``docs`` but the text, and ``name`` with the statistics of the whole text (null: empty)."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(len(rest)))
            body = data.tobytes()
            found = [statistics(body[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(found, pa.list_(pa.float64()))], names=[*rest, name])

    sent = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != text_col)
    return sent.mapInArrow(frugal(run), f"{fields}, `{name}` array<double>")


def fit(rows: DataFrame, label: str, vector: str) -> dict:
    """The model of labelled statistics: rows a class, means, and inverse Cholesky factors with log determinants.

    All labelled rows are summed, in two aggregations: what comes to the
    driver is a mean and a number for each pair of statistics, for each class.
    Labels other than 0 and 1 are passed over. A class that no row has leaves
    the model without factors.
    """
    p = len(STATISTICS)
    known = rows.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("c"), F.col(vector).alias("s"))
    found = sums(known, "c", "s", p)
    n = {c: found[c][0] if c in found else 0 for c in (0, 1)}
    if not all(n.values()):
        return {"n": n}
    mean = {c: np.array(s) / m for c, (m, s) in found.items()}
    centred = F.zip_with("s", by_key(F.col("c"), {c: v.tolist() for c, v in mean.items()}), lambda a, b: a - b)
    scatter = products(known.select("c", centred.alias("d")), "c", "d", p)
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    model = {"n": n, "mean": mean, "inverse": {}, "log_det": {}}
    for c in (0, 1):
        share = max(POOL, POOL_ROWS * p / (POOL_ROWS * p + n[c]))
        own = (1 - share) * scatter[c] / n[c] + share * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + LEAST_VARIANCE * np.eye(p)
        factor = np.linalg.cholesky(own)
        model["inverse"][c] = np.linalg.inv(factor)
        model["log_det"][c] = float(2 * np.log(np.diag(factor)).sum())
    return model


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    """Tempered log odds of class 1 of rows of statistics."""
    density = {}
    for c in (0, 1):
        z = (x - model["mean"][c]) @ model["inverse"][c].T
        density[c] = -0.5 * (z * z).sum(axis=1) - 0.5 * model["log_det"][c]
    return TEMPER * (density[1] - density[0]) + np.log(model["n"][1] / model["n"][0])


def score(rows: DataFrame, model: dict, vector: str, name: str = "score") -> DataFrame:
    """All columns of ``rows`` but ``vector``, and ``name``: the chance of class 1.

    A model without factors gives every row the smoothed share of class 1
    among the labelled rows: 0.5 if there are none.
    """
    rest = [c for c in rows.columns if c not in (vector, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "inverse" in model:
                x = np.asarray(b.column(len(rest)).flatten()).reshape(b.num_rows, -1)
                chance = 1 / (1 + np.exp(-np.clip(log_odds(x, model), -700, 700)))
            else:
                chance = np.full(b.num_rows, (model["n"][1] + 1) / (model["n"][0] + model["n"][1] + 2))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(chance)], names=[*rest, name])

    sent = rows.select(*[F.col(f"`{c}`") for c in rest], F.col(vector))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name != vector)
    return sent.mapInArrow(frugal(run), f"{fields}, `{name}` double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is held out, as no label can belong to it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of ``docs``.

    Texts are read once: their statistics are written, and labels meet those.
    The model learns from rows of ``labels`` with a 0 or 1 whose id satisfies
    ``learn`` (a condition on ``id``; else: not ``held_out``). Null labels and
    ids teach nothing; several labels of a document, or rows that repeat an
    id, count once for each pair. Null texts are scored as empty ones. Other
    columns of both tables are not read. Empty tables: no rows, or without a
    label of each class the share of class 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    (stats,) = own_names(rows, "stats")
    known = materialize(with_statistics(rows, "text", stats))
    taught = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    taught = taught.filter(~held_out(F.col("id")) if learn is None else learn)
    model = fit(known.join(taught, "id"), "label", stats)
    out = score(known, model, stats).withColumn("held_out", held_out(F.col("id")))
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    return quality_scores(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


QUERIES = {"op11_quality": op11_quality}
SQL: dict[str, str] = {}
