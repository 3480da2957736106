"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance, shrunk towards the covariance pooled over classes
and towards its own mean variance. A score is the logistic of the difference of the classes'
Gaussian log-densities, each a Mahalanobis distance through the inverse of the covariance's
Cholesky factor, which is computed once on the driver and cached in the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import quoted, ship, utf8

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
_ENDS = b".,;:?"
_SIGNS = b"#*$%&<>{}[]~^_=+@\\/"

FEATURES = ("words", "word_length", "upper", "signs", "bars", "exclaims", "ends", "digits", "distinct", "lines", "repeated_lines", "short_words", "accents")


def features(text: bytes) -> list[float]:
    """Transformed statistics of a whole UTF-8 text; every text, empty too, has finite values."""
    words = text.split()
    n, size = len(words), len(text) + 1
    counts = [size - 1 - len(text.translate(None, chars)) for chars in (_UPPER, _SIGNS, b"|", b"!", _ENDS, _DIGITS)]
    upper, signs, bars, exclaims, ends, digits = counts
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    letters = sum(map(len, words))
    distinct = len(set(words))
    short = sum(1 for w in words if len(w) < 4)
    ascii_size = len(text.decode("utf-8", "ignore"))

    def share(k: int, of: int) -> float:  # square root: spreads small shares, bounded by 1
        return math.sqrt(k / of) if of else 0.0

    return [
        math.log1p(n),
        math.log1p(letters / n) if n else 0.0,
        share(upper, size),
        share(signs, size),
        share(bars, size),
        share(exclaims, size),
        share(ends, size),
        share(digits, size),
        math.log((distinct + 1) / (n + 1)),
        share(len(lines), n + 1),
        share(len(lines) - len(set(lines)), len(lines)),
        share(short, n),
        share(size - 1 - ascii_size, size),
    ]


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor, log-determinant, log-prior; with the features' scale."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = ((x - self.center) / self.scale - self.means[k]) @ self.factors[k].T
        return self.offsets[k] - 0.5 * np.einsum("ij,ij->i", z, z)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not len(self.means):
            return np.full(len(x), 0.5)
        gap = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -500.0, 500.0)
        return 1.0 / (1.0 + np.exp(-gap))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.3, spherical: float = 0.02) -> Discriminant:
    """Discriminant of rows x with labels y; without both classes, one that scores 0.5 throughout."""
    if not len(x) or y.min() == y.max():
        return Discriminant(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [], [], [])
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = (x - center) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(axis=0) for p in parts]
    scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)]
    common = sum(scatter) / len(z)
    factors, offsets = [], []
    for p, s in zip(parts, scatter, strict=True):
        own = (s + pooled * len(z) / len(parts) * common) / (len(p) + pooled * len(z) / len(parts))
        d = len(own)
        cov = (1 - spherical) * own + spherical * (np.trace(own) / d) * np.eye(d) + 1e-4 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(lower, np.eye(d)))
        offsets.append(float(math.log(len(p) / len(z)) - np.log(np.diag(lower)).sum()))
    return Discriminant(center, scale, means, factors, offsets)


def _statistics(df: DataFrame, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    ship(df.sparkSession)
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [id_col, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(cell.as_py()) for cell in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], names=[id_col, *extra, "x"])

    return df.select(utf8(text_col).alias("__text"), id_col, *extra).mapInArrow(run, f"{kept}, x array<double>")


def train(
    docs: DataFrame,
    labels: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
) -> Discriminant:
    """Fit on a bounded sample of labelled rows: about max_rows of them, chosen by a hash of the id.

    learns: condition on the id that a row may be learned from. Labels of an id that repeats
    are averaged (1 from a half on); null ids and labels are left out. The sample's ids are
    the only thing that is broadcast, at most 2 * max_rows longs, and its statistics the only
    thing that is collected.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learns)
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__share"))
    rate = min(1.0, max_rows / max(1, usable.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "__id"), 11).cast("double") / F.lit(float(2**53))
    chosen = usable.where(draw < F.lit(rate)).orderBy(draw, "__id").limit(2 * max_rows).select("__id", (F.col("__share") >= 0.5).cast("int").alias("__label"))
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(id_col, text_col, "__label")
    # An id that many rows share gives each different text once, so a group of copies teaches no more than one.
    distinct = _statistics(sample.dropDuplicates([id_col, text_col]), id_col, text_col, ["__label"])
    few = distinct.orderBy(F.xxhash64(id_col, "x"), id_col).limit(4 * max_rows)
    rows = sorted((r["x"], r["__label"]) for r in few.collect())
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], int))


def score_quality(df: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """Columns `keep` (default: the id) and out_col, the probability of class 1, for every row.

    Null texts count as empty; empty texts have a score like any other; texts of any length are
    scored whole. No other column than the text is an input; ids may be null or repeat, and
    repeated rows have equal scores. Name out_col apart from the columns kept.
    """
    ship(df.sparkSession)
    keep = keep or [id_col]
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(cell.as_py()) for cell in batch.column(0)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.score(x), pa.float64())], names=[*keep, out_col])

    # Numbered, since names that clash or have dots can't pass into mapInArrow.
    return df.select(utf8(text_col).alias("text"), *[F.col(quoted(c)).alias(f"kept_{k}") for k, c in enumerate(keep)]).mapInArrow(run, f"{kept}, `{out_col}` double")
