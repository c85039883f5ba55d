"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a vector of transformed statistics (FEATURES). Each label's class has a mean
and a shrinkage covariance: S = (1 - a) * class covariance + a * (0.5 * pooled covariance +
0.5 * diagonal of it) plus a ridge, with a = strength / (strength + rows of the class), so that
a class with few rows leans on the pooled estimate. The Cholesky factors of the covariances are
worked out once. A text's score is the logistic of the difference of the two Mahalanobis
log-densities plus the log prior odds.

The moments are sums over all labelled rows, taken by one aggregate (p + p(p+1)/2 numbers a
class come to the driver); the labels meet a table of short vectors, not the texts. Statistics
are computed in one pass without a shuffle over every whole text.

Edge cases: a null or empty text has the statistics of an empty text and a score like any other.
A row with several labels counts once for each; null labels do not count. With no rows of one
class or none at all every text scores the share of class 1 (0.5 without labels). The key may be
null; repeated rows score alike. A very long text is read whole; an empty table gives an empty result.
Labels, languages and sources are never read by the score, nor are other columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textscan as S

FEATURES = (
    "word_bytes", "symbols", "capitals", "digits", "marks", "bars", "bangs", "dup_lines",
    "distinct", "repeats", "line_words", "top_word",
)
PIECE_BYTES = 1 << 20
STRENGTH = 200.0
RIDGE = 0.02
REPEAT_WORDS = 5

_CLASSES = {
    "symbols": b"#*$%&<>",
    "capitals": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "marks": b".,;:?",
    "bars": b"|",
    "bangs": b"!",
    "lines": b"\n",
}


#: Rate that a text is taken to have before it is seen, and the weight of that in units of the whole.
PRIORS = {
    "symbols": (0.004, 60), "capitals": (0.04, 60), "digits": (0.004, 60), "marks": (0.03, 60), "bars": (0.002, 60),
    "bangs": (0.002, 60), "dup_lines": (0.03, 6), "distinct": (0.7, 30), "repeats": (0.01, 30), "top_word": (0.06, 30),
}


def _rate(name: str, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of the share, drawn to its prior in short texts."""
    rate, weight = PRIORS[name]
    share = np.clip((part + rate * weight) / (whole + weight), 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def _distinct_per_text(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: distinct values, values that occur twice or more, and the largest count."""
    n = len(ptr) - 1
    distinct, repeated, most = (np.zeros(n, np.int64) for _ in range(3))
    if len(values):
        own = np.repeat(np.arange(n), np.diff(ptr))
        # 40 bits of the hash under the number of the text: one sort for all texts
        keys = np.sort((own.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        begin = P.run_starts(keys)
        sizes = np.diff(begin, append=len(keys))
        text = (keys[begin] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(text, minlength=n)
        repeated = np.bincount(text, np.where(sizes > 1, sizes, 0), n).astype(np.int64)
        np.maximum.at(most, text, sizes)
    return distinct, repeated, most


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The FEATURES of the texts at these offsets, a row each."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, z in S.pieces(offsets, PIECE_BYTES):
        base = offsets[a]
        found = S.scan(data[base : offsets[z]], offsets[a : z + 1] - base)
        out[a:z] = _statistics(found)
    return out


def _statistics(found: S.Scan) -> np.ndarray:
    n = len(found.offsets) - 1
    size = np.diff(found.offsets)
    kind = np.zeros(256, np.uint8)
    for k, x in enumerate(_CLASSES.values(), 1):
        kind[list(x)] = k
    kinds = kind[found.data]
    own = np.repeat(np.arange(n, dtype=np.int64), size)
    table = np.bincount(own * 16 + kinds, minlength=16 * n).reshape(n, 16)
    count = {name: table[:, k].astype(float) for k, name in enumerate(_CLASSES, 1)}
    words = np.diff(found.ptr).astype(float)
    lengths = np.concatenate(([0], np.cumsum(found.ends - found.starts)))[found.ptr]
    hashes = found.word_hashes()
    distinct, _, most = _distinct_per_text(hashes, found.ptr)
    window, at = S.window_hashes(hashes, found.ptr, REPEAT_WORDS)
    windows = np.searchsorted(at, found.ptr)
    _, repeated, _ = _distinct_per_text(window, windows)
    # lines: runs of words without a line break between them, told apart by the sum of their word hashes
    breaks = np.concatenate(([0], np.cumsum(found.data == 10)))
    line_of = breaks[found.starts]
    head = np.zeros(len(line_of), bool)
    if len(line_of):
        head[1:] = line_of[1:] != line_of[:-1]
        head[found.ptr[:-1][words > 0]] = True
    begin = np.flatnonzero(head)
    line_words = np.diff(begin, append=len(line_of))
    spread = S.mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.repeat(begin, line_words).astype(np.uint64)) if len(hashes) else hashes
    line_hash = np.add.reduceat(spread, begin) if len(begin) else hashes
    line_ptr = np.searchsorted(begin, found.ptr)
    lines = np.diff(line_ptr).astype(float)
    line_distinct, _, _ = _distinct_per_text(line_hash, line_ptr)
    letters = count["capitals"] + count["lower"]
    columns = {
        "word_bytes": np.log((np.diff(lengths) + 6.0 * 30) / (words + 30)),
        "symbols": _rate("symbols", count["symbols"], size),
        "capitals": _rate("capitals", count["capitals"], letters),
        "digits": _rate("digits", count["digits"], size),
        "marks": _rate("marks", count["marks"], size),
        "bars": _rate("bars", count["bars"], size),
        "bangs": _rate("bangs", count["bangs"], size),
        "dup_lines": _rate("dup_lines", lines - line_distinct, lines),
        "distinct": _rate("distinct", distinct, words),
        "repeats": _rate("repeats", repeated, np.diff(windows)),
        "line_words": np.log((words + 20.0 * 6) / (lines + 6)),
        "top_word": _rate("top_word", most, words),
    }
    return np.column_stack([columns[k] for k in FEATURES])


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `stats`, the FEATURES of the text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in P.column_batches(batches):
            stats = text_statistics(*S.text_buffers(batch.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, len(FEATURES)), pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=[key, "stats"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, stats array<double>")


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], strength: float = STRENGTH) -> None:
        """moments: for each class its rows, the sum of the vectors and the sum of their outer products."""
        rows = {k: m[0] for k, m in moments.items()}
        total = sum(rows.values())
        self.share = rows.get(1, 0.0) / total if total else 0.5
        self.factors = []
        if min(rows.get(0, 0), rows.get(1, 0)) < 1:
            return
        centred = {k: m[2] / m[0] - np.outer(m[1] / m[0], m[1] / m[0]) for k, m in moments.items()}
        pooled = sum(rows[k] * centred[k] for k in (0, 1)) / total
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
        for k in (0, 1):
            shrink = strength / (strength + rows[k])
            cov = (1 - shrink) * centred[k] + shrink * target + RIDGE * np.eye(len(target))
            factor = np.linalg.cholesky(cov)
            self.factors.append((moments[k][1] / rows[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(stats), self.share)
        density = [-0.5 * (((stats - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * log_det for mean, inverse, log_det in self.factors]
        odds = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """labelled: label and stats. One aggregate over all rows."""
    p = len(FEATURES)
    s = [F.get("stats", F.lit(k)) for k in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = [F.sum(x) for x in s] + [F.sum(s[i] * s[j]) for i, j in pairs]
    out = {}
    for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).collect():
        outer = np.zeros((p, p))
        for (i, j), v in zip(pairs, r["sums"][p:], strict=True):
            outer[i, j] = outer[j, i] = v
        out[int(r["label"])] = (float(r["n"]), np.array(r["sums"][:p]), outer)
    return out


def train_quality(stats: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", strength: float = STRENGTH) -> Discriminant:
    """Fit on the rows of stats that have a label 0 or 1 in labels and where learn (on the key) holds."""
    marked = labels.where(learn & F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"))
    return Discriminant(_moments(stats.join(marked, key).select("label", "stats")), strength)


def score_quality(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """stats with score and predicted (1 if score >= threshold)."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return pa.array(sent.value.scores(flat.reshape(-1, len(FEATURES))))

    return stats.withColumn("score", score("stats")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores `threshold` or more, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train_quality(statistics_table(docs, key, text), labels, learn, key))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            return pa.array(sent.value.scores(text_statistics(*S.text_buffers(column))))

    return docs.where(score(F.col(text)) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, stats, score and predicted for every row of docs. The vectors are written once to the
    checkpoint folder, since training and scoring both read them."""
    stats = P.durable(statistics_table(docs, key, text))
    return score_quality(stats, train_quality(stats, labels, learn, key), threshold)
