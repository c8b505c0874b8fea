"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9).

Statistics are computed with numpy from whole texts, alike for training and scoring. Trees are grown
on the driver from a bounded sample of labelled rows (``SAMPLE``, drawn by a hash of doc_id), on
binned statistics with second-order logistic gain, and flattened into arrays: scoring walks all rows
of a batch through all trees level by level, without Python recursion.

Null and empty texts have statistics of their own (all zero) and a score like any text. Labels that
are null are no training rows; with fewer than two classes among the labels the score is their mean
(0.5 without any). Null doc_id: scored, never used for training.
Repeated rows: scored for themselves; of the rows of one doc_id one is learned from, that of the least statistics, so that
the driver holds at most ``SAMPLE`` rows; of several labels of one doc_id the greatest counts. doc_id may be of any type. Very long
texts are counted whole. Further columns pass through. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts
from .shingles import word_hashes

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "punct", "symbol", "bang", "pipe", "space", "control",
    "high", "lines", "line_length", "distinct", "top_word", "repeat_pairs", "entropy", "comma_stop", "distinct_log",
)


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars.encode())] = 1
    return m


_CLASS = np.array(
    [
        [float(65 <= b <= 90) for b in range(256)],
        [float(48 <= b <= 57) for b in range(256)],
        _mask(".,;:'\"()-?"),
        _mask("#$%&*@^~<>{}[]\\/_=+`"),
        _mask("!"),
        _mask("|"),
        _mask(" \t\n\r\v\f"),
        [float(b < 32 and b not in (9, 10, 11, 12, 13)) for b in range(256)],
        [float(b >= 128) for b in range(256)],
    ]
).T


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    hashes, counts = word_hashes(column)
    ends = np.cumsum(np.append(0, counts))
    out = np.zeros((len(column), len(FEATURES)))
    for k in range(len(column)):
        n, words = int(off[k + 1] - off[k]), int(counts[k])
        if not n:
            continue
        hist = np.bincount(data[off[k] : off[k + 1]], minlength=256)
        share = hist @ _CLASS / n
        lines = hist[10] + 1
        p = hist[hist > 0] / n
        own = hashes[ends[k] : ends[k + 1]]
        distinct = top = pairs = 0.0
        if words:
            order = np.sort(own)
            starts = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
            distinct, top = len(starts) / words, np.diff(np.append(starts, words)).max() / words
            pairs = float((own[1:] == own[:-1]).mean()) if words > 1 else 0.0
        out[k] = (
            np.log1p(n), np.log1p(words), n / max(1, words), *share[:6], share[6], share[7], share[8], np.log1p(lines), np.log1p(n / lines),
            distinct, top, pairs, float(-(p * np.log2(p)).sum()), (hist[44] + hist[46]) / max(1, words), distinct * np.log1p(words),
        )
    return out


class Trees:
    """Gradient-boosted trees as flat arrays: feature, threshold, left child, right child, value."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.base, self.roots = 0.0, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = float(y.mean()) if len(y) else 0.5
        self.base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        if len(y) and 0 < mean < 1:
            self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
            binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)
            margin = np.full(len(y), self.base)
            for _ in range(self.rounds):
                p = 1 / (1 + np.exp(-margin))
                self.roots.append(len(self.feature))
                margin += self._grow(binned, p - y, p * (1 - p))
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int32))
        self.threshold, self.value = np.array(self.threshold, float), np.array(self.value, float)
        return self

    def _node(self) -> int:
        for a, v in ((self.feature, 0), (self.threshold, np.inf), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            a.append(v)
        k = len(self.feature) - 1
        self.left[k] = self.right[k] = k  # a leaf leads to itself
        return k

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One tree, level by level; its value for each training row."""
        at, out = {self._node(): np.arange(len(g))}, np.zeros(len(g))
        width = self.bins + 1
        for level in range(self.depth + 1):
            then = {}
            for node, rows in at.items():
                total_g, total_h = g[rows].sum(), h[rows].sum()
                self.value[node] = -self.rate * total_g / (total_h + self.penalty)
                out[rows] = self.value[node]
                if level == self.depth or len(rows) < 2 * self.least:
                    continue
                flat = (binned[rows] + np.arange(binned.shape[1]) * width).ravel()
                shape = (binned.shape[1], width)
                each = binned.shape[1]
                sg = np.bincount(flat, np.repeat(g[rows], each), shape[0] * width).reshape(shape).cumsum(1)[:, :-1]
                sh = np.bincount(flat, np.repeat(h[rows], each), shape[0] * width).reshape(shape).cumsum(1)[:, :-1]
                sn = np.bincount(flat, minlength=shape[0] * width).reshape(shape).cumsum(1)[:, :-1]
                gain = sg**2 / (sh + self.penalty) + (total_g - sg) ** 2 / (total_h - sh + self.penalty) - total_g**2 / (total_h + self.penalty)
                gain[(sn < self.least) | (len(rows) - sn < self.least)] = -1
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(self.edges[f]):
                    continue
                left, right = self._node(), self._node()
                self.feature[node], self.threshold[node], self.left[node], self.right[node] = int(f), float(self.edges[f][b]), left, right
                low = binned[rows, f] <= b
                then[left], then[right] = rows[low], rows[~low]
            at = then
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row walks every tree, one level of all trees at a time."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.repeat(self.roots[None], len(x), 0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, **params) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")  # sample rows at most
    rows = rows.select(F.xxhash64("doc_id").alias("place"), "text", "y")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, whole.schema.get_field_index("text")):
                x = statistics(batch["text"])
                flat = pa.array(x.ravel())
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch["place"], batch["y"], pa.ListArray.from_arrays(ends, flat)], ["place", "y", "x"])

    # one row of each doc_id, that of the least statistics, so that the driver gets at most ``sample``
    each = rows.mapInArrow(run, "place long, y int, x array<double>").groupBy("place").agg(F.min(F.struct("x", "y")).alias("least"))
    got = each.select("place", "least.*").orderBy("place").limit(sample).collect()
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    return Trees(**params).fit(x, np.array([r.y for r in got], float))


def score_quality(
    docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("quality_score", "quality_predicted")
) -> DataFrame:
    """All columns of docs, with the score and the predicted label under the given names; columns that are called so
    already give way."""
    docs = docs.drop(*names)
    bounded_batches(docs.sparkSession)
    score, predicted = names
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    columns = [f.name for f in docs.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, columns.index(text)):
                s = sent.value.score(statistics(batch.column(columns.index(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*columns, score, predicted])

    return docs.mapInArrow(run, f"{kinds}, `{score}` double, `{predicted}` int")


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
