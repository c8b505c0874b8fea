"""Language ID by rank-order profiles (operator 12): n-grams of letters, out-of-place distance.

A text is lower-cased, its letters (Unicode category L) stay, and every run of anything else is one blank. Its
n-grams are the runs of 1 to 3 characters that hold a letter and no blank inside, so that blanks mark where words
begin and end. A profile is the ``PROFILE`` most frequent n-grams in order of their counts, ties by code points.

1. Learning counts the n-grams of *all* labelled texts of the learning folds: a task adds up counts by language,
   Spark sums those partial counts, and the most frequent of each language make its profile. The driver sees
   profiles only, ``PROFILE`` rows for each of at most ``LANGUAGES`` languages (those of most documents).
2. A document's own profile is compared with each language's: an n-gram costs the difference of its places in
   the two, and ``PROFILE`` where the language doesn't have it. The smallest sum is the prediction, ties go to the
   smaller name by code point. The score is 1 - sum / (PROFILE * n-grams of the document's profile).

Null texts, empty ones and those without a letter are "und" with score 0; so is every text where nothing was
learned. Null lang is no training row; null doc_id is predicted, never learned from, and counts as held out.
Repeated rows are rows of their own. Texts are counted whole whatever their length, ``PIECE`` characters at a
time. Only doc_id, text and lang are read, whatever other columns are called. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts, release
from .quality import fold

PROFILE = 400
LANGUAGES = 2000
PIECE = 1 << 20
HELD = 1 << 20  # counts that a task holds before it passes them on
BLANK = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def _piece(text: str, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end in this piece, and the last characters, which n-grams of the next one may begin with."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(_letters()[code], code, BLANK)
    code = np.concatenate([tail, code])
    keep = np.append(True, (code[1:] != BLANK) | (code[:-1] != BLANK))
    keep[: len(tail)] = True
    c, old = code[keep], len(tail)
    one = c[old:]
    keys = [one[one != BLANK]]
    a, b = c[:-1], c[1:]
    two = a | b << 21
    keys.append(two[max(0, old - 1) :])
    if len(c) > 2:
        three = two[:-1] | c[2:] << 42
        keys.append(three[max(0, old - 2) :][c[1:-1][max(0, old - 2) :] != BLANK])
    return np.concatenate(keys), c[-2:]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a text's n-grams: code points packed in 21 bits each, the first one lowest. Keys ascend."""
    found, tail = [], np.array([BLANK], np.int64)
    text = text or ""
    for at in range(0, len(text) + 1, PIECE):
        last = at + PIECE > len(text)
        keys, tail = _piece(text[at : at + PIECE] + (" " if last else ""), tail)
        found.append(np.unique(keys, return_counts=True))
    if len(found) == 1:
        return found[0]
    return _merged(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def profile(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys in order; ties by key. keys ascend."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """The languages' profiles as one table: a row for each known n-gram, a column for each language, -1 where it has none."""

    languages: list[str]
    keys: np.ndarray
    places: np.ndarray
    size: int

    @classmethod
    def of(cls, profiles: dict[str, list[int]], size: int = PROFILE) -> Profiles:
        languages = sorted(profiles)
        keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        places = np.full((len(keys) + 1, len(languages)), -1, np.int32)  # the last row is that of unknown n-grams
        for n, name in enumerate(languages):
            places[np.searchsorted(keys, profiles[name]), n] = np.arange(len(profiles[name]))
        return cls(languages, keys, places, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.languages:
            return "und", 0.0
        own = profile(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        places = self.places[np.where(self.keys[at] == own, at, len(self.keys))]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.languages[best], 1 - float(apart[best]) / (self.size * len(own))


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, key, n): how often each n-gram occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, some in held.items():
                keys, n = _merged(np.concatenate([k for k, _ in some]), np.concatenate([c for _, c in some]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

        for whole in batches:
            for batch in parts(whole, 1):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys, n = ngrams(value)
                    held.setdefault(name, []).append((keys, n))
                    size += len(keys)
                    if size > HELD:
                        held = {k: [_merged(np.concatenate([x for x, _ in v]), np.concatenate([c for _, c in v]))] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD // 2:
                            yield from flush()
                            held, size = {}, 0
        yield from flush()

    return docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def learn_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, languages: int = LANGUAGES) -> Profiles:
    """Profiles of the languages of the documents outside the held-out fold."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id) != 0))
    counts = materialise(count_ngrams(rows, text, lang), "ngrams")
    common = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(languages)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = counts.join(F.broadcast(common.select("lang")), "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    found: dict[str, list[int]] = {}
    for r in top.select("lang", "key", "place").orderBy("lang", "place").collect():  # size * languages rows at most
        found.setdefault(r.lang, []).append(r.key)
    release(counts)
    return Profiles.of(found, size)


def predict_languages(docs: DataFrame, known: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == 0, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, 2):
                got = [sent.value.predict(t) for t in batch.column(2).to_pylist()]
                names, scores = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, scores], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
