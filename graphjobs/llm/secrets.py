"""Secret scan with a token-efficiency test (operator 8).

Base patterns find assigned secrets, access keys and long hex strings. The method adds strings that a
vocabulary learned from ordinary text compresses badly: runs of ``[A-Za-z0-9+/_=-]`` of ``LEAST``
characters or more whose characters per token fall below ``RATIO``, and where a run as a whole doesn't,
the stretches of its parts (between separators) that do. Runs of ``SHORT`` characters or more, but fewer than
``LEAST``, have too few tokens for that: they must hold a digit and ``LETTERS`` letters too, and stay below
``SHORT_RATIO``. Excluded are known digests and identifiers (hex
of a digest's length, UUIDs, pure numbers, words joined by one kind of separator whose characters per
token are many) and runs that overlap a base span. Texts are read whole; no text is cut, whatever its length.

Offsets count code points, ends are exclusive. Null text counts as empty. Null and repeated doc_id: rows of their
own. Further columns aren't read, whatever their names. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f]+ is 32+ long or fails as a whole
ASSIGN_WORDS = re.compile(r"(?ai:passw|secret|token|api)")

LEAST = 20
RATIO = 1.9
SHORT, SHORT_RATIO, LETTERS = 12, 1.7, 3
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORT)
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
UUID = re.compile(r"(?ai:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})")
DIGEST = re.compile(r"(?ai:[0-9a-f]+)")
#: Lengths in hex digits of md5, sha1, sha224, sha256, sha384 and sha512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
NUMBERS = re.compile(r"[0-9+/_=-]+")
#: Plain words, joined by one kind of separator.
JOINED = re.compile(r"W(?:([-_/+=])W(?:\1W)*)?".replace("W", "(?:[A-Z]?[a-z]*|[A-Z]*)"))
PART = re.compile(UUID.pattern + r"(?![A-Za-z0-9])|[A-Za-z0-9]+|[-_/+=]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = []
    if ASSIGN_WORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(2)
def _encoding(ranks: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _tokens(text: str, ranks: str) -> int:
    return len(_encoding(ranks).encode_ordinary(text))


def _known(run: str) -> bool:
    return bool(UUID.fullmatch(run) or DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS)


def excluded(run: str, ranks: str, ratio: float = RATIO) -> bool:
    """Known digests, identifiers and plain words that are no secrets."""
    if _known(run) or NUMBERS.fullmatch(run):
        return True
    if not JOINED.fullmatch(run):
        return False
    words = re.findall("[A-Za-z]+", run)
    return sum(map(len, words)) >= ratio * sum(_tokens(w, ranks) for w in words)


def _stretches(run: str, ranks: str, ratio: float) -> list[tuple[int, int]]:
    """Stretches of whole parts, ``LEAST`` characters or more, whose characters per token are few: the one
    with most tokens over its share first, then on both its sides. Known identifiers are in none."""
    parts = [(m.start(), m.end(), m[0]) for m in PART.finditer(run)]
    over = [None if _known(t) else ratio * _tokens(t, ranks) - (e - s) for s, e, t in parts]
    found, todo = [], [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        best, total, least, sums, ready = None, 0.0, None, [0.0], lo
        first = lo  # no stretch reaches back over a known identifier
        for k in range(lo, hi):
            if over[k] is None:
                first, ready, least = k + 1, k + 1, None
                sums.append(total)
                continue
            total += over[k]
            sums.append(total)
            while ready <= k and parts[k][1] - parts[ready][0] >= LEAST:
                if ready >= first and (least is None or sums[ready - lo] < least[0]):
                    least = (sums[ready - lo], ready)
                ready += 1
            if least and total > least[0] and (best is None or total - least[0] > best[0]):
                best = (total - least[0], least[1], k + 1)
        if best is None:
            continue
        _, a, b = best
        todo += [(lo, a), (b, hi)]
        s, e = parts[a][0], parts[b - 1][1]
        s, e = e - len(run[s:e].lstrip("-_/+=")), s + len(run[s:e].rstrip("-_/+="))
        if e - s >= LEAST and not excluded(run[s:e], ranks, ratio) and e - s < ratio * _tokens(run[s:e], ranks):
            found.append((s, e))
    return sorted(found)


def short_secret(run: str, ranks: str) -> bool:
    """The test of runs of fewer than ``LEAST`` characters."""
    return bool(DIGIT.search(run)) and len(LETTER.findall(run)) >= LETTERS and len(run) < SHORT_RATIO * _tokens(run, ranks)


def random_spans(text: str, base: list[tuple[int, int, str]], ranks: str, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Runs, or stretches of runs, whose characters per token are few, outside the base spans."""
    found, at, reach = [], 0, 0  # reach: the end of all base spans that begin before the run does
    for m in RUN.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            reach, at = max(reach, base[at][1]), at + 1
        if reach > s:
            continue
        if e - s < LEAST:
            if short_secret(m[0], ranks):
                found.append((s, e, "random"))
            continue
        if excluded(m[0], ranks, ratio):
            continue
        known = any(_known(p) for p in PART.findall(m[0]))
        if not known and len(m[0]) < ratio * _tokens(m[0], ranks):
            found.append((s, e, "random"))
        else:
            found += [(s + a, s + b, "random") for a, b in _stretches(m[0], ranks, ratio)]
    return found


def scan(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (start, end, kind) by start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for whole in batches:
            for batch in parts(whole, 1):
                out = []
                for t in batch.column(1).to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    spans = sorted(base + random_spans(t, base, ranks, ratio), key=lambda s: (s[0], KINDS.index(s[2])))
                    out.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<start: bigint, `end`: bigint, kind: string>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of scan's result."""
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        n("random").alias("n_random"),
    )
