"""SentencePiece encoding and decoding on the tokenizers library (operator 4).

The model's protobuf is parsed here (wire format only), and a tokenizers ``Tokenizer`` is rebuilt from
it: the precompiled normaliser, the metaspace marker, unigram scores or BPE merges by rank, and byte
fallback. A text is cut before each run of markers; no piece of the model goes past such a cut (this is
checked when the model is read, else texts are encoded whole), so a text's ids are those of its
segments, and each task encodes a distinct segment once, in multithreaded batches.

Parity: every distinct segment that a task meets is also encoded by the sentencepiece library, and
the result says per document whether all of its segments agree.

Null text counts as empty: no ids, empty text. Null and repeated doc_id: rows of their own. Very long texts are encoded
whole, and batches and known segments are bounded by bytes. Further columns aren't read, whatever their names. Empty
table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts

MARK = "▁"
CACHE = 64 << 20  # bytes of known segments, about
TOGETHER = 50
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: int, float bytes or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk = UNIGRAM, False, 0
        self.charsmap, self.prefix, self.trim, self.escape = b"", True, True, True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                t = dict(_fields(value))
                self.kind, self.byte_fallback, self.unk = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
            elif number == 3:
                n = dict(_fields(value))
                self.charsmap = n.get(2, b"")
                self.prefix, self.trim, self.escape = (bool(n.get(k, 1)) for k in (3, 4, 5))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, by the piece's score and then by the ranks of it and its parts."""
        rank = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for p, i in rank.items():
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in rank and right in rank:
                    out.append((i, rank[left], rank[right], left, right))
        return [(x[3], x[4]) for x in sorted(out)]

    def cuttable(self) -> bool:
        """No piece has a marker after another character."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self):
        from tokenizers import Tokenizer, decoders, models, normalizers

        vocab = [(p, s) for p, s, _ in self.pieces]
        if self.kind == BPE:
            model = models.BPE(
                {p: i for i, (p, _) in enumerate(vocab)}, self.merges(), unk_token=vocab[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback
            )
        else:
            model = models.Unigram(vocab, self.unk, self.byte_fallback)
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
        if steps:
            t.normalizer = normalizers.Sequence(steps)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return t


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class SentencePieceCodec:
    """Encodes and decodes whole texts of one model."""

    def __init__(self, path: str, verify: bool = True):
        self.model = Model(path)
        self.tokenizer = self.model.tokenizer()
        self.normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        self.cut = self.model.cuttable()
        self.segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.cut else re.compile(r".+", re.S)
        self.n_bytes = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in self.model.pieces])
        #: what each id stands for: nothing for control pieces, the library's sign for the unknown one
        self.surface = [
            b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
            for p, _, kind in self.model.pieces
        ]
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.odd: set[str] = set()  # segments on which the libraries differ
        self.spp = None
        if verify:
            import sentencepiece

            self.spp = sentencepiece.SentencePieceProcessor(model_file=path)

    def normalise(self, text: str) -> str:
        """The text as the model sees it: normalised, with markers for spaces."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def _told(self, segments: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of normalised text; it puts the first marker on its own."""
        bare = [s[1:] if self.model.prefix and s[:1] == MARK else s for s in segments]
        return self.spp.encode([s.replace(MARK, " ") for s in bare], num_threads=2)

    def _learn_each(self, segments: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch(segments, add_special_tokens=False)]
        same = [a == b for a, b in zip(found, self._told(segments))] if self.spp is not None else [True] * len(segments)
        for s, ids, ok in zip(segments, found, same):
            self.known[s] = np.array(ids, np.uint32).tobytes()
            if not ok:
                self.odd.add(s)

    def _learn(self, segments: list[str]) -> None:
        """Encode many segments as one text, and cut its ids where the segments' bytes end."""
        if not (self.cut and self.model.byte_fallback):
            return self._learn_each(segments)
        # literal markers in a text look like spaces here; the library tells them apart
        plain = [s for s in segments if s[:1] == MARK and s[1:2] != MARK]
        self._learn_each([s for s in segments if not (s[:1] == MARK and s[1:2] != MARK)])
        parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = ["".join(p) for p in parts]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        told = self._told(texts) if self.spp is not None else [None] * len(parts)
        for part, e, other in zip(parts, found, told):
            ids = np.array(e.ids, np.uint32)
            ends, cuts = np.cumsum(self.n_bytes[ids]), np.cumsum([len(s.encode()) for s in part])
            at = np.searchsorted(ends, cuts)
            if (other is None or e.ids == other) and at[-1] == len(ids) - 1 and (ends[at] == cuts).all():
                data, start = ids.tobytes(), 0
                for s, stop in zip(part, ((at + 1) * 4).tolist()):
                    self.known[s] = data[start:stop]
                    start = stop
            else:
                self._learn_each(part)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """(ids, parity) of each text."""
        split = [self.segment.findall(self.normalise(t)) for t in texts]
        new = list(set().union(*split) - self.known.keys())
        size = sum(map(len, new)) * 3 + 200 * len(new)  # a string, its ids and their places in the table
        if self.held + size > CACHE and self.known:
            self.known, self.odd, self.held, new = {}, set(), 0, list(set().union(*split))
            size = sum(map(len, new)) * 3 + 200 * len(new)
        self.held += size
        self._learn(new)
        get = self.known.__getitem__
        for segments in split:
            yield np.frombuffer(b"".join(map(get, segments)), np.uint32), self.odd.isdisjoint(segments)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the marker that encoding put first goes.

        Pieces are joined as bytes, byte pieces as what they are; where that isn't valid text, the
        library's decoder says what stands for the bytes that aren't."""
        try:
            text = b"".join(map(self.surface.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.prefix and text[:1] == " " else text


@lru_cache(2)
def _codec(path: str, verify: bool) -> SentencePieceCodec:
    return SentencePieceCodec(path, verify)


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", verify: bool = True, decode: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids, n_ids, ids_crc32 (of 32-bit little-endian ids), parity, and on request
    decoded_text, what the ids decode to, by the same codec in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, verify)
        for whole in batches:
            for batch in parts(whole, 1):
                done = list(codec.encode([t or "" for t in batch.column(1).to_pylist()]))
                ids = [d[0] for d in done]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = {
                    "doc_id": batch.column(0),
                    "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))),
                    "n_ids": pa.array(np.diff(ends).astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    "parity": pa.array([d[1] for d in done]),
                }
                if decode:
                    columns["decoded_text"] = pa.array([codec.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, ids_crc32 long, parity boolean" + ", decoded_text string" * decode)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """Adds decoded_text to rows with ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, False)
        for whole in batches:
            for batch in parts(whole, whole.schema.get_field_index("ids")):
                ids = batch["ids"]
                off, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)  # of the whole batch
                out = [codec.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(off, off[1:], ids.is_valid().to_pylist())]
                text = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded_text string")
