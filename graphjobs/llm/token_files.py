"""Token ids in bit-packed files (operator 2).

Layout of a file, little endian: blocks of ``BLOCK`` ids, each id in ``width`` bits (the fewest that
hold the vocabulary), each block padded to a whole byte; then the index: doc_id of each document
(int64), a null flag of each doc_id (uint8), the offset in ids of each document and the end (uint64),
the byte offset of each block and the end (uint64); then a JSON footer, its length (uint32) and the
magic. Any range of ids is read by seeking to its blocks and unpacking them with numpy.

Files hold documents in ascending doc_id order, one file per range partition; rows that share a doc_id, or have none, are
cut by a hash of their text, so that no writer gets all of them. They are written under
a temporary name and moved, so a repeated task replaces its file by an equal one; the folder is the
cluster's shared one, reached through ``pyarrow.fs``.

Texts are encoded whole. The tokenizer splits at white space, so its ids for a text are the ids of
the text's words in order; each worker encodes a distinct word once, and keeps at most ``CACHE`` bytes of
them. Whether a tokenizer has this property is checked where it is read (``splits_at_space``); texts of one
without it are encoded whole, as are all with ``by_word=False``.

Null text counts as empty (the end id only); null doc_id sorts first; rows with equal doc_id sort by
a hash of their text. Further columns aren't read, whatever their names. Very long texts are encoded and
written whole. Empty table: no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, new_path, parts

BLOCK = 1 << 16
MAGIC = b"IDPACK01"
CACHE = 160 << 20  # bytes of known words, about
TOGETHER = 200


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The inverse of ``pack`` for n ids."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes one file, a block at a time."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(os.path.dirname(self.path))
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.width = self.fs.open_output_stream(self.part), width
        self.held, self.n_held, self.at = [], 0, 0
        self.docs, self.ends, self.blocks = [], [0], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ends.append(self.ends[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 4 * BLOCK:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, stop, BLOCK):
            data = pack(ids[lo : min(lo + BLOCK, stop)], self.width)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> tuple[int, int]:
        self._blocks(last=True)
        index = [
            np.array([d or 0 for d in self.docs], "<i8"),
            np.array([d is None for d in self.docs], "u1"),
            np.array(self.ends, "<u8"),
            np.array(self.blocks, "<u8"),
        ]
        for x in index:
            self.out.write(x.tobytes())
        foot = {"width": self.width, "block": BLOCK, "documents": len(self.docs), "ids": self.ends[-1], "blocks": len(self.blocks) - 1, "index": self.at}
        data = json.dumps(foot).encode()
        self.out.write(data + len(data).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.docs), self.ends[-1]


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        self.fs, p = fs.FileSystem.from_uri(path)
        self.file = self.fs.open_input_file(p)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        n = int.from_bytes(tail[:4], "little")
        self.foot = json.loads(self.file.read_at(n, size - 12 - n))
        at, docs = self.foot["index"], self.foot["documents"]
        data = self.file.read_at(size - 12 - n - at, at)
        self.docs = np.frombuffer(data, "<i8", docs)
        self.unknown = np.frombuffer(data, "u1", docs, docs * 8).astype(bool)
        self.ends = np.frombuffer(data, "<u8", docs + 1, docs * 9).astype(np.int64)
        self.blocks = np.frombuffer(data, "<u8", self.foot["blocks"] + 1, docs * 9 + (docs + 1) * 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of the file, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        block = self.foot["block"]
        first, last = start // block, (stop - 1) // block
        data = self.file.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(block, self.foot["ids"] - b * block)
            lo = int(self.blocks[b] - self.blocks[first])
            parts.append(unpack(data[lo : lo + int(self.blocks[b + 1] - self.blocks[b])], self.foot["width"], n))
        return np.concatenate(parts)[start - first * block : stop - first * block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k]), int(self.ends[k + 1]))


def _skips_space(pattern: str | None) -> bool:
    """Whether nothing that a pattern says can match white space: its negated classes name it, and nothing else does."""
    if pattern is None:
        return False
    negated = re.findall(r"\[\^[^\]]*\]", pattern)
    rest = re.sub(r"\[\^[^\]]*\]", "", pattern).replace("\\p{", "")
    return all(r"\s" in c for c in negated) and not re.search(r"\s|\\[sSDWPX]|(?<!\\)\.|\\[tnrvf]", rest)


def splits_at_space(tokenizer: str) -> bool:
    """Whether a tokenizers file treats the words between ASCII white space independently of each other: its first
    pre-tokenizer drops white space, its normalisers look at characters and their marks only, nothing is put in front
    or cut off, and no added token holds white space or takes it along."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part: dict | None, name: str) -> list[dict]:
        if part is None:
            return []
        return [y for x in part[name] for y in steps(x, name)] if part["type"] == "Sequence" else [part]

    before, cuts = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    kept = {"Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Replace"}
    # a replacement may only make one space of white space
    plain = all(x["type"] in kept and (x["type"] != "Replace" or x.get("content") == " " and x["pattern"].get("Regex") in (r"\s+", r"\s")) for x in before)
    dropped = bool(cuts) and (
        cuts[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
        or cuts[0]["type"] == "Split" and cuts[0].get("behavior") == "Removed" and bool(cuts[0].get("invert")) and _skips_space(cuts[0]["pattern"].get("Regex"))
    )
    later = all(not x.get("add_prefix_space") for x in cuts)
    alone = not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    return plain and dropped and later and alone


class WordEncoder:
    """Ids of texts by a tokenizers file, each distinct word encoded once."""

    def __init__(self, tokenizer: str, by_word: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        if by_word is None:
            by_word = splits_at_space(tokenizer)
        self.tokenizer, self.by_word, self.known, self.held = Tokenizer.from_file(tokenizer), by_word, {}, 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocab = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda v: v[1])
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t, _ in vocab])
        self.n_bytes = np.array([len(t) - len(suffix) * bool(suffix and t.endswith(suffix)) for t, _ in vocab])
        self.lowers = [e.ids for e in self.tokenizer.encode_batch(["AZ", "az"], add_special_tokens=False)]
        self.lowers = self.lowers[0] == self.lowers[1]
        self.width = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def _learn_each(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, np.uint32).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode many words as one text, and cut its ids where the words' bytes end.

        Cuts must fall on ends of words in every place; else the words are encoded one by one."""
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        found = self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)
        for part, e in zip(parts, found):
            ids = np.array(e.ids, np.uint32)
            size = [len(w) if w.isascii() else len(unicodedata.normalize("NFC", w.decode()).lower().encode()) for w in part]
            ends, cuts = np.cumsum(self.n_bytes[ids]), np.cumsum(size)
            at = np.searchsorted(ends, cuts)
            if len(ids) and at[-1] == len(ids) - 1 and (ends[at] == cuts).all() and self.last[ids[at]].all():
                data, start = ids.tobytes(), 0
                for w, stop in zip(part, ((at + 1) * 4).tolist()):
                    self.known[w] = data[start:stop]
                    start = stop
            else:
                self._learn_each(part)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text; words are the bytes between ASCII white space."""
        if not self.by_word:
            for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)
            return
        # without markup of special tokens, ids depend on the text in lower case if the tokenizer lowers it
        split = [(t.lower() if self.lowers and b"<|" not in t else t).split() for t in texts]
        new = list(set().union(*split) - self.known.keys())
        size = sum(map(len, new)) * 2 + 200 * len(new)  # a word, its ids and their places in the table
        if self.held + size > CACHE and self.known:
            self.known, self.held, new = {}, 0, list(set().union(*split))
            size = sum(map(len, new)) * 2 + 200 * len(new)
        self.held += size
        plain = [w for w in new if b"<|" not in w]
        for lo in range(0, len(plain), TOGETHER * 50):
            self._learn(plain[lo : lo + TOGETHER * 50])
        self._learn_each([w for w in new if b"<|" in w])
        get = self.known.__getitem__
        for words in split:
            yield np.frombuffer(b"".join(map(get, words)), np.uint32)


@lru_cache(2)
def _encoder(tokenizer: str, by_word: bool | None) -> WordEncoder:
    """One per worker process: later tasks find the words that earlier ones met."""
    return WordEncoder(tokenizer, by_word)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text", by_word: bool | None = None
) -> DataFrame:
    """Encode and write; the manifest: path, start (ids in earlier files), documents, ids per file."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, writer = TaskContext.get().partitionId(), None, None
        name = f"{path}/part-{part:06d}.ids"
        for whole in batches:
            for batch in parts(whole, 1):
                encoder = encoder or _encoder(tokenizer, by_word)
                writer = writer or Writer(name, max(encoder.width, int(end_id).bit_length()))
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
                end = np.array([end_id], np.uint32)
                for d, ids in zip(batch.column(0).to_pylist(), encoder(texts)):
                    writer.add(d, np.concatenate((ids, end)))
        if writer:
            n, ids = writer.close()
            cols = [pa.array([part], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "path", "documents", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = materialise(rows.mapInArrow(run, "part long, path string, documents long, ids long"), "manifest")
    start, out = 0, []
    for f in files.orderBy("part").collect():  # one short row per file
        out.append((f.path, start, f.documents, f.ids))
        start += f.ids
    return spark.createDataFrame(out, "path string, start long, documents long, ids long")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, and ids on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                reader = Reader(path)
                for lo in range(0, len(reader.docs), 1000):
                    hi = min(lo + 1000, len(reader.docs))
                    ids = [reader.document(k) for k in range(lo, hi)] if hi - lo < 2 else np.split(reader.ids(int(reader.ends[lo]), int(reader.ends[hi])), reader.ends[lo + 1 : hi] - reader.ends[lo])
                    cols = [
                        pa.array(reader.docs[lo:hi], pa.int64(), mask=reader.unknown[lo:hi]),
                        pa.array(start + reader.ends[lo:hi]),
                        pa.array(np.diff(reader.ends[lo : hi + 1])),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # ranges of the files' starts, which all differ: as many as there are files, so that each has a task of its own
    return manifest.select("path", "start").repartitionByRange(max(1, manifest.count()), "start").mapInArrow(run, schema)
