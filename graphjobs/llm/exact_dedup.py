"""Exact dedup with Patricia-trie owners (operator 3).

Texts are equal when identical after each run of ASCII white space became one space.

1. Map side: each task inserts its whole normalised texts into a compressed radix trie, window by
   window of at most ``WINDOW`` bytes. One row per distinct text of a window goes on, so a group of
   copies that holds a third of all rows shrinks before any shuffle.
2. Those rows are dealt by length and content hash. Each partition's trie holds full byte strings;
   the terminal node of a text keeps the smallest doc_id, and is its owner. Beyond ``LIMIT`` bytes
   the largest subtree moves to a temporary file and is finished after the rest.
3. Owners go back to their windows' rows by a join on the window group, whose keys are bounded too.

Null text counts as empty. Null doc_id counts as the largest. Rows that repeat both doc_id and text
form a group as well; exactly one row of a group is kept. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 48 << 20
LIMIT = 96 << 20

_BLANK = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(text: bytes) -> bytes:
    text = text.translate(_BLANK)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class Node:
    __slots__ = ("label", "children", "owner", "file")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.file = label, {}, None, None


class Trie:
    """A radix trie of byte strings. Each terminal owns [smallest rank, rows, members]."""

    def __init__(self, limit: int):
        self.root, self.limit, self.held = Node(b""), limit, 0

    def insert(self, key: bytes, rank: tuple, rows: int, members: list) -> list | None:
        """The owner of key after adding to it; None where its subtree was spilled."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key[at:], rank, rows, members), node.file)
                return None
            if at == len(key):
                if node.owner is None:
                    node.owner = [rank, 0, []]
                owner = node.owner
                owner[0], owner[1] = min(owner[0], rank), owner[1] + rows
                owner[2] += members
                return owner
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                child.owner = [rank, rows, list(members)]
                self.held += len(key) - at + 200
                if self.held > self.limit:
                    self._spill()
                return child.owner
            if not key.startswith(child.label, at):
                n = _common(key, at, child.label)
                middle = node.children[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                self.held += 200
                child = middle
            node, at = child, at + len(child.label)

    def _spill(self) -> None:
        """Move the largest subtree that isn't nearly everything to a file."""
        sizes: dict[int, int] = {}
        stack = [self.root]
        order = []
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        for node in reversed(order):
            sizes[id(node)] = (0 if node.file else len(node.label) + 200) + sum(sizes[id(c)] for c in node.children.values())
        node = self.root
        while node.children:
            big = max(node.children.values(), key=lambda c: sizes[id(c)])
            if node is not self.root and sizes[id(big)] < sizes[id(node)] * 3 // 4:
                break
            node = big
        file = tempfile.TemporaryFile()
        for suffix, owner in _owners(node, skip_label=True):
            pickle.dump((suffix, *owner), file)
        for part in _spilled(node):
            part[1].seek(0)
            for s, *rest in _records(part[1]):
                pickle.dump((part[0] + s, *rest), file)
            part[1].close()
        self.held -= sizes[id(node)] - len(node.label) - 200
        node.children, node.owner, node.file = {}, None, file

    def finish(self) -> Iterator[list]:
        """All owners; spilled subtrees one after another."""
        for _, owner in _owners(self.root):
            yield owner
        files = [f for _, f in _spilled(self.root)]
        self.root = Node(b"")
        for file in files:
            file.seek(0)
            rest = Trie(self.limit)
            for record in _records(file):
                rest.insert(*record)
            file.close()
            yield from rest.finish()


def _common(key: bytes, at: int, label: bytes) -> int:
    low, high = 0, min(len(key) - at, len(label))
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _walk(node: Node, skip_label: bool) -> Iterator[tuple[bytes, Node]]:
    stack = [(b"" if skip_label else node.label, node)]
    while stack:
        prefix, node = stack.pop()
        yield prefix, node
        stack += [(prefix + c.label, c) for c in node.children.values()]


def _owners(node: Node, skip_label: bool = False) -> Iterator[tuple[bytes, list]]:
    return ((p, n.owner) for p, n in _walk(node, skip_label) if n.owner is not None)


def _spilled(node: Node) -> list[tuple[bytes, object]]:
    return [(p, n.file) for p, n in _walk(node, True) if n.file is not None]


def _records(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _rank(doc_id: int | None) -> tuple:
    return (doc_id is None, doc_id or 0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, grp, first, n, sha, text): the window's group of each row; n and text on one row of it."""
    base, group = TaskContext.get().partitionId() << 33, 0
    names = ["doc_id", "grp", "first", "n", "least", "sha", "text"]
    trie, rows, heads, kept = Trie(1 << 62), [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        out = []
        firsts = {}
        for doc_id, owner in rows:
            rank, n, g = owner[0], owner[1], owner[2][0]
            new = _rank(doc_id) == rank and g not in firsts
            if new:
                firsts[g] = True
            out.append((doc_id, base + g, new, n if new else None, None if rank[0] else rank[1], heads[g - start][0], heads[g - start][1] if new else None))
        for lo in range(0, len(out), 2000):
            cols = list(zip(*out[lo : lo + 2000]))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    start = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            key = normalise(text.as_buffer().to_pybytes() if text.is_valid else b"")
            owner = trie.insert(key, _rank(doc_id), 1, [])
            if not owner[2]:
                owner[2].append(group)
                heads.append((hashlib.sha256(key).hexdigest(), key))
                kept += len(key)  # a common beginning is one label in the trie, but each text is whole here
                group += 1
            rows.append((doc_id, owner))
            if trie.held + kept > WINDOW or len(rows) >= 200_000:
                yield from flush()
                trie, rows, heads, kept, start = Trie(1 << 62), [], [], 0, group
    if rows:
        yield from flush()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner of each window group of a partition's texts."""
    trie = Trie(LIMIT)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(3)]
        for grp, least, n, text in zip(*cols, batch.column(3)):
            trie.insert(text.as_buffer().to_pybytes(), (*_rank(least), grp), n, [grp])
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["grp", "keep_id", "keep_grp", "size"])

    for (unknown, least, keep), size, members in trie.finish():
        for grp in members:
            out.append((grp, None if unknown else least, keep, size))
            if len(out) >= 5000:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    local = materialise(
        rows.mapInArrow(_windows, "doc_id long, grp long, first boolean, n long, least long, sha string, text binary"), "windows"
    )
    heads = local.where("first").select("grp", "least", "n", "text", "sha").repartition(F.octet_length("text"), F.col("sha")).drop("sha")
    owners = heads.mapInArrow(_own, "grp long, keep_id long, keep_grp long, size long")
    return local.select("doc_id", "grp", "first", "sha").join(owners, "grp").select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("first") & (F.col("grp") == F.col("keep_grp"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""
