"""N-gram Jaccard join by T-occurrence search (operator 7).

Every text becomes its set of five-word shingles (``shingles.py``). Two documents link when
``100 * |A & B| >= 75 * |A | B|``; classes are the connected groups of links.

1. Equal sets form one class of copies, found by a 128-bit digest; one member stands for them.
2. A global token order puts the heaviest shingles last. It comes from a heavy-hitter summary of the
   whole corpus that holds at most ``HEAVY`` entries, so its broadcast is bounded; any total order
   gives the same links, so the summary's error costs time at most.
3. A set of n links only where at least ``T = ceil(0.75 n)`` shingles agree, so each linked pair meets
   in an inverted list of one of its first ``n - T + 1`` shingles. Each such list names its smallest
   document as host, and its members join the host's neighbourhood: rows grow with the lists'
   lengths, never with their squares, and hot lists only ever meet a grouped minimum and a join that
   adaptive execution splits.
4. A neighbourhood is cut into bands of like sizes, as linked sizes differ by a third at most; a
   document without company in its band and the next goes no further. Inside (in pair blocks of
   bounded size) parity bitmaps bound the overlap from
   above, which is exact, and drop members without a possible partner.
5. The others' whole sets are indexed block by block, and each is a T-occurrence query: short lists
   are merged and counted (as arrays, in place of a heap), long ones are binary-probed for the survivors (DivideSkip); documents
   that reach the required overlap are links. A block hands on edges to its roots, not pairs.

Null doc_id: never linked, component null. Rows with one doc_id: one node, whose texts' links join.
Null or wordless text: empty set, component is the own id. Very long texts are hashed whole, block by
block. Further columns aren't read, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounded_batches, by_key, connected_components, materialise, pair_blocks, parts, release
from .shingles import mix, shingle_sets

HEAVY = 1 << 19  # entries of the heavy-hitter summary: 8 MB at most
TIERS = 100_000  # counts above are one tier of the summary's histogram
HEAVY_LEAST = 8  # documents that make a shingle heavy
GATHER = 4_000_000  # shingles counted at once in a task
DIGEST_BITS = 1 << 23
PROBE = 4000  # postings merged in the time of probing for one document
CHUNK = 512  # documents in one side of a pair block


def _sets(batch: pa.RecordBatch, name: str, size: int) -> list[np.ndarray]:
    return list(shingle_sets(batch.column(batch.schema.get_field_index(name)), size))


def heavy_hitters(docs: DataFrame, text: str = "text", size: int = 5, keep: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the most documents, sorted, and about how many documents each has."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal token, count, held
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c > 1], c[c > 1]
            token, at = np.unique(np.concatenate((token, t)), return_inverse=True)
            count = np.bincount(at, np.concatenate((count, c)), len(token)).astype(np.int64)
            if len(token) > keep:
                top = np.sort(np.argpartition(-count, keep)[:keep])
                token, count = token[top], count[top]
            held = []

        n = 0
        for batch in batches:
            for part in parts(batch, 0):
                held += _sets(part, text, size)
                n = sum(map(len, held))
                if n >= GATHER:
                    fold()
        if held:
            fold()
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "n"])

    counts = docs.select(text).mapInArrow(summary, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= HEAVY_LEAST), "heavy")
    # the least count that keeps the summary in its bound, from a histogram of counts
    tiers = counts.groupBy(F.least("n", F.lit(TIERS)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    least, total = TIERS + 1, 0
    for t in tiers:
        total += t.k
        if total > keep:
            break
        least = t.n
    got = counts.where(F.col("n") >= least).toPandas()
    release(counts)
    token, count = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    o = np.argsort(token)
    return token[o], count[o]


def _required(n: int, percent: int) -> int:
    """Fewest common shingles that any partner of a set of n must have."""
    return -(-percent * n // 100)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap with one or two bits a token: 64 to 65536 bits."""
    bits = min(65536, max(64, 1 << max(0, len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(flat))


def describe(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, sig, prefix, bitmap) for every row; of equal sets that meet in a task only
    the first has prefix and bitmap, so that a large group of copies shrinks where it is read."""
    token, count = heavy_hitters(docs.select(text), text, size)
    heavy = docs.sparkSession.sparkContext.broadcast((token, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, df = heavy.value

        def prefix(s: np.ndarray) -> np.ndarray:
            p = len(s) - _required(len(s), percent) + 1 if len(s) else 0
            if not len(hot) or not p:
                return s[:p]
            at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
            is_hot = hot[at] == s
            light = s[~is_hot]
            if len(light) >= p:
                return light[:p]
            last = s[is_hot][np.lexsort((s[is_hot], df[at[is_hot]]))]
            return np.concatenate((light, last[: p - len(light)]))

        none, seen = np.zeros(0, np.uint64), set()
        for whole in batches:
            for batch in parts(whole, 1):
                sets = _sets(batch, "text", size)
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                first = []
                for sig, known in zip(sigs, batch.column(0).is_valid().to_pylist()):
                    first.append(known and sig not in seen)
                    if known:
                        seen.add(sig)
                if len(seen) > 1_000_000:  # forgetting costs repeats, nothing else
                    seen = set()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs, pa.binary()),
                        _lists([prefix(s) if f else none for s, f in zip(sets, first)]),
                        pa.array([_bitmap(s) if f else None for s, f in zip(sets, first)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "sig", "prefix", "bitmap"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, sig binary, prefix array<long>, bitmap binary")


def _plausible(percent: int):
    """Keeps a block's members that may have a partner across the block, by their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_key(batches, ["host", "band", "i", "j"]):
            if g.num_rows < 2:
                continue
            n, c = g["n_shingles"].to_numpy(), g["c"].to_numpy()
            top = g["own"].to_numpy() == g["band"].to_numpy()
            i, j = g["i"][0].as_py(), g["j"][0].as_py()
            column = g["bitmap"].to_pylist()
            width = np.array([len(b) // 8 for b in column])
            keep = np.zeros(g.num_rows, bool)
            for w in np.unique(width).tolist():
                # linked sets differ by less than a factor of two, so their bitmaps do by two at most
                maps = {k: np.frombuffer(column[k], np.uint64) for k in np.flatnonzero((width == w) | (width == 2 * w)).tolist()}
                maps = {k: m if len(m) == w else m[:w] ^ m[w:] for k, m in maps.items()}  # folding keeps parity
                some = np.array(list(maps))
                m = np.array(list(maps.values()))
                left, right = np.flatnonzero(c[some] == i), np.flatnonzero(c[some] == j)
                step = max(1, 2_000_000 // max(1, len(right) * w))
                for at in range(0, len(left), step):
                    a = left[at : at + step]
                    x, y = some[a], some[right]
                    apart = np.bitwise_count(m[a][:, None] ^ m[right][None]).sum(2, dtype=np.int64)
                    total = n[x][:, None] + n[y][None]
                    # overlap <= (total - apart) / 2, and a link needs (100 + percent) * overlap >= percent * total
                    fits = ((100 + percent) * (total - apart) >= 2 * percent * total) & (x[:, None] != y[None]) & (top[x][:, None] | top[y][None])
                    fits &= 100 * np.minimum(n[x][:, None], n[y][None]) >= percent * np.maximum(n[x][:, None], n[y][None])
                    keep[x] |= fits.any(1)
                    keep[y] |= fits.any(0)
            if keep.any():
                yield from g.filter(pa.array(keep)).select(["host", "band", "i", "j", "c", "doc_id"]).combine_chunks().to_batches()

    return run


class InvertedLists:
    """Inverted lists of a block's indexed sets: for each token its sorted ordinals."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        token = np.concatenate([sets[k] for k in members])
        self.owner = np.repeat(members, self.sizes[members])
        o = np.lexsort((self.owner, token))
        token, self.owner = token[o], self.owner[o]
        self.start = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        self.token = token[self.start[:-1]]

    def _merged(self, lists: np.ndarray) -> np.ndarray:
        """How often each ordinal stands in the lists."""
        first, n = self.start[lists], self.start[lists + 1] - self.start[lists]
        flat = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.bincount(self.owner[flat], minlength=len(self.sets))

    def t_occurrence(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Ordinals that link with the query, by DivideSkip.

        A partner shares ``need`` tokens at least. Of the query's lists the longest are set apart; as a
        partner can be missing from the short ones that many times at most, the short lists are merged
        and counted against the rest of ``need``, and the long ones are binary-probed for what is left."""
        need = _required(len(query), percent)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.start[at + 1] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        apart = min(need - 1, int(need / (0.5 * math.log2(int(length.max()) + 1) + 1)))
        short, long = at[: len(at) - apart], at[len(at) - apart :]
        hits = self._merged(short)
        found = np.flatnonzero(hits >= need - apart)
        hits = hits[found]
        if apart and len(found) * PROBE < length[np.argsort(length)[len(at) - apart :]].sum():
            tokens = np.sort(self.token[long])
            for i, k in enumerate(found.tolist()):
                own = self.sets[k]
                hits[i] += (own[np.minimum(np.searchsorted(own, tokens), len(own) - 1)] == tokens).sum()
        elif apart and len(found):  # so many survivors that one pass over the long lists costs less
            hits = hits + self._merged(long)[found]
        return found[(100 + percent) * hits >= percent * (len(query) + self.sizes[found])]


def _search(percent: int):
    """Links of each block, as edges from each member to its root within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_key(batches, ["host", "band", "i", "j"]):
            ids, c = g["doc_id"].to_numpy(), g["c"].to_numpy()
            flat = g["tokens"].combine_chunks()
            off = flat.offsets.to_numpy()
            values = flat.values.to_numpy()
            sets = [values[a:b] for a, b in zip(off, off[1:])]
            i, j = g["i"][0].as_py(), g["j"][0].as_py()
            right, left = np.flatnonzero(c == j), np.flatnonzero(c == i)
            if i == j and len(right) < 2 or not len(right) or not len(left):
                continue
            lists, forest = InvertedLists(sets, right), Forest(len(sets))
            for q in left.tolist():
                for k in lists.t_occurrence(sets[q], percent).tolist():
                    if k != q:
                        forest.union(q, k)
            root = np.array([forest.find(k) for k in range(len(sets))])
            linked = np.flatnonzero(root != np.arange(len(sets)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

    return run


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def id_digest(ids: DataFrame) -> np.ndarray | None:
    """A bitmap of hashed ids, 1 MB at most, to leave most other rows' texts where they are; None where there are too
    many ids for it, and a join (with a runtime filter of Spark's own) does the same. Only the join that follows decides, so it never changes results."""
    n = ids.count()
    if n * 16 > DIGEST_BITS:
        return None
    bits = max(1024, 1 << (16 * n - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], ["word", "bit"])

    rows = ids.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).collect()
    digest = np.zeros(bits >> 6, np.int64)
    for r in rows:
        digest[r.word] = r.bit
    return digest


def in_digest(digest: np.ndarray, ids: pa.Array) -> np.ndarray:
    slot = _slot(ids.fill_null(0).to_numpy(), len(digest) << 6)
    return (digest[slot >> 6] >> (slot & 63)) & 1 == 1


def ngram_jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    bounded_batches(docs.sparkSession)
    rows = materialise(describe(docs, doc_id, text, size, percent), "sets")
    classes = (
        rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("sig")
        .agg(F.min("doc_id").alias("head"), F.max("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap"))
    )
    classes = materialise(classes, "classes")
    entries = rows.select("doc_id", F.explode("prefix").alias("token"))
    hosts = entries.groupBy("token").agg(F.min("doc_id").alias("host"), F.count("*").alias("k")).where("k > 1")
    near = entries.join(hosts.drop("k"), "token").where("doc_id <> host").select("host", "doc_id").distinct()
    # copies that met in lists give way to the document that stands for them
    stands = rows.where("n_shingles > 0").select("doc_id", "sig").join(classes.select("sig", "head"), "sig").where("doc_id <> head")
    stands = materialise(stands.select("doc_id", "head").distinct(), "stands")
    plain = stands.join(classes.select(F.col("head").alias("doc_id")), "doc_id", "left_anti")
    for end in ("doc_id", "host"):
        swap = plain.select(F.col("doc_id").alias(end), "head")
        near = near.join(swap, end, "left").withColumn("as", F.coalesce("head", end)).drop(end, "head").withColumnRenamed("as", end)
    near = near.where("host <> doc_id").select("host", "doc_id").distinct()
    near = near.union(near.select("host", F.col("host").alias("doc_id")).distinct())
    width = math.log(100 / percent) + 1e-9 if percent < 100 else 1e-9  # linked sizes lie in one band or in neighbours
    shape = classes.select(F.col("head").alias("doc_id"), "n_shingles", F.floor(F.log("n_shingles") / width).cast("int").alias("own"))
    banded = near.join(shape, "doc_id").withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    banded = materialise(banded, "near")
    sizes = banded.groupBy("host", "band").agg(F.count("*").alias("k"), F.max("own").alias("top")).where("k > 1 AND top = band").drop("top")
    blocks = pair_blocks(banded.join(sizes, ["host", "band"]), F.col("doc_id"), "k", chunk)
    keys = ["host", "band", "i", "j"]
    maps = classes.select(F.col("head").alias("doc_id"), "n_shingles", "bitmap")
    blocks = blocks.join(maps, ["doc_id", "n_shingles"]).select(*keys, "c", "doc_id", "own", "n_shingles", "bitmap")
    blocks = blocks.repartition(*keys).sortWithinPartitions(*keys)
    kept = materialise(blocks.mapInArrow(_plausible(percent), "host long, band int, i int, j int, c int, doc_id long"), "plausible")
    release(banded)

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wanted = kept.select("doc_id").distinct()
    digest = id_digest(wanted)
    if digest is None:
        texts = texts.join(wanted, "doc_id", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(digest)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if sent.value is not None:
                whole = whole.filter(pa.array(in_digest(sent.value, whole.column(0))))
            for batch in parts(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_sets(batch, "text", size))], ["doc_id", "tokens"])

    sets = texts.mapInArrow(tokens, "doc_id long, tokens array<long>").where(F.size("tokens") > 0)
    found = kept.join(sets, "doc_id").select(*keys, "c", "doc_id", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    links = found.mapInArrow(_search(percent), "a long, b long")
    # copies hang on their head alone; only ids that are a head too, or have several heads, need rounds
    several = stands.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    odd = stands.join(several.union(classes.select("head")).distinct(), "doc_id", "left_semi")
    groups = connected_components(links.union(odd))
    release(kept, stands)
    head = rows.select("doc_id", "n_shingles", "sig").join(classes.select("sig", "head"), "sig", "left")
    out = head.join(groups.withColumnRenamed("node", "head"), "head", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
        .when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.coalesce("component", "head", "doc_id"))
        .alias("component_id"),
    )
