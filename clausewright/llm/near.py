"""Groups of records with nearly the same text (problem 1), by an exact join on rare n-grams.

A text is the set of its sequences of three consecutive words, in the common form and lower case.
Two texts are linked when the share of common sequences among all their sequences is at least
`threshold`; a group is whatever links connect.

1. Equal sets are one row (`cls`), so copies cost nothing further on.
2. The n-grams of every set are put in one order, rare ones first. Two linked sets have at least
   need = threshold / (1 + threshold) * (|A| + |B|) n-grams in common, so the first of them stands
   where at least `need` are left in either set. Pairs that share no n-gram at such places, and pairs
   whose smaller set holds less than `threshold` of the larger, cannot be linked; all others are met.
   The order is taken from a sample; any order gives the same links, a good one meets fewer pairs.
3. Pairs met are discarded by the n-grams that the bitmap of the other set lacks, of 256 and then of
   1024 bits, and counted over 32 bits of each n-gram's hash. What 32 bits fall together by chance
   is allowed for. Where that could decide, the 64-bit hashes are counted.

No step loses a link. The sets lie in blocks of ROWS, each a file in the shared folder; every block
meets every block and itself, and pairs are formed, discarded and counted within the two blocks: only
links leave a task. The pairs met grow with the square of the number of texts.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, remove, scratch
from .looks import common_form

SHINGLE, THRESHOLD = 3, 0.5
SMALL = 1_000_000  # ids of this many rows (8 MB) are broadcast, more are shuffled
BLOCK = 128  # rows of a block that are paired in one piece; larger blocks are cut into a grid of such
SAMPLE, COMMON = 30_000, 1 << 18  # sets whose n-grams are counted for the order, n-grams of which the count is kept
ROWS, GRAMS = 24_000, 6_000_000  # sets (65,535 at most) and n-grams of a block
TASKS = 10_000  # tasks at most, over which the pairs of blocks are dealt
MET = 1 << 16  # pairs formed at a time
LARGE, LONG = 256, 8192  # sets of more n-grams are compared by bitmaps of so many bits
LONGS = pa.list_(pa.int64())
WORDS = re.compile(r"[^\W_]+")
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


class WordIds:
    """64-bit ids of words, the same in every process; the cache is emptied when it grows large."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > 1_000_000:
            ids.clear()
        try:
            return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in ids:
                    ids[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))


class Tokens:
    """Numbers of what stands between blanks, each with the ids of its words; most have one word, some none or several.
    A word never goes over a blank, so a text's words are those of its tokens."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.count, self.ids = array("q"), array("Q")

    def of(self, text: str) -> np.ndarray:
        tokens, known = text.split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = len(known)
                    words = WORDS.findall(t)
                    self.count.append(len(words))
                    self.ids.extend(map(xxhash.xxh3_64_intdigest, words))
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def words(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of texts, one after another, and how many words each text has."""
        flat, count = np.concatenate(numbers), np.array(self.count, np.int64)
        each = count[flat]
        ends = np.cumsum([len(x) for x in numbers])
        return np.array(self.ids, np.uint64)[_places((np.cumsum(count) - count)[flat], each)], np.diff(np.r_[0, np.cumsum(each)][ends], prepend=0)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the sequences of k words, ascending; none if there are fewer words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    h = words[: len(words) - k + 1]
    for i in range(1, k):
        h = mixed(h) + words[i : len(words) - k + 1 + i]
    return np.unique(mixed(h))


def text_words(text: str) -> list[str]:
    return WORDS.findall(common_form(text).lower())


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def incidence(texts: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(id, cls, n, grams): the distinct n-grams of every text with at least k words, ascending as unsigned hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(known.known) > 1_000_000:
                known = Tokens()
            ids, size = known.words([known.of(common_form(t).lower()) for t in batch.column(1).to_pylist()])
            keep = np.flatnonzero(size >= k)
            if not len(keep):
                continue
            ids, size = ids[np.repeat(size >= k, size)], size[keep]
            h = ids
            for j in range(1, k):
                h = mixed(h[:-1]) + ids[j:]
            # windows that run over the end of a text are dropped
            ends = np.cumsum(size)
            inside = np.ones(len(ids), bool)
            for j in range(1, k):
                inside[ends - j] = False
            h = mixed(h)[inside[: len(h)]]
            owner = np.repeat(np.arange(len(keep)), size - k + 1)
            starts = np.cumsum([0, *(size - k + 1)])
            for a, b in zip(starts[:-1], starts[1:]):
                h[a:b].sort()
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[first], owner[first]
            n = np.bincount(owner, minlength=len(keep))
            starts = np.cumsum([0, *n])
            cls = np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])], np.uint64).view(np.int64)
            grams = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(cls), pa.array(n, pa.int32()), grams], ["id", "cls", "n", "grams"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(rows, f"id {kind}, cls bigint, n int, grams array<bigint>")


class Block(NamedTuple):
    """Sets of a block by size, their n-grams as 32 bits with rare ones first, and what is worked out from these."""

    cls: np.ndarray
    n: np.ndarray
    size: np.ndarray  # different values among the 32 bits, n or few less
    starts: np.ndarray
    grams: np.ndarray
    cells: np.ndarray  # n-gram, set (16 bits), place (16 bits) wherever a link's first common n-gram can stand; ascending
    doc: np.ndarray
    most: np.ndarray  # n of the largest set that can be linked over this cell
    share: np.ndarray  # what a set's size adds to the n-grams that a link has in common
    maps: list[tuple[list[np.ndarray], np.ndarray]]  # words of bitmaps of 256 and of 1024 bits, and share less the n-grams beyond their bits


def bitmaps(grams: np.ndarray, size: np.ndarray, width: int = 1024) -> np.ndarray:
    bits = np.zeros((len(size), width), bool)
    bits[np.repeat(np.arange(len(size)), size), grams & np.uint32(width - 1)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def prepared(cls: np.ndarray, n: np.ndarray, size: np.ndarray, grams: np.ndarray, wide: np.ndarray, threshold: float) -> Block:
    starts = np.cumsum(size) - size
    short = np.minimum(size, np.floor(n * (1 - threshold) + 1e-6).astype(np.int64) + 1)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(16), short)
    place = _places(np.zeros(len(n), np.int64), short)
    cells = grams[place + np.repeat(starts, short)].astype(np.uint64) << np.uint64(32)
    cells |= doc
    cells |= np.minimum(place, 65535).astype(np.uint64)
    cells.sort()
    doc = (cells.astype(np.uint32) >> np.uint32(16)).astype(np.int32)
    left = n[doc] - cells.astype(np.uint16)
    most = np.minimum(left * ((1 + threshold) / threshold) - n[doc] + 1e-6, 2**31 - 1).astype(np.int32)
    wide = wide.reshape(-1, 16)
    share = needed(n, np.zeros(1), threshold)
    maps = [([np.ascontiguousarray(w) for w in m.T], share - (n - np.bitwise_count(m).sum(axis=1))) for m in (np.bitwise_or.reduce(wide.reshape(-1, 4, 4), axis=1), wide)]
    return Block(cls, n, size, starts, grams, cells, doc, most, share, maps)


def needed(a_n: np.ndarray, b_n: np.ndarray, threshold: float) -> np.ndarray:
    return threshold / (1 + threshold) * (a_n + b_n) - 1e-9


def _bounded(x: Block, y: Block, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Which of the pairs of sets a of x and b of y can be linked by their bitmaps."""
    (p, p_least), (q, q_least) = x.maps[which], y.maps[which]
    both = np.zeros(len(a), np.int16)
    for v, w in zip(p, q):
        both += np.bitwise_count(v.take(a) & w.take(b))
    return both >= np.maximum(p_least.take(a) + y.share.take(b), x.share.take(a) + q_least.take(b))


def _bounded_large(x: Block, y: Block, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The same by bitmaps of LONG bits, for pairs of large sets; the others pass."""
    passed = np.ones(len(a), bool)
    large = np.flatnonzero((x.n[a] > LARGE) & (y.n[b] > LARGE))
    for i in range(0, len(large), 512):
        at = large[i : i + 512]
        maps, rows, over = [], [], []
        for s, r in ((x, a[at]), (y, b[at])):
            sets, back = np.unique(r, return_inverse=True)
            bits = bitmaps(s.grams[_places(s.starts[sets], s.size[sets])], s.size[sets], LONG)
            maps.append(bits)
            rows.append(back)
            over.append((s.n[sets] - np.bitwise_count(bits).sum(axis=1))[back])
        both = np.bitwise_count(maps[0][rows[0]] & maps[1][rows[1]]).sum(axis=1)
        passed[at] = np.minimum(*over) + both >= needed(x.n[a[at]], y.n[b[at]], threshold)
    return passed


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _met(x: Block, y: Block, threshold: float) -> Iterator[np.ndarray]:
    """a * len(y.n) + b of the pairs that meet at a cell and pass the bounds of size, place and 256 bits, some repeatedly."""
    upto = np.searchsorted(x.n, np.arange(x.n[-1] + 2)).astype(np.uint64) << np.uint64(16)  # sets of less than n
    least = np.searchsorted(x.n, np.ceil(threshold * y.n - 1e-9)).astype(np.uint64) << np.uint64(16)
    for s in range(0, len(y.cells), MET // 4):
        cells, doc = y.cells[s : s + MET // 4], y.doc[s : s + MET // 4]
        gram = cells & np.uint64(2**64 - 2**32)
        end = upto[np.minimum(y.most[s : s + MET // 4], x.n[-1]) + 1]
        if x is y:
            end = np.minimum(end, doc.astype(np.uint64) << np.uint64(16))
        lo = np.searchsorted(x.cells, gram + least[doc])
        count = np.searchsorted(x.cells, gram + end) - lo
        some = np.flatnonzero(count > 0)
        lo, count, doc = lo[some], count[some], doc[some].astype(np.intp)
        size = y.n[doc].astype(np.int32)
        ends = np.cumsum(count)
        i = 0
        while i < len(count):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - count[i] + MET, "right")))
            at = _places(lo[i:j], count[i:j])
            near = np.flatnonzero(x.most.take(at) >= np.repeat(size[i:j], count[i:j]))
            a, b = x.doc.take(at.take(near)).astype(np.intp), np.repeat(doc[i:j], count[i:j]).take(near)
            near = np.flatnonzero(_bounded(x, y, a, b, 0))
            yield np.unique(a.take(near) * len(y.n) + b.take(near))
            i = j


def block_links(x: Block, y: Block, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, overlap, doubt): pairs of sets of two blocks, or of one and the same, at or above the threshold,
    with their n-grams in common by 32 bits; those near the threshold, where 32 bits may deceive, are in doubt."""
    met = [*_met(x, y, threshold)]
    a, b = np.divmod(np.unique(np.concatenate(met)), len(y.n)) if met else (np.empty(0, np.int64),) * 2
    for bound in (lambda a, b: _bounded(x, y, a, b, 1), lambda a, b: _bounded_large(x, y, a, b, threshold)):
        near = bound(a, b)
        a, b = a[near], b[near]
    ends = np.cumsum(x.size[a] + y.size[b])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MET, "right")))
        p, q = a[i:j], b[i:j]
        number = np.arange(j - i, dtype=np.uint64) << np.uint64(32)
        grams = np.concatenate([np.repeat(number, s.size[r]) | s.grams[_places(s.starts[r], s.size[r])] for s, r in ((x, p), (y, q))])
        grams.sort()
        twice = grams[1:][grams[1:] == grams[:-1]]
        overlap = np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=j - i)
        need = needed(x.n[p], y.n[q], threshold)
        near = overlap + np.minimum(x.n[p] - x.size[p], y.n[q] - y.size[q]) >= need
        doubt = overlap - 3 - 8 * x.n[p] * y.n[q] / 2**32 < need
        yield x.cls[p[near]], y.cls[q[near]], overlap[near], doubt[near]
        i = j


def common_grams(docs: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent values of the first 22 bits of n-grams, and how often they occur, in a sample of the sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 22, np.int64)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            seen += np.bincount((flat[ends[0] : ends[-1]].view(np.uint64) >> np.uint64(42)).astype(np.int64), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["head", "n"])

    some = docs.where(F.pmod("cls", F.lit(-(-texts // SAMPLE))) == 0).select("grams").mapInArrow(rows, "head int, n bigint")
    kept = some.groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "head").limit(COMMON).toArrow()
    return kept.column("head").to_numpy(), kept.column("n").to_numpy()


def blocks(docs: DataFrame) -> DataFrame:
    """(least, most, cls, n, size, grams, maps): one row per block of sets; numbers of all their sets as bytes."""
    texts = docs.count()
    heads, counts = common_grams(docs, max(texts, 1))
    sent = docs.sparkSession.sparkContext.broadcast((heads, counts))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(1 << 22, np.uint64)
        often[sent.value[0]] = sent.value[1]
        for batch in batches:
            flat, ends = _flat(batch.column(2))
            grams = flat[ends[0] : ends[-1]].view(np.uint64) >> np.uint64(32)
            ends = ends - ends[0]
            grams |= often[grams >> np.uint64(10)] << np.uint64(32)
            for a, b in zip(ends[:-1], ends[1:]):
                grams[a:b].sort()
            first = np.ones(len(grams), bool)
            first[1:] = grams[1:] != grams[:-1]
            first[ends[:-1]] = True
            starts = np.r_[0, np.cumsum(first)][ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(grams[first].astype(np.uint32).view(np.int32)))], ["cls", "n", "grams"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            flat, ends = _flat(batch.column(2))
            got.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), np.diff(ends), flat[ends[0] : ends[-1]].copy()))
        if not got:
            return
        cls, n, size, grams = (np.concatenate(g) for g in zip(*got))
        got.clear()
        starts = np.cumsum(size) - size
        order = np.unique(cls, return_index=True)[1]
        order = order[np.argsort(n[order], kind="stable")]
        ends = np.cumsum(size[order])
        i = 0
        while i < len(order):
            j = max(i + 1, min(i + ROWS, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + GRAMS, "right"))))
            at = order[i:j]
            held = [cls[at], n[at], size[at].astype(np.int64), grams[_places(starts[at], size[at])]]
            held.append(bitmaps(held[3].view(np.uint32), held[2]))
            yield pa.RecordBatch.from_arrays([pa.array([n[at[0]]]), pa.array([n[at[-1]]]), *(pa.array([h.tobytes()], pa.binary()) for h in held)], ["least", "most", "cls", "n", "size", "grams", "maps"])
            i = j

    parts = max(4, -(-texts * 25 // (ROWS * 24)))
    return docs.select("cls", "n", "grams").mapInArrow(ordered, "cls bigint, n int, grams array<int>").repartition(parts, "cls").mapInArrow(packed, "least bigint, most bigint, cls binary, n binary, size binary, grams binary, maps binary")


def read_block(uri: str, threshold: float) -> Block:
    """A block of the one row in a file of the shared folder, which workers read themselves: none goes through a shuffle or the JVM."""
    files, path = fs.FileSystem.from_uri(quote(uri, safe=string.punctuation))  # Spark leaves letters beyond ASCII as they are
    row = pq.read_table(path, filesystem=files, columns=["cls", "n", "size", "grams", "maps"], partitioning=None)
    return prepared(*(np.frombuffer(c[0].as_buffer(), t) for c, t in zip(row.columns, (np.int64, np.int64, np.int64, np.uint32, np.uint64))), threshold)


def product(incident: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, shared): pairs of rows, a < b, with the number of columns both have.

    For columns that are few or rare; the links of texts do not go through it.

    One shuffle of the cells by column into `parts`, as many as keep a task's share small; most columns
    have one row and end there. A block of more than BLOCK rows is cut into a grid of pieces, whose
    products are spread over all tasks."""

    def blocks(col: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((cls, col))
        col, cls = col[order], cls[order]
        once = np.ones(len(col), bool)
        once[1:] = (col[1:] != col[:-1]) | (cls[1:] != cls[:-1])
        col, cls = col[once], cls[once]
        edge = np.flatnonzero(np.r_[True, col[1:] != col[:-1], True])
        size = np.diff(edge)
        left: list[list[int]] = []
        right: list[list[int] | None] = []
        for a, m in zip(edge[:-1][size > 1].tolist(), size[size > 1].tolist()):
            if m <= BLOCK:
                left.append(cls[a : a + m].tolist())
                right.append(None)
                continue
            parts = [cls[a + i : a + min(i + BLOCK, m)].tolist() for i in range(0, m, BLOCK)]
            for i, part in enumerate(parts):
                for other in parts[i:]:
                    left.append(part)
                    right.append(other)
                    if len(left) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(left, LONGS), pa.array(right, LONGS)], ["l", "r"])
                        left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, LONGS), pa.array(right, LONGS)], ["l", "r"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("col").to_numpy(), b.column("cls").to_numpy()) for b in batches]
        if got:
            yield from blocks(*(np.concatenate(x) for x in zip(*got)))

    spread = incident.repartition(parts, "col") if parts else incident.repartition("col")
    pieces = spread.mapInArrow(rows, "l array<bigint>, r array<bigint>").repartition(F.xxhash64("l", "r"))
    pairs = pieces.select(F.explode("l").alias("a"), F.coalesce("r", "l").alias("r")).select("a", F.explode("r").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def linked_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap): the pairs of different n-gram sets at or above the threshold, all of them."""

    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "blocks")
    try:
        blocks(docs).write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(folder)
        files = sorted(map(tuple, spark.read.parquet(folder).select(F.input_file_name(), "least", "most").collect()))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Block] = {}

            def block(i: int) -> Block:
                if i not in held:
                    held[i] = read_block(files[i][0], threshold)
                return held[i]

            for batch in batches:
                for pair in batch.column(0).to_pylist():
                    i = (math.isqrt(8 * pair + 1) - 1) // 2
                    j = pair - i * (i + 1) // 2
                    (_, least, most), (_, least_, most_) = files[i], files[j]
                    if most < threshold * least_ - 1e-6 or most_ < threshold * least - 1e-6:
                        continue
                    for other in held.keys() - {i, j}:
                        del held[other]
                    for a, b, overlap, doubt in block_links(block(i), block(j), threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(overlap), pa.array(doubt)], ["a", "b", "overlap", "doubt"])

        count = len(files) * (len(files) + 1) // 2  # a pair's number is i * (i + 1) / 2 + j, so most pairs that a task has in turn share a block
        near = cut(spark.range(0, count, 1, max(1, min(-(-count // 3), TASKS))).mapInArrow(rows, "a bigint, b bigint, overlap bigint, doubt boolean"))
    finally:
        remove(spark, folder)
    doubt = near.where("doubt").select("a", "b")
    ends = doubt.select(F.col("a").alias("cls")).unionByName(doubt.select(F.col("b").alias("cls"))).distinct()
    ends = F.broadcast(ends) if doubt.count() * 2 <= SMALL else ends
    grams = docs.select("cls", "n", "grams").join(ends, "cls", "left_semi").dropDuplicates(["cls"])
    side = lambda s: grams.select(F.col("cls").alias(s), F.col("n").alias(f"{s}_n"), F.col("grams").alias(f"{s}_grams"))
    need = F.ceil(F.lit(threshold) / F.lit(1 + threshold) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    counted = doubt.join(side("a"), "a").join(side("b"), "b").withColumn("overlap", F.size(F.array_intersect("a_grams", "b_grams")).cast("bigint")).where(F.col("overlap") >= need)
    return near.where("not doubt").select("a", "b", "overlap").unionByName(counted.select("a", "b", "overlap"))


def near_duplicates(texts: DataFrame, key: str, text: str, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(key, group): the group of every text that is linked with, or has the same n-grams as,
    another; others do not appear.

    Null keys and texts, and texts of fewer than k words, belong to no group (they have no
    sequences to share). A repeated row counts once. Other columns are ignored."""
    docs = incidence(texts, key, text, k).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        links = cut(linked_pairs(docs, threshold))
        members = cut(docs.select("id", "cls").distinct())
    finally:
        docs.unpersist()
    joined = connected_components(links, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    placed = members.join(joined, "cls", "left").select("id", F.coalesce("grp", "cls").alias("grp")).groupBy("id").agg(F.min("grp").alias("grp"))
    crowd = placed.groupBy("grp").count().where("count > 1").select("grp")
    return placed.join(crowd, "grp", "left_semi").select(F.col("id").alias(key), F.col("grp").alias("group"))


MEMBERS = 2000  # members of a group that a task holds against all others


def group_pairs(groups: DataFrame, key: str) -> DataFrame:
    """All pairs within a group, smaller key first. A large group is spread over as many tasks as its size asks for."""
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("tasks"))
    known = groups.join(sizes, "group")
    left = known.select("group", F.col(key).alias(f"{key}_a"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
    right = known.select("group", F.col(key).alias(f"{key}_b"), F.pmod(F.xxhash64(key), F.col("tasks")).cast("int").alias("salt"))
    return left.join(right, ["group", "salt"]).where(f"{key}_a < {key}_b").select(f"{key}_a", f"{key}_b")
