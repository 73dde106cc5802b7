"""Pieces of oversized texts, cut at natural boundaries (problem 7).

Agglomerative merging: a text starts as its atomic segments (words with the white space after
them; a longer run of other characters is cut hard). Adjacent segments wait in a heap, the weakest
boundary first; two segments merge while their combined size and the overlap fit the limit. What
is left between segments that cannot merge are the strongest boundaries of the text: ends of
pages, paragraphs, lines, sentences, clauses, and only then blanks.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
ATOM = re.compile(r"\S+\s*|\s+")
SENTENCE, CLAUSE = re.compile(r"[.!?।॥。！？][\"'”’)\]]*$"), re.compile(r"[,;:–—)|][\"'”’)\]]*$")


def strength(segment: str) -> int:
    """Of the boundary after a segment: 6 page, 5 paragraph, 4 line, 3 sentence, 2 clause, 1 blank, 0 none."""
    bare = segment.rstrip()
    space = segment[len(bare) :]
    if "\f" in space:
        return 6
    if (n := space.count("\n")) > 1:
        return 5
    if n or "\r" in space:
        return 4
    if not space:
        return 0
    return 3 if SENTENCE.search(bare) else 2 if CLAUSE.search(bare) else 1


def atoms(text: str, most: int) -> list[str]:
    out = []
    for segment in ATOM.findall(text):
        while len(segment) > most:
            at = most
            while at > most // 2 and (unicodedata.combining(segment[at]) or unicodedata.category(segment[at]) in ("Mn", "Mc", "Cf")):
                at -= 1
            out.append(segment[:at])
            segment = segment[at:]
        out.append(segment)
    return out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The starts of the pieces' own parts, the first 0, and the length of the text at the end."""
    if len(text) <= limit:
        return [0, len(text)]
    room = limit - overlap
    parts = atoms(text, room)
    size, right, left = [len(p) for p in parts], list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    force = [strength(p) for p in parts]
    # within one strength short neighbours first, so that pieces come out even; stale entries are skipped
    heap = [(force[i], size[i] + size[i + 1], i, i + 1) for i in range(len(parts) - 1)]
    heapq.heapify(heap)
    alive = [True] * len(parts)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not alive[i] or j >= len(parts) or not alive[j] or right[i] != j or total != size[i] + size[j] or total > room:
            continue
        size[i], force[i], alive[j], right[i] = total, force[j], False, right[j]
        if right[j] < len(parts):
            left[right[j]] = i
            heapq.heappush(heap, (force[i], total + size[right[i]], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (force[left[i]], size[left[i]] + total, left[i], i))
    starts, at = [], 0
    for k, p in enumerate(parts):
        if alive[k]:
            starts.append(at)
        at += len(p)
    return [*starts, len(text)]


def overlap_start(text: str, at: int, overlap: int) -> int:
    """Where the repeated tail before `at` begins: at most `overlap` characters, from the start of a word if there is one."""
    low = max(0, at - overlap)
    if low == 0 or text[low - 1].isspace():
        return low
    m = re.compile(r"\s\S").search(text, low, at)
    return m.start() + 1 if m else low


def pieces(text: str, pages: list[int] | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str, int, list[int] | None]]:
    """(piece_no, text, own_from, pages): own_from is where the piece's own part begins in the text.

    The own parts in a row are the text. A form feed stands where the next page begins; a piece has
    the pages of all its characters. Page breaks beyond the list of pages count to its last page."""
    marks = cuts(text, limit, overlap)
    feeds = [m.start() for m in re.finditer("\f", text)]
    out = []
    for k, (a, b) in enumerate(zip(marks[:-1], marks[1:])):
        start = overlap_start(text, a, overlap) if k else 0
        mine = None
        if pages is not None:
            # the form feed itself belongs to the page before it
            first, last = bisect_left(feeds, start), bisect_left(feeds, max(start, b - 1))
            mine = pages[min(first, max(len(pages) - 1, 0)) : last + 1]
        out.append((k + 1, text[start:b], a, mine))
    return out


def split_oversized(records: DataFrame, key: str = "chunk_id", text: str = "text", pages: str = "pages", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, text, own_from, pages) of the records over the limit.

    Shorter records and null texts need no cut and do not appear. A record with a null key is
    dropped; a repeated row gives its pieces once. Null pages stay null. Only oversized texts
    leave the JVM; no row is shuffled but their pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                got = pieces(t, p, limit, overlap)
                at += [i] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], ["id", "piece_no", "text", "own_from", "pages"])

    kind = records.schema[key].dataType.simpleString()
    over = records.where(F.col(key).isNotNull() & (F.length(text) > limit)).select(F.col(key), F.col(text), F.col(pages).cast("array<int>"))
    return over.mapInArrow(rows, f"id {kind}, piece_no int, text string, own_from int, pages array<int>").dropDuplicates(["id", "piece_no"]).withColumnRenamed("id", key)
