"""The reading level of each document (problem 10).

A document's demand on vocabulary is the size of the smallest frequency-ranked vocabulary of the
corpus that covers a fixed share of its words; its demand on syntax is the length of the sentence a
word of it stands in, and the length of its words. The bands are calibrated on rated documents in
SQL: every band has the median of each measure over its rated documents, a measure's scale is the
bands' median deviation, and a document belongs to the nearest band. Medians keep single ratings
that are off by one from moving a band.

Every text is parsed once: one Arrow pass turns each mainly English document into its distinct words
with their counts and the two other measures, and sums the words of its task. The rank of a word is
one more than the number of words of the corpus that are more frequent, so it follows from the
frequency alone and needs no order of the whole vocabulary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .looks import common_form
from .pairs import BY_WORD

SHARE = 0.6  # of a document's words that the vocabulary must cover
SENT = 50_000  # most frequent words whose ranks travel to the tasks; the ranks of others are joined
RATED = 50_000  # rated documents used to calibrate, at most
LEAST_WORDS = 60
PIECE = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?।](?= )|[\n\f]")  # a word, or the end of a sentence
ENGLISH = frozenset(w for w, of in BY_WORD.items() if of == {"en"})
OTHERS = frozenset(w for w, of in BY_WORD.items() if "en" not in of)
ELSEWHERE = re.compile("[ɐ-᷿Ⰰ-￿]")  # scripts other than Latin
END, OURS, THEIRS, FOREIGN = 1, 2, 4, 8


class Lexicon(dict):
    """Words numbered as they come; a word's hash, length and marks are found once per task."""

    def __init__(self) -> None:
        super().__init__()
        self.hash: list[int] = []
        self.size: list[int] = []
        self.mark: list[int] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        end = not word[0].isalnum()
        self.hash.append(xxhash.xxh3_64_intdigest(word) - 2**63)
        self.size.append(0 if end else len(word))
        self.mark.append(END if end else OURS * (word in ENGLISH) + THEIRS * (word in OTHERS) + FOREIGN * bool(ELSEWHERE.search(word)))
        return n


def mainly_english(doc: np.ndarray, sentence: np.ndarray, mark: np.ndarray, docs: int) -> np.ndarray:
    """Whether more words of each document stand in English sentences than in those of other languages.

    doc, sentence and mark of every word, sentences numbered through. Frequent words that only one
    side has vote for the sentence, and words in a script other than Latin vote against it. Sentences
    without a vote, as in lists of names, count for neither side."""
    many = int(sentence[-1]) + 1 if len(sentence) else 0
    ours = np.bincount(doc, (mark & OURS) > 0, docs)
    votes = np.bincount(sentence, ((mark & OURS) > 0) * 1.0 - ((mark & THEIRS) > 0) - ((mark & FOREIGN) > 0), many)
    size = np.bincount(sentence, minlength=many)
    of = np.zeros(many, np.int64)
    of[sentence] = doc
    balance = np.bincount(of, np.sign(votes) * size, docs)
    foreign = np.bincount(doc, (mark & (THEIRS | FOREIGN)) > 0, docs)
    return (ours > 0) & ((balance > 0) | (foreign == 0))


PARSED = "words int, sentence double, letters double, summary boolean, ids array<bigint>, counts array<int>"


def _lists(owner: np.ndarray, docs: int) -> np.ndarray:
    return np.append(0, np.cumsum(np.bincount(owner, minlength=docs))).astype(np.int32)


def parsed(documents: DataFrame) -> DataFrame:
    """One row per mainly English document: how many words it has, the logarithm of the mean length of
    the sentence a word stands in, the mean length of a word, and its distinct words (hashes) with
    counts. Besides, `summary` rows without a doc_id hold the words of all such documents of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, kind = Lexicon(), np.zeros(0, np.int64), None

        def summary() -> pa.RecordBatch:
            met = np.flatnonzero(total)
            ids = pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), pa.array(np.array(known.hash, np.int64)[met]))
            counts = pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), pa.array(total[met].astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([True]), ids, counts], names)

        names = ["doc_id", "words", "sentence", "letters", "summary", "ids", "counts"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pieces = [PIECE.findall(common_form(t).lower()) for t in part.column(1).to_pylist()]
                docs = len(pieces)
                # every document ends with a sentence end of its own
                size = np.array([len(p) + 1 for p in pieces])
                word = np.fromiter(map(known.__getitem__, chain.from_iterable(p + ["\n"] for p in pieces)), np.int64, int(size.sum()))
                mark, length = np.array(known.mark, np.int8)[word], np.array(known.size, np.int32)[word]
                doc, end = np.repeat(np.arange(docs), size), mark == END
                sentence = (np.cumsum(end) - end)[~end]
                word, doc, mark, length = word[~end], doc[~end], mark[~end], length[~end]
                english = mainly_english(doc, sentence, mark, docs)
                keep = english[doc]
                word, doc, sentence, length = word[keep], doc[keep], sentence[keep], length[keep]
                n = np.bincount(doc, minlength=docs)
                many = np.bincount(sentence)[sentence] if len(sentence) else sentence
                with np.errstate(divide="ignore", invalid="ignore"):
                    spoken, letters = np.log(np.bincount(doc, many, docs) / n), np.bincount(doc, length, docs) / n
                key, count = np.unique(doc * len(known) + word, return_counts=True)
                owner, word = np.divmod(key, len(known))
                if len(total) < len(known):
                    total = np.append(total, np.zeros(len(known) - len(total), np.int64))
                np.add.at(total, word, count)
                long = n >= LEAST_WORDS
                chosen = np.flatnonzero(long)
                of = long[owner]
                ends = _lists((np.cumsum(long) - 1)[owner[of]], len(chosen))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(known.hash, np.int64)[word[of]]))
                counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(count[of].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(chosen)), pa.array(n[chosen].astype(np.int32)), pa.array(spoken[chosen]), pa.array(letters[chosen]), pa.array(np.zeros(len(chosen), bool)), ids, counts], names)
                if len(known) > 500_000:
                    yield summary()
                    known, total = Lexicon(), np.zeros(0, np.int64)
        if kind is not None:
            yield summary()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {PARSED}")


def word_ranks(parse: DataFrame) -> DataFrame:
    """(id, rank) of all words: one more than the number of words that are more frequent. Only the
    levels, one row per different frequency, are put in order; their number is at most the root of
    twice the number of words of the corpus."""
    words = cut(parse.where("summary").select(F.explode(F.arrays_zip("ids", "counts")).alias("w")).groupBy(F.col("w.ids").alias("id")).agg(F.sum("w.counts").alias("n")))
    levels = words.groupBy("n").agg(F.count("*").alias("c"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return words.join(levels.select("n", (1 + F.coalesce(F.sum("c").over(before), F.lit(0))).alias("rank")), "n").select("id", "rank")


def measures(parse: DataFrame, ranks: DataFrame, sent: int = SENT) -> DataFrame:
    """(doc_id, words, vocabulary, sentence, letters) of the documents of LEAST_WORDS or more; the
    first two measures as logarithms.

    The ranks of the most frequent words, at most `sent`, travel to the tasks. Where they do not cover SHARE of
    a document, its other words are joined with the ranks of all words, so the size of `sent`
    changes the plan and not the result."""
    levels = ranks.groupBy("rank").agg(F.count("*").alias("c"))  # one row per different frequency
    last = levels.where(F.col("rank") - 1 + F.col("c") <= sent).agg(F.max("rank")).first()[0] or 0
    first = ranks.where(F.col("rank") <= last).toPandas().sort_values("id")  # at most `sent` rows
    known = parse.sparkSession.sparkContext.broadcast((first["id"].to_numpy(), first["rank"].to_numpy()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rank_of = known.value
        for batch in batches:
            docs = batch.num_rows
            n = batch.column("words").to_numpy()
            ids, counts = batch.column("ids").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            owner = np.repeat(np.arange(docs), np.diff(batch.column("ids").offsets.to_numpy()))
            need = np.ceil(SHARE * n - 1e-9).astype(np.int64)
            at = np.minimum(np.searchsorted(have, ids), max(0, len(have) - 1))
            hit = have[at] == ids if len(have) else np.zeros(len(ids), bool)
            rank = np.where(hit, rank_of[at] if len(have) else 0, 0)
            order = np.lexsort((rank, owner))
            order = order[hit[order]]
            of, seen = owner[order], np.cumsum(counts[order])
            base = np.append(0, seen)[np.searchsorted(of, np.arange(docs))]
            enough = seen - base[of] >= need[of]
            first_of, where = np.unique(of[enough], return_index=True)
            point = np.full(docs, np.nan)
            point[first_of] = np.log(rank[order[enough][where]])
            open_ = np.isnan(point)
            rest = open_[owner] & ~hit
            ends = pa.array(_lists(owner[rest], docs))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[rest])) for x in (ids, counts)]
            lack = need - np.bincount(owner, counts * hit, docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "words")), pa.array(point, mask=open_), *(batch.column(c) for c in ("sentence", "letters")), pa.array(lack), *lists], ["doc_id", "words", "vocabulary", "sentence", "letters", "lack", "ids", "counts"])

    kind = parse.schema["doc_id"].dataType.simpleString()
    got = cut(parse.where("not summary").drop("summary").mapInArrow(rows, f"doc_id {kind}, words int, vocabulary double, sentence double, letters double, lack bigint, ids array<bigint>, counts array<int>"))
    done = ["doc_id", "words", "vocabulary", "sentence", "letters"]
    rest = got.where("vocabulary is null").select("doc_id", "words", "sentence", "letters", "lack", F.explode(F.arrays_zip("ids", "counts")).alias("w"))
    ranked = rest.select("doc_id", "words", "sentence", "letters", "lack", F.col("w.ids").alias("id"), F.col("w.counts").alias("n")).join(ranks, "id")
    so_far = Window.partitionBy("doc_id").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    reached = ranked.withColumn("seen", F.sum("n").over(so_far)).where("seen >= lack").groupBy("doc_id", "words", "sentence", "letters").agg(F.log(F.min("rank").cast("double")).alias("vocabulary"))
    return got.where("vocabulary is not null").select(*done).unionByName(reached.select(*done))


MEASURES = ("vocabulary", "sentence", "letters")


def calibration(measured: DataFrame, rated: DataFrame) -> DataFrame:
    """(band, and per measure its median and scale): one row per band that has a rated document."""
    known = cut(measured.join(F.broadcast(rated), "doc_id"))
    medians = known.groupBy("band").agg(*(F.median(m).alias(m) for m in MEASURES))
    off = known.join(F.broadcast(medians.select("band", *(F.col(m).alias(f"mid_{m}") for m in MEASURES))), "band")
    scales = off.agg(*(F.greatest(F.median(F.abs(F.col(m) - F.col(f"mid_{m}"))), F.lit(0.02)).alias(f"scale_{m}") for m in MEASURES))
    return medians.join(F.broadcast(scales))


def reading_bands(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, band) of every mainly English document with at least LEAST_WORDS words.

    Null ids and texts take no part. Without any rated document the band is null. Equally near
    bands: the lower one. The SENT first ranks and the bands' medians are the only things that
    travel, and neither grows with the corpus."""
    parse = parsed(documents).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        measured = cut(measures(parse, cut(word_ranks(parse))))
    finally:
        parse.unpersist()
    rated = labels.where("doc_id is not null and band is not null").select("doc_id", F.col("band").cast("int").alias("band")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "band").limit(RATED)
    bands = [r.asDict() for r in calibration(measured, rated).collect()]
    far = lambda b: sum((F.pow((F.col(m) - F.lit(b[m])) / F.lit(b[f"scale_{m}"]), 2) for m in MEASURES), F.lit(0.0))
    nearest = F.array_min(F.array(*(F.struct(far(b).alias("far"), F.lit(b["band"]).alias("band")) for b in bands)))["band"] if bands else F.lit(None).cast("int")
    return measured.select("doc_id", nearest.alias("band"))
