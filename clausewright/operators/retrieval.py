"""Retrieval: validity filters, BM25 over postings, exact vector search, rank fusion, rerank.

Every arm is a table (query_id, id, score, rank). Ranks break ties by id on the score rounded to
nine places, so the order of summation cannot change them. Filters come before ranking, corpus
statistics are those of the unfiltered corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import search_tokens as tokens
from ..session import cut

K1, B, RRF_K = 1.5, 0.75, 60


def in_force(start: Column, end: Column, as_of: Column) -> Column:
    """Both ends inclusive; an open end is always met."""
    return (start.isNull() | (start <= as_of)) & (end.isNull() | (end >= as_of))


def candidates(chunks: DataFrame, insurer: str = "", product: str = "", documents: tuple[str, ...] = (), as_of: str | None = None, tables_only: bool = False) -> DataFrame:
    """The chunks that pass all active filters; an empty value is an inactive filter."""
    if insurer:
        chunks = chunks.where(F.col("meta.insurer") == insurer)
    if product:
        chunks = chunks.where(F.col("meta.product") == product)
    if documents:
        chunks = chunks.where(F.col("span.document_id").isin(*documents))
    if as_of:
        chunks = chunks.where(in_force(F.col("meta.effective_from"), F.col("meta.effective_to"), F.lit(as_of).cast("date")))
    if tables_only:
        chunks = chunks.where(F.coalesce("meta.is_table", F.lit(False)) | F.col("kind").startswith("table"))
    return chunks


def doc_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, dl, tk): length and tokens of every document; a document without tokens has length 0."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("tk")).dropDuplicates(["id"]).select("id", F.size("tk").alias("dl"), "tk")


def postings(terms: DataFrame) -> DataFrame:
    """(term, id, dl, tf)."""
    return terms.select("id", "dl", F.explode("tk").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: n documents, those without tokens too, and their mean length."""
    return terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(posts: DataFrame, stats: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, allow: DataFrame | None = None) -> DataFrame:
    """Top k per query by the sum over its distinct terms. queries: query_id, text. `allow` (id)
    restricts what is ranked, never the statistics. A blank query has no rows. For few queries of
    rare words: a frequent word gives a row per query and document; bm25_blocks has no such rows.

    Only postings of query terms are joined; the queries' terms are joined by term, so no pair of
    query and document without a common term is formed."""
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    used = posts.join(asked.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    if allow is not None:
        used = used.join(allow, "id", "left_semi")
    one = F.broadcast(stats)  # one row
    norm = k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl"))
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    weighed = used.join(df, "term").join(one).where("avgdl > 0").select("term", "id", weight.alias("w"))
    return top(weighed.join(asked, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score")), k)


class Best:
    """The k best items of every query of a block, kept while batches of items go by. What scores
    below a query's k-th best so far is dropped, which cannot change the result."""

    def __init__(self, names: list, score: Callable[[pa.RecordBatch], np.ndarray], k: int) -> None:
        """score: of a batch of items, one row per query, one column per item."""
        self.names, self.score, self.k = names, score, k
        self.least, self.held = np.full(len(names), -np.inf), None

    def add(self, items: pa.RecordBatch) -> None:
        ids, score = items.column("id").to_pandas().to_numpy(), self.score(items)
        rounded = np.round(score, 9)
        if len(ids) > self.k:
            self.least = np.maximum(self.least, np.partition(rounded, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, j = np.nonzero(rounded >= self.least[:, None])
        if not len(q):
            return
        new = pd.DataFrame({"q": q, "id": ids[j], "score": score[q, j], "r": -rounded[q, j]})
        held = (new if self.held is None else pd.concat([self.held, new])).sort_values(["q", "r", "id"])
        rank = held.groupby("q").cumcount()
        kth = held[rank == self.k - 1]
        self.least[kth["q"]] = np.maximum(self.least[kth["q"]], -kth["r"])
        self.held = held[rank < self.k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": [self.names[x] for x in self.held["q"]], "id": self.held["id"].to_numpy(), "score": self.held["score"].to_numpy()}), preserve_index=False)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Asked(NamedTuple):
    """A block of queries, each a run of words (at least one), so that neighbours begin with the same words."""

    names: list
    words: list[str]  # the most frequent first
    weight: np.ndarray  # idf of the words
    starts: np.ndarray
    counts: np.ndarray
    flat: np.ndarray  # words of the queries


def asked_block(names: list, words: list[str], weight: np.ndarray, q: np.ndarray, t: np.ndarray, heavy: int) -> Asked:
    """q, t: query and word of every pair. Within a query the words that most queries have come first, those beyond the `heavy` ones last."""
    often = np.bincount(t, minlength=len(words))
    place = np.empty(len(words), np.int64)
    place[np.lexsort((-often, np.arange(len(words)) >= heavy))] = np.arange(len(words))
    order = np.lexsort((place[t], q))
    counts = np.bincount(q, minlength=len(names))
    starts = np.cumsum(counts) - counts
    runs, t = place[t[order]].tolist(), t[order]
    order = np.array(sorted(range(len(names)), key=[runs[i : i + n] for i, n in zip(starts.tolist(), counts.tolist())].__getitem__))
    flat = t[_runs(starts[order], counts[order])]
    counts = counts[order]
    return Asked([names[i] for i in order.tolist()], words, weight, np.cumsum(counts) - counts, counts, flat)


PAIRS = 1 << 21  # words of queries whose exact scores are summed at a time
MOST = 16  # new items of a query that are ranked at a time


class Postings:
    """The k best documents by BM25 of every query of a block, kept while batches of documents go by in the order of their ids.

    A score's upper bound is summed in whole steps, of which a query's greatest possible score has
    about as many as 16 bits hold, document by document in one piece per word; what queries have in
    common at their beginning is summed once. Only where the bound reaches a query's k-th best so far
    is the score itself worked out. Later ids lose ties, so equal scores need no look at them."""

    def __init__(self, asked: Asked, k: int, k1: float, b: float, avgdl: float, heavy: int) -> None:
        self.asked, self.k, self.k1, self.b, self.avgdl, self.dense = asked, k, k1, b, avgdl, min(heavy, len(asked.words))
        self.vocabulary = pa.array(asked.words, pa.string())
        longest = int(asked.counts.max())
        self.kind = np.uint16 if longest < 1 << 14 else np.uint32
        self.step = max(float(np.add.reduceat(asked.weight[asked.flat], asked.starts).max()) * (k1 + 1) / (np.iinfo(self.kind).max - longest - 1), 1e-300)
        runs, counts = np.split(asked.flat, asked.starts[1:]), asked.counts
        # how many words a query has in common with the one before it, from the first on
        self.common = [0]
        for x, y in zip(runs[:-1], runs[1:]):
            n = min(len(x), len(y))
            differs = np.flatnonzero(x[:n] != y[:n])
            self.common.append(int(differs[0]) if len(differs) else n)
        self.score, self.rounded, self.doc = np.zeros((len(counts), k)), np.full((len(counts), k), -np.inf), np.full((len(counts), k), -1)
        self.ids: list[pa.Array] = []
        self.seen = 0

    def add(self, docs: pa.RecordBatch) -> None:
        a, size, dense = self.asked, docs.num_rows, self.dense
        dl = docs.column("dl").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(docs.column("said"), " ")
        word = pc.fill_null(pc.index_in(split.flatten(), value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        key = (np.repeat(np.arange(size), np.diff(split.offsets.to_numpy())) + size * word)[word >= 0]
        norm = self.k1 * ((1 - self.b) + self.b * dl / self.avgdl)

        def weighed(key: np.ndarray, tf: np.ndarray) -> np.ndarray:
            x, d = np.divmod(key, size)
            return a.weight[x] * tf * (self.k1 + 1) / (tf + norm[d])

        tf = np.bincount(key[key < dense * size], minlength=dense * size)
        at = np.flatnonzero(tf)
        exact, bound = np.zeros(dense * size), np.zeros(dense * size, self.kind)
        exact[at] = weighed(at, tf[at])
        del tf
        bound[at] = np.ceil(exact[at] / self.step)
        light, tf = np.unique(key[key >= dense * size], return_counts=True)
        light_exact = weighed(light, tf)
        light_bound = np.ceil(light_exact / self.step).astype(self.kind)
        y, first = np.unique(light // size, return_index=True)
        posts = {w: (light[i:j] % size, light_bound[i:j]) for w, i, j in zip(y.tolist(), first.tolist(), [*first[1:].tolist(), len(light)])}

        def scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
            n = a.counts[q]
            t = a.flat[_runs(a.starts[q], n)]
            cell = t.astype(np.int64) * size + np.repeat(d, n)
            frequent = t < dense
            w = np.zeros(len(t))
            w[frequent] = exact[cell[frequent]]
            if len(light) and not frequent.all():
                rest = cell[~frequent]
                i = np.minimum(np.searchsorted(light, rest), len(light) - 1)
                w[~frequent] = np.where(light[i] == rest, light_exact[i], 0)
            return np.add.reduceat(w, np.cumsum(n) - n)

        rows = list(bound.reshape(dense, size))
        sums = list(np.zeros((max(self.common) + 1, size), self.kind))
        scratch, mask = np.empty(size, self.kind), np.empty(size, bool)
        flat, starts, counts, common = a.flat.tolist(), a.starts.tolist(), a.counts.tolist(), [*self.common, 0]
        # a rounded score above the k-th is at least this many steps
        least = np.maximum(np.ceil((self.rounded[:, -1] - 1e-8) / self.step - 1e-6), 1).tolist()
        at_q: list[int] = []
        at_d: list[np.ndarray] = []
        pending = 0
        for i, floor in enumerate(least):
            keep, after, start = common[i], common[i + 1], starts[i]
            now = sums[keep]
            for j in range(keep, counts[i]):
                t = flat[start + j]
                to = sums[j + 1] if j < after else scratch
                if t < dense:
                    np.add(now, rows[t], out=to)
                else:
                    if to is not now:
                        to[:] = now
                    if t in posts:
                        d, w = posts[t]
                        to[d] += w
                now = to
            np.greater_equal(now, floor, out=mask)
            d = mask.nonzero()[0]
            if not len(d):
                continue
            if floor == 1 and len(d) > self.k:  # every step taken can be too high by less than one
                reached = now[d].astype(np.int64)
                d = d[reached >= np.partition(reached, len(d) - self.k)[len(d) - self.k] - counts[i]]
            at_q.append(i)
            at_d.append(d)
            pending += len(d) * counts[i]
            if pending >= PAIRS:
                self._keep(at_q, at_d, scores)
                at_q, at_d, pending = [], [], 0
        if at_q:
            self._keep(at_q, at_d, scores)
        self.ids.append(docs.column("id"))
        self.seen += size

    def _keep(self, at_q: list[int], at_d: list[np.ndarray], scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Rank the documents at_d (ascending) of each query of at_q (ascending) among those kept."""
        q, d = np.repeat(np.array(at_q), [len(d) for d in at_d]), np.concatenate(at_d)
        score = scores(q, d)
        rounded = np.round(score, 9)
        k = self.k
        better = np.flatnonzero((rounded > self.rounded[q, -1]) & (score > 0))
        q, d, score, rounded = q[better], d[better] + self.seen, score[better], rounded[better]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        while len(q):
            now = place < MOST
            some, row = np.unique(q[now], return_inverse=True)
            col = place[now] + k
            wide = [np.concatenate([old[some], np.full((len(some), MOST), none, old.dtype)], axis=1) for old, none in ((self.rounded, -np.inf), (self.score, 0), (self.doc, -1))]
            for x, new in zip(wide, (rounded, score, d)):
                x[row, col] = new[now]
            order = np.argsort(-wide[0], axis=1, kind="stable")[:, :k]
            self.rounded[some], self.score[some], self.doc[some] = (np.take_along_axis(x, order, axis=1) for x in wide)
            q, d, score, rounded, place = q[~now], d[~now], score[~now], rounded[~now], place[~now] - MOST

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ids = pa.concat_arrays(self.ids)
        names = pa.array(self.asked.names)
        for i in range(0, len(self.doc), 4096):
            q, j = np.nonzero(self.doc[i : i + 4096] >= 0)
            if len(q):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q + i)), ids.take(pa.array(self.doc[q + i, j])), pa.array(self.score[q + i, j])], ["query_id", "id", "score"])


Ranker = Callable[[bytes], "Best | Postings"]
BLOCK = 2048  # queries of a block, about
SENT = 64 << 20  # bytes of query blocks that travel to every task at once
GROUP = 20_000  # items of a group where the blocks do not travel
FIRST = 1024  # items of a task's first batch; the next ones are four times as large each, up to the width


def batched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of FIRST rows, then more, `width` at most."""
    held, n, want = [], 0, min(FIRST, width)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, want - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == want:
                yield pa.concat_batches(held)
                held, n, want = [], 0, min(4 * want, width)
    if held:
        yield pa.concat_batches(held)


def in_blocks(items: DataFrame, blocks: DataFrame, ranker: Ranker, qkind: str, k: int, width: int = 2000, sent: int = SENT) -> DataFrame:
    """The k best items per query, of a stated query set against all items, block by block.

    items has an id, by which every partition is in order for Postings; blocks has payload, one row per block of
    queries. `ranker` opens a payload: add() takes a batch of items, rows() gives the best of all.
    Blocks of `sent` bytes in all are broadcast, and items are scored where they are read. Larger
    query sets are dealt to groups of blocks of that size; groups of items meet groups of blocks by
    an equal key, so a task never holds more than one of each."""
    spark = items.sparkSession
    schema = f"query_id {qkind}, id {items.schema['id'].dataType.simpleString()}, score double"

    def best(batches: Iterator[pa.RecordBatch], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        kept = [ranker(p) for p in payloads]
        for part in batched(batches, width):
            for b in kept:
                b.add(part)
        for b in kept:
            yield from b.rows()

    size = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return top(spark.createDataFrame([], schema), k)
    if size["bytes"] <= sent:
        few = spark.sparkContext.broadcast([bytes(r["payload"]) for r in blocks.collect()])  # at most `sent` bytes
        return top(items.mapInArrow(lambda batches: best(batches, few.value), schema), k)
    groups, parts = -(-size["bytes"] // sent), max(1, -(-items.count() // GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("grp", every(groups))
    right = blocks.select("payload", F.pmod(F.xxhash64("payload"), F.lit(groups)).cast("int").alias("grp")).withColumn("part", every(parts))

    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        got = list(best(iter(mine.sort_by("id").to_batches()), theirs.column("payload").to_pylist()))
        return pa.Table.from_batches(got) if got else empty.to_table()

    empty = _Empty(qkind, items.schema["id"].dataType.simpleString())
    return top(left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(met, schema), k)


class _Empty:
    """An Arrow table without rows, of a ranking's columns."""

    KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def __init__(self, qkind: str, kind: str) -> None:
        self.types = [self.KINDS.get(qkind, pa.string()), self.KINDS.get(kind, pa.string()), pa.float64()]

    def to_table(self) -> pa.Table:
        return pa.Table.from_arrays([pa.array([], t) for t in self.types], ["query_id", "id", "score"])


def _payloads(rows: DataFrame, pack: Callable[[pd.DataFrame], bytes], block: int = BLOCK) -> DataFrame:
    """(payload): the rows of the queries of a block, packed; rows has query_id."""
    n = rows.select("query_id").distinct().count()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))))
    return cut(dealt.groupBy("block").applyInPandas(lambda pdf: pd.DataFrame({"payload": [pack(pdf)]}), "payload binary"))


WIDE = 65_536  # queries of a block of bm25_blocks


def bm25_blocks(terms: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, heavy: int = 512, width: int = 16_384, allow: DataFrame | None = None, block: int = WIDE, sent: int = SENT) -> DataFrame:
    """The ranking of bm25 without a row per pair of query and document that share a word.

    Documents are tokenised once, into a column kept for two passes: document frequencies, and
    scores. Queries of the same words are one. `width` documents at a time meet a block of queries
    (see Postings); the `heavy` most frequent words of a block have a place for every document there.
    `allow` (id) restricts what is ranked, never the statistics."""
    each = queries.where("query_id is not null").select("query_id", tokens(F.col("text")).alias("tk")).groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tk")))).alias("words"))
    asked = cut(each.where(F.size("words") > 0))
    first = cut(asked.groupBy("words").agg(F.min("query_id").alias("query_id")))  # stands for all queries of these words
    qkind, ikind = queries.schema["query_id"].dataType.simpleString(), terms.schema["id"].dataType.simpleString()
    said = terms.select("id", "dl", F.array_join("tk", " ").alias("said")).persist(StorageLevel.MEMORY_AND_DISK)
    # One pass for df and the corpus: the empty word, which no text has, stands once in every document.
    counted = cut(said.select("dl", F.explode(F.array_append(F.filter(F.array_distinct(F.split("said", " ")), lambda w: w != ""), F.lit(""))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length")))
    corpus = counted.where("term = ''").first()
    if corpus is None or not corpus["length"]:
        return top(terms.sparkSession.createDataFrame([], f"query_id {qkind}, id {ikind}, score double"), k)
    n, avgdl = corpus["df"], corpus["length"] / corpus["df"]

    def pack(pdf: pd.DataFrame) -> bytes:
        words = pdf[["term", "df"]].drop_duplicates().sort_values(["df", "term"], ascending=[False, True])
        q, names = pd.factorize(pdf["query_id"])
        t = pdf["term"].map({x: j for j, x in enumerate(words["term"])}).to_numpy(np.int32)
        df = words["df"].to_numpy(float)
        return pickle.dumps(asked_block(names.tolist(), words["term"].tolist(), np.log(1 + (n - df + 0.5) / (df + 0.5)), q, t, heavy))

    ranked = said if allow is None else said.join(allow.select("id").distinct(), "id", "left_semi")
    cores = terms.sparkSession.sparkContext.defaultParallelism
    ranked = ranked.repartition(max(1, min(-(-n // 2048), max(2 * cores, -(-n // 200_000)))), "id").sortWithinPartitions("id")  # every task searches all queries, whatever its bytes
    rows = first.select("query_id", F.explode("words").alias("term")).join(counted.select("term", "df"), "term")
    found = cut(in_blocks(ranked, _payloads(rows, pack, block), lambda p: Postings(pickle.loads(p), k, k1, b, avgdl, heavy), qkind, k, width, sent))
    said.unpersist()
    return asked.join(first.withColumnRenamed("query_id", "first"), "words").select("query_id", "first").join(found.withColumnRenamed("query_id", "first"), "first").select("query_id", "id", "score", "rank")


def dense(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """Exact top k by dot product, in double precision. queries: query_id, q (array). Null ids and
    vectors take no part; vectors of different lengths are an error. Blocks of the stated query set
    are multiplied with every batch of vectors, and only a task's best k per query are shuffled."""
    asked = queries.where("q is not null and query_id is not null").select("query_id", "q")

    def pack(pdf: pd.DataFrame) -> bytes:
        return pickle.dumps((pdf["query_id"].tolist(), np.array(pdf["q"].tolist(), np.float64)))

    def ranker(payload: bytes) -> Best:
        names, q = pickle.loads(payload)
        return Best(names, lambda rows: q @ rows.column("v").flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1).T, k)

    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    return in_blocks(rows, _payloads(asked, pack, block), ranker, queries.schema["query_id"].dataType.simpleString(), k, sent=sent)


def fuse(arms: list[tuple[DataFrame, float]], k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked arms with weights; an item in one arm only still counts."""
    if not arms or rrf_k <= 0:
        raise ValueError("fusion needs an arm and a positive constant")
    parts = [arm.select("query_id", "id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part"), *(F.when(F.lit(i == j), F.col("score")).alias(f"score_{j}") for j in range(len(arms)))) for i, (arm, w) in enumerate(arms)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("query_id", "id").agg(F.sum("part").alias("score"), *(F.max(f"score_{j}").alias(f"score_{j}") for j in range(len(arms)))), k)


def rerank(ranked: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """Wide candidates (query_id, id) rescored by the share of distinct query words in the document, cut to k.
    Stands where a cross-encoder would be plugged in."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("qt"))
    said = docs.select("id", F.array_distinct("tk").alias("dt"))
    pairs = ranked.select("query_id", "id").join(asked, "query_id").join(said, "id")
    return top(pairs.select("query_id", "id", (F.size(F.array_intersect("qt", "dt")) / F.greatest(F.size("qt"), F.lit(1))).alias("score")), k)


def confidence(rerank_score: Column, fused: Column, dense_score: Column) -> Column:
    return F.coalesce(rerank_score, fused, dense_score, F.lit(0.0))
