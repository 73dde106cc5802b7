"""What is kept between runs: the inverted index, vectors with their contract, embeddings and replies by content key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import postings

VERSION = 1
# What embedding models want before a question, and before a passage; others want nothing.
QUERY_PREFIXES = {"BAAI/bge-base-en-v1.5": "Represent this sentence for searching relevant passages: ", "BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: ", "BAAI/bge-large-en-v1.5": "Represent this sentence for searching relevant passages: ", "intfloat/multilingual-e5-small": "query: ", "sentence-transformers/all-MiniLM-L6-v2": ""}
PASSAGE_PREFIXES = {"intfloat/multilingual-e5-small": "passage: "}


def save_index(terms: DataFrame, path: str) -> None:
    """Counts only: weights are computed from them on use. terms: id, dl, tk."""
    postings(terms).select("term", "id", "tf").repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    terms.select("id", "dl").write.mode("overwrite").parquet(f"{path}/documents")
    terms.sparkSession.createDataFrame([(VERSION,)], "version int").write.mode("overwrite").parquet(f"{path}/contract")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, dl). Another version is an error."""
    version = spark.read.parquet(f"{path}/contract").first()["version"]
    if version != VERSION:
        raise ValueError(f"index of version {version}, this engine reads {VERSION}")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents")


def save_vectors(vectors: DataFrame, path: str, model: str, prefix: str = "") -> None:
    """vectors: id, embedding. The contract holds the model, its query prefix and the dimension."""
    vectors.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.agg(F.max(F.size("embedding")).alias("dim")).select(F.lit(VERSION).alias("version"), F.lit(model).alias("model"), F.lit(prefix).alias("prefix"), "dim").write.mode("overwrite").parquet(f"{path}/contract")


def load_vectors(spark: SparkSession, path: str, model: str, prefix: str = "") -> DataFrame:
    """(id, embedding). A contract of another model, prefix or version is an error: its scores would mean nothing."""
    c = spark.read.parquet(f"{path}/contract").first()
    if (c["version"], c["model"], c["prefix"]) != (VERSION, model, prefix):
        raise ValueError(f"vectors of {c['model']!r} with prefix {c['prefix']!r}, asked for {model!r} with {prefix!r}")
    return spark.read.parquet(f"{path}/vectors")


def vector_problems(vectors: DataFrame, dim: int, ids: DataFrame | None = None) -> DataFrame:
    """(id, problem): null, of another dimension, not of unit length, twice there; with `ids`, ids without a vector."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    one = F.when(F.col("embedding").isNull(), "null").when(F.size("embedding") != dim, "dimension").when(F.abs(norm - 1) > 1e-3, "length")
    found = vectors.select("id", one.alias("problem")).where("problem is not null").unionByName(vectors.groupBy("id").count().where("count > 1").select("id", F.lit("twice").alias("problem")))
    return found if ids is None else found.unionByName(ids.select("id").distinct().join(vectors.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem")))


def uncovered(index: DataFrame, store: DataFrame) -> DataFrame:
    """(id): ids of an index that the store of texts does not hold; must be empty before a search is answered."""
    return index.select("id").distinct().join(store.select("id"), "id", "left_anti")


def content_key(text: Column, model: str, query_prefix: str = "", passage_prefix: str = "") -> Column:
    """The key of a text's embedding: all that decides the vector, with a null character between."""
    return F.sha2(F.concat_ws("\0", F.lit(model), F.lit(query_prefix), F.lit(passage_prefix), text), 256)


def cache_probe(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Hits (id, key, embedding) and misses (key, text): texts that are the same are embedded once.
    texts: id, text; cache: key, embedding. A null text is neither."""
    keyed = texts.where("text is not null").select("id", "text", content_key(F.col("text"), model).alias("key"))
    known = cache.dropDuplicates(["key"])
    return keyed.join(known, "key").select("id", "key", "embedding"), keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))


def request_key(kind: Column | str, payload: Column) -> Column:
    """The key of a request: its kind and its payload as JSON with the fields in the order of the struct."""
    return F.sha2(F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit("\0"), F.to_json(payload)), 256)


def replayed(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """The requests with the recorded response and whether there is one. Of several recordings of a key
    the first by its contents is played. requests: key; recorded: key, response."""
    known = recorded.where("key is not null").groupBy("key").agg(F.min("response").alias("response"), F.lit(True).alias("known"))
    return requests.join(known, "key", "left").withColumn("hit", F.coalesce("known", F.lit(False))).drop("known")
