"""Evaluation: span matching, ranking metrics, behaviour, agreement, percentiles, gates, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_clause


def covers(outer: Column, inner: Column) -> Column:
    """Dot-boundary prefix: 4.2 covers 4.2 and 4.2.b, not 4.21."""
    return F.coalesce((outer == inner) | inner.startswith(F.concat(outer, F.lit("."))), F.lit(False))


def span_match(clause: Column, page: Column, true_clause: Column, true_page: Column, mode: str = "clause_prefix", tolerance: int = 0) -> Column:
    """Of spans in the same document. Where a clause is missing, pages decide; a missing page never matches."""
    a, b = clean_clause(clause), clean_clause(true_clause)
    pages = F.coalesce(F.abs(page - true_page) <= tolerance, F.lit(False))
    if mode == "page":
        return pages
    both = F.coalesce(a == b, F.lit(False)) if mode == "exact" else covers(a, b) | covers(b, a)
    return F.when(a.isNull() | b.isNull(), pages).otherwise(both)


def matches(ranked: DataFrame, truths: DataFrame, mode: str = "clause_prefix") -> DataFrame:
    """(item_id, rank, truth_idx): ranked spans (item_id, rank, document_id, clause_id, page) that hit a truth."""
    t = truths.select("item_id", "document_id", "truth_idx", F.col("clause_id").alias("t_clause"), F.col("page").alias("t_page"))
    return ranked.join(t, ["item_id", "document_id"]).where(span_match(F.col("clause_id"), F.col("page"), F.col("t_clause"), F.col("t_page"), mode)).select("item_id", "rank", "truth_idx").distinct()


def ranking_scores(items: DataFrame, ranked: DataFrame, truths: DataFrame, k: int = 10, mode: str = "clause_prefix") -> DataFrame:
    """Per item: recall, precision and nDCG within k, hit rate within k, MRR over the whole list.

    An item without truths has null in all five; one without results has zeros. A truth is credited
    once, at the first rank that covers it, and a rank that covers several new truths gains once."""
    hit = matches(ranked, truths, mode)
    n_truths = truths.groupBy("item_id").agg(F.countDistinct("truth_idx").alias("n"))
    returned = ranked.where(F.col("rank") <= k).groupBy("item_id").agg(F.countDistinct("rank").alias("returned"))
    per_rank = hit.groupBy("item_id").agg(F.min("rank").alias("first"), F.countDistinct(F.when(F.col("rank") <= k, F.col("rank"))).alias("relevant"), F.countDistinct(F.when(F.col("rank") <= k, F.col("truth_idx"))).alias("found"))
    gains = hit.groupBy("item_id", "truth_idx").agg(F.min("rank").alias("rank")).select("item_id", "rank").distinct().where(F.col("rank") <= k).groupBy("item_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = items.select("item_id").distinct().join(n_truths, "item_id", "left").join(returned, "item_id", "left").join(per_rank, "item_id", "left").join(gains, "item_id", "left")
    defined = lambda c: F.when(F.col("n").isNotNull(), c)
    return joined.select(
        "item_id", defined(zero(F.col("found") / F.col("n"))).alias("recall"), defined(zero(F.col("relevant") / F.col("returned"))).alias("precision"), defined(zero(1 / F.col("first"))).alias("mrr"),
        defined(zero(F.col("dcg") / ideal)).alias("ndcg"), defined(zero((F.col("relevant") > 0).cast("double"))).alias("hit_rate"),
    )


def mean_and_skips(scores: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, n, skipped): every metric over the items where it is defined."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in names))).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("skipped"))


def cohens_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """(n, po, pe, kappa) of two raters; full chance agreement gives 0. Rows with a missing rating are left out."""
    r = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    share = lambda c, name: r.groupBy(F.col(c).alias("label")).agg(F.count("*").alias(name))
    pe = share(a, "x").join(share(b, "y"), "label", "full").agg(F.sum(F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0))).cast("double").alias("xy"))
    po = r.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    both = po.join(F.broadcast(pe)).select("n", "po", (F.col("xy") / (F.col("n") * F.col("n"))).alias("pe"))
    return both.withColumn("kappa", F.when(F.col("pe") >= 1, 0.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def kappa_band(kappa: Column) -> Column:
    return F.when(kappa >= 0.8, "strong").when(kappa >= 0.6, "substantial").otherwise("weak")


def half_even_percentile(values: Column, p: float) -> Column:
    """Of an array: the value at round-half-even(p/100 * n + 0.5), from 1, kept within the array."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n, F.rint(F.lit(p / 100.0) * n + 0.5).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(values), at))


def gate(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, actual, limit, passed): a null limit is skipped, a limit without a measurement fails."""
    both = limits.where("bound is not null").join(measured, "metric", "left")
    ok = F.when(F.col("actual").isNull(), False).when(F.col("lower_is_better"), F.col("actual") <= F.col("bound")).otherwise(F.col("actual") >= F.col("bound"))
    return both.select("metric", "actual", "bound", ok.alias("passed"))


ADVERSARIAL = ("unanswerable", "contradictory", "supersession", "injection")


def stratified_sample(items: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """n items in turn over the strata, those of adversarial strata first, in seeded order within a stratum."""
    one = items.select("id", F.explode("strata").alias("stratum")) if dict(items.dtypes)["strata"].startswith("array") else items.select("id", F.col("strata").alias("stratum"))
    one = one.where("id is not null and stratum is not null").groupBy("id").agg(F.min("stratum").alias("stratum"))
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "id")), "id"))
    first = F.when(F.col("stratum").isin(*ADVERSARIAL), 0).otherwise(1)
    return one.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", first, "stratum").limit(n).select("id", "stratum", F.col("turn").cast("bigint").alias("turn"))


def violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, rule): one row per broken rule; a rule that is null holds."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules)), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))
