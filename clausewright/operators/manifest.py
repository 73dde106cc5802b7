"""Manifest of sources: row and graph rules, supersession, span resolution, page coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .evaluation import violations


def source_rules(sources: DataFrame) -> DataFrame:
    """(id, rule) of broken row rules."""
    return violations(sources, "id", [
        ("rank_range", ~F.col("authority_rank").between(1, 3)), ("self_supersession", (F.col("superseded_by") == F.col("id")) | F.array_contains("supersedes", F.col("id"))), ("brochure", F.col("kind") == "brochure"), ("fixture_rank", (F.col("kind") == "adversarial_fixture") & (F.col("authority_rank") != 3)),
        ("superseded_without_end", F.col("superseded_by").isNotNull() & F.col("effective_to").isNull()), ("period_reversed", F.col("effective_from") > F.col("effective_to")),
    ])


def graph_rules(sources: DataFrame) -> DataFrame:
    """(id, rule): ids that stand twice, and edges to sources that do not exist."""
    twice = sources.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("rule"))
    edges = sources.select("id", F.lit("superseded_by_unknown").alias("rule"), F.col("superseded_by").alias("to")).unionByName(sources.select("id", F.lit("supersedes_unknown").alias("rule"), F.explode("supersedes").alias("to"))).unionByName(sources.select("id", F.lit("parent_unknown").alias("rule"), F.col("parent_document_id").alias("to")))
    known = sources.select(F.col("id").alias("to")).distinct()
    return twice.unionByName(edges.where("to is not null").join(known, "to", "left_anti").select("id", "rule")).distinct()


def superseded_ids(sources: DataFrame) -> DataFrame:
    return sources.where("superseded_by is not null").select("id").unionByName(sources.select(F.explode("supersedes").alias("id"))).where("id is not null").distinct()


def uncovered_pages(chunks: DataFrame, census: DataFrame) -> DataFrame:
    """(source_id, page) of pages in the census (source_id, n_pages) that no chunk claims."""
    all_pages = census.where("n_pages >= 1").select("source_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return all_pages.join(chunks.select("source_id", F.explode("pages").alias("page")).distinct(), ["source_id", "page"], "left_anti")


def resolve_spans(spans: DataFrame, clauses: DataFrame, census: DataFrame) -> DataFrame:
    """(item_id, truth_idx, severity, rule): the first finding that ends the check of a span.
    clauses: document_id, clause_id, page."""
    pages = clauses.groupBy("document_id", "clause_id").agg(F.collect_set("page").alias("on"))
    known = census.select(F.col("source_id").alias("document_id"), "n_pages")
    both = spans.join(known, "document_id", "left").join(pages, ["document_id", "clause_id"], "left")
    case = (
        F.when(F.col("n_pages").isNull(), "ERROR:unknown_document").when(F.col("page") > F.col("n_pages"), "ERROR:page_beyond_end").when(F.col("clause_id").isNull(), "WARN:no_clause").when(F.col("on").isNull() & F.col("clause_id").rlike("^(excl|def)[.]"), "UNVERIFIABLE:clause_absent")
        .when(F.col("on").isNull(), "ERROR:clause_absent").when(F.col("page").isNotNull() & ~F.array_contains("on", F.col("page")), "ERROR:clause_elsewhere").when(F.size("on") > 3, "UNVERIFIABLE:ambiguous")
    )
    found = both.select("item_id", "truth_idx", case.alias("f")).where("f is not null")
    return found.select("item_id", "truth_idx", F.substring_index("f", ":", 1).alias("severity"), F.substring_index("f", ":", -1).alias("rule"))


def item_findings(spans: DataFrame, bans: DataFrame, clauses: DataFrame, concepts: DataFrame, census: DataFrame) -> DataFrame:
    """(item_id, truth_idx, severity, rule): everything that can be said of the spans and bans of the items.

    spans: item_id, truth_idx, document_id, page, clause_id, concept; bans: item_id, pattern; clauses:
    document_id, clause_id, page; concepts: document_id, concept, page. An unknown document ends the
    check of a span. A clause on more than three pages is confirmed by a concept that its page shows;
    nothing can confirm it without one. Findings on bans have no truth_idx."""
    pages = clauses.groupBy("document_id", "clause_id").agg(F.collect_set("page").alias("on"))
    shown = concepts.groupBy("document_id", "concept").agg(F.collect_set("page").alias("seen"))
    known = census.select(F.col("source_id").alias("document_id"), "n_pages")
    both = spans.join(known, "document_id", "left").join(pages, ["document_id", "clause_id"], "left").join(shown, ["document_id", "concept"], "left")
    here, asked = F.array_contains("seen", F.col("page")), F.col("concept").isNotNull() & F.col("page").isNotNull()
    confirmed = F.when(asked & F.col("seen").isNotNull(), here)  # null: no check was possible
    portable = F.col("clause_id").rlike("^(excl|def)[.]")
    wide = (F.size("on") > 3) & F.coalesce(confirmed, F.lit(True))
    about_clause = (
        F.when(F.col("clause_id").isNull(), "WARN:no_clause").when(F.col("on").isNull() & portable, "UNVERIFIABLE:clause_absent").when(F.col("on").isNull(), "ERROR:clause_absent")
        .when(F.col("page").isNotNull() & ~F.array_contains("on", F.col("page")), "ERROR:clause_elsewhere").when(wide & F.coalesce(confirmed, F.lit(False)), "WARN:ambiguous_confirmed").when(wide, "UNVERIFIABLE:ambiguous")
    )
    found = F.when(F.col("n_pages").isNull(), F.array(F.lit("ERROR:unknown_document"))).otherwise(F.array(
        F.when(F.col("page") > F.col("n_pages"), "ERROR:page_beyond_end"), F.when(asked & F.col("seen").isNull(), "WARN:concept_absent").when(asked & ~here, "ERROR:concept_elsewhere"), about_clause,
    ))
    of_spans = both.select("item_id", F.col("truth_idx").cast("bigint").alias("truth_idx"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    of_bans = bans.select("item_id", F.substring_index("pattern", "#", 1).alias("document_id")).join(known, "document_id", "left_anti").select("item_id", F.lit(None).cast("bigint").alias("truth_idx"), F.lit("ERROR:ban_unknown_document").alias("f"))
    return of_spans.unionByName(of_bans).select("item_id", "truth_idx", F.substring_index("f", ":", 1).alias("severity"), F.substring_index("f", ":", -1).alias("rule"))


def blocking(findings: DataFrame) -> DataFrame:
    """(item_id): items with an error, or with a label that nothing can check."""
    return findings.where(F.col("severity").isin("ERROR", "UNVERIFIABLE")).select("item_id").distinct()


def by_id(sources: DataFrame, source_id: str) -> Row:
    """The source of an id; an unknown id is an error."""
    found = sources.where(F.col("id") == source_id).limit(1).collect()
    if not found:
        raise KeyError(f"no source {source_id!r}")
    return found[0]


def production(sources: DataFrame) -> DataFrame:
    """All but fixtures, by their kind, so that a new fixture is kept out too."""
    return sources.where(F.coalesce("kind", F.lit("")) != "adversarial_fixture")


def adversarial(sources: DataFrame) -> DataFrame:
    return sources.where("kind = 'adversarial_fixture'")


MARK = b"%PDF"


def attempt_error(status: Column, failure: Column, content: Column) -> Column:
    """What went wrong with one attempt to fetch: timeout, network_error, http_error, empty, not_pdf, or null."""
    head = F.substring(content, 1, 1024)
    return (
        F.when(F.contains(F.lower(failure), F.lit("timeout")), "timeout").when(failure.isNotNull(), "network_error").when(status >= 400, "http_error").when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(F.position(F.lit(MARK), head) == 0, "not_pdf")
    )


def fetch_outcomes(attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, outcome, sha256, drift) of every source. attempts: id, ordinal, status, failure, content, the
    primary address first. The first attempt with a document counts, later ones only show drift; its hash
    must be the pinned one. Without a document the last attempt's error is the outcome, http_error if none was made."""
    judged = attempts.select("id", "ordinal", attempt_error(F.col("status"), F.col("failure"), F.col("content")).alias("error"), F.sha2("content", 256).alias("sha"))
    good = F.col("error").isNull()
    per = judged.groupBy("id").agg(F.min_by(F.when(good, F.col("sha")), F.when(good, F.col("ordinal"))).alias("sha256"), (F.countDistinct(F.when(good, F.col("sha"))) > 1).alias("drift"), F.max_by("error", "ordinal").alias("last"))
    both = sources.select("id", "expected_sha256").join(per, "id", "left")
    outcome = F.when(F.col("sha256").isNull(), F.coalesce("last", F.lit("http_error"))).when(F.col("expected_sha256").isNotNull() & (F.col("sha256") != F.col("expected_sha256")), "hash_mismatch").otherwise("ok")
    return both.select("id", outcome.alias("outcome"), "sha256", F.coalesce("drift", F.lit(False)).alias("drift"))
