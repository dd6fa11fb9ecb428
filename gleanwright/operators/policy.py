"""The evidence policy: narrowing, re-ranking, filtering with one reason for each refusal, status, and the gate before a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filter_label, tokens
from ..session import by_size
from .hybrid import check_preference

#: Evidence types over all entry points, and what marks an answer as refused.
EVIDENCE_TYPES = ("diagnosis", "treatment", "symptoms", "epidemiology", "host_range", "impact", "conditions", "prevention", "general")
REFUSALS = (
    "I cannot disclose",
    "I cannot comply",
    "I cannot process",
    "I cannot provide",
    "Please keep the conversation respectful",
    "I will not engage",
    "I am an agricultural assistant",
    "I'm sorry, I can't respond to that",
)
NOTHING_LEFT = "No evidence satisfied context, recommendation policy, and relevance requirements."
CONFLICT = "Conflicting evidence detected; generation must abstain until conflict is resolved."


def check_request(preference: str, evidence_type: str | None) -> None:
    check_preference(preference)
    if evidence_type is not None and evidence_type not in EVIDENCE_TYPES:
        raise ValueError(f"unknown evidence type {evidence_type!r}; known: {', '.join(EVIDENCE_TYPES)}")


def demand_queries(queries: DataFrame, query: str = "query", k: int = 1) -> None:
    """What the agent and the re-ranker ask for: no blank query, and at least one row wanted. Retrievers give no rows for a blank query instead."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    if not queries.filter(F.col(query).isNull() | ~F.col(query).rlike(r"\S")).isEmpty():
        raise ValueError("query must not be empty")


def overlap_score(query: Column | str, content: Column | str) -> Column:
    """The share of a query's distinct tokens that the content has: the stand-in for a cross-encoder."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, tokens(content))) / F.size(q), 6))


def narrowed(candidates: DataFrame, match: Column, group: str = "query_id") -> DataFrame:
    """Of each group only the matching rows, if it has any, else all."""
    c = candidates.withColumn("_match", F.coalesce(match, F.lit(False)))
    some = c.groupBy(group).agg(F.bool_or("_match").alias("_any"))
    return c.join(some, group).filter(F.col("_match") | ~F.col("_any")).drop("_match", "_any")


def reranked(candidates: DataFrame, score: str, k: int, group: str = "query_id", tie: str = "knowledge_id") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return candidates.withColumn("rerank", F.row_number().over(order)).filter(F.col("rerank") <= k)


def refusal(crop: str | None, disease: str | None, evidence_type: str | None, preference: str, threshold: float | None, score: str = "reranker_score") -> Column:
    """Why a row may not serve its request, by the first test that fails: context, policy, relevance. Null: accepted.
    crop, disease, evidence_type and preference name columns of the request, or are None where it asks for nothing."""
    out = F.when(F.lit(False), F.lit(""))
    for name, want, label in (("crop", crop, "Context mismatch: crop="), ("disease", disease, "Context mismatch: disease="), ("evidence_type", evidence_type, "Evidence type mismatch: ")):
        if want:
            have = filter_label(name)
            out = out.when(have != filter_label(want), F.concat(F.lit(f"{label}'"), have, F.lit("', expected='"), F.col(want), F.lit("'.")))
    asked = F.col(preference)
    other = asked.isin("Organic", "IPM") & (filter_label("recommendation_preference") != filter_label(asked))
    out = out.when(other, F.concat(F.lit("Policy mismatch: evidence preference '"), F.col("recommendation_preference"), F.lit("' cannot satisfy requested '"), asked, F.lit("'.")))
    for name, flag in (("Organic", "organic_eligible"), ("IPM", "ipm_eligible")):
        out = out.when((asked == name) & ~F.col(flag).eqNullSafe(True), F.lit(f"Policy violation: evidence is not {name} eligible."))
    s = F.col(score)
    out = out.when(s.isNull() | F.isnan(s), "Missing or invalid reranker relevance score.")
    if threshold is not None:
        out = out.when(s < threshold, F.format_string(f"Weak relevance: score %.6f is below configured threshold {threshold:.6f}.", s))
    return out


def status(judged: DataFrame, group: str = "query_id", reason: str = "reason", conflict: str = "conflict") -> DataFrame:
    """(group, status, n_accepted, n_rejected): INSUFFICIENT without accepted rows, CONFLICTING with a conflict among them, else SUFFICIENT."""
    ok = F.col(reason).isNull()
    out = judged.groupBy(group).agg(F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"), F.bool_or(ok & F.coalesce(conflict, F.lit(False))).alias("_c"))
    return out.withColumn("status", F.when(F.col("n_accepted") == 0, "INSUFFICIENT").when(F.col("_c"), "CONFLICTING").otherwise("SUFFICIENT")).drop("_c")


def may_generate(status_col: str = "status", accepted: str = "n_accepted") -> Column:
    return (F.col(status_col) == "SUFFICIENT") & (F.col(accepted) > 0)


def blocked(answer: Column | str) -> Column:
    a = F.col(answer) if isinstance(answer, str) else answer
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | a.contains(phrase)
    return F.coalesce(out, F.lit(False))


def evidence_block(index: Column, fields: list[tuple[str, Column]], content: Column) -> Column:
    lines = [F.concat(F.lit("[EVIDENCE "), index, F.lit("]")), *(F.concat(F.lit(f"{n}: "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields), F.lit("content:"), F.coalesce(content, F.lit("")), F.concat(F.lit("[/EVIDENCE "), index, F.lit("]"))]
    return F.concat_ws("\n", *lines)


def development_flags(source: Column | str, sample: str) -> dict[str, Column]:
    """Whether a record may count as authority, and whether it is there for development only."""
    c = F.col(source) if isinstance(source, str) else source
    return {"authoritative": ~c.eqNullSafe(sample), "development_only": c.eqNullSafe(sample)}


def compose_query(crop: Column | str, disease: Column | str, question: Column | str) -> Column:
    """The retrieval query of a diagnosed case: crop, condition in words, question; what is missing is left out."""
    parts = [F.col(x) if isinstance(x, str) else x for x in (crop, disease, question)]
    parts[1] = F.replace(parts[1], F.lit("_"), F.lit(" "))
    return F.concat_ws(" ", *(F.nullif(F.btrim(p), F.lit("")) for p in parts))


def nearest_intent(texts: DataFrame, examples: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """(key, intent, score): the intent of the example utterance whose tokens a text covers best, if it covers `least` of them."""
    e = by_size(examples.select("intent", "utterance"), 10_000)
    scored = texts.select(key, text).join(e).withColumn("score", overlap_score("utterance", text)).filter(F.col("score") >= least)
    order = Window.partitionBy(key).orderBy(F.desc("score"), "intent", "utterance")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(key, "intent", "score")
