"""How far answers rest on the texts that were retrieved for them.

A sentence's tokens count as covered where they lie in a run of at least RUN tokens that a context has too (of all its tokens, if the
sentence is shorter). A sentence is supported if at least half of it is covered. Context recall is the share of sentences that the
contexts together support; context precision is the mean, over contexts that support a sentence, of the share of such contexts
among those up to its rank. Entities are runs of capitalised words, and numbers; entity recall is the share of the answer's that a context names.

Runs are found by joining token runs of answers and contexts, each context's once, so no text is compared with another as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import by_size, written

RUN = 4
SENTENCE_END = r"[.!?]+\s+|\n+"
ENTITY = r"[A-Z][a-z]+(?: [A-Z][a-z]+)*|[0-9]+(?:[.,][0-9]+)*"


def runs(tk: Column, n: Column | int) -> Column:
    """(at, run) of each run of n tokens; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.size(tk) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(tk, i + 1, n), " ").alias("run")))).otherwise(F.array())


def entities(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)))


def support(answers: DataFrame, pairs: DataFrame, contexts: DataFrame, answer: str = "answer_id", context: str = "context_id", run: int = RUN) -> DataFrame:
    """(answer, n_sentences, n_supported, context_recall, context_precision) of each answer with words.

    answers: (answer, text). pairs: (answer, context, rank) from 1. contexts: (context, text), each once."""
    s = answers.select(F.col(answer).alias("a"), F.posexplode(F.split("text", SENTENCE_END)).alias("s", "sentence")).withColumn("tk", tokens("sentence")).filter(F.size("tk") > 0)
    sized = s.select("a", "s", F.size("tk").alias("size"), F.least(F.size("tk"), F.lit(run)).alias("n"), "tk")
    sized = written(sized.select("a", "s", "size", "n", F.explode(runs(F.col("tk"), F.col("n"))).alias("r")).select("a", "s", "size", "n", "r.at", "r.run"))
    named = contexts.join(by_size(pairs.select(context).distinct()), context, "left_semi").select(F.col(context).alias("c"), tokens("text").alias("tk"))
    held = named.select("c", F.explode(F.array_distinct(F.flatten(F.array(*(F.transform(runs(F.col("tk"), k), lambda x: x["run"]) for k in range(1, run + 1)))))).alias("run"))
    held = held.join(by_size(sized.select("run").distinct()), "run", "left_semi")
    p = pairs.select(F.col(answer).alias("a"), F.col(context).alias("c"), "rank")
    met = written(sized.join(by_size(p), "a").join(held, ["c", "run"]).select("a", "s", "size", "n", "c", "rank", "at"))
    place = F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("place")
    half = F.count(F.lit(1)) * 2 >= F.first("size")
    whole = met.select("a", "s", "size", place).distinct().groupBy("a", "s").agg(half.alias("ok")).groupBy("a").agg(F.count_if("ok").alias("n_supported"))
    each = met.select("a", "s", "size", "c", "rank", place).distinct().groupBy("a", "s", "c", "rank").agg(half.alias("ok")).filter("ok").select("a", "c", "rank").distinct()
    up = Window.partitionBy("a").orderBy("rank", "c").rowsBetween(Window.unboundedPreceding, 0)  # an answer's contexts
    precision = each.withColumn("so_far", F.count(F.lit(1)).over(up)).groupBy("a").agg(F.avg(F.col("so_far") / F.col("rank")).alias("context_precision"))
    counts = sized.select("a", "s").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n_sentences"))
    out = counts.join(whole, "a", "left").join(precision, "a", "left").withColumn("n_supported", F.coalesce("n_supported", F.lit(0)))
    return out.select(F.col("a").alias(answer), "n_sentences", "n_supported", (F.col("n_supported") / F.col("n_sentences")).alias("context_recall"), F.coalesce("context_precision", F.lit(0.0)).alias("context_precision"))


def entity_recall(answers: DataFrame, contexts: DataFrame, answer: str = "answer_id") -> DataFrame:
    """(answer, n_entities, n_found, entity_recall) of each answer with entities. answers: (answer, text); contexts: (answer, text), several an answer."""
    wanted = answers.select(answer, F.explode(entities("text")).alias("entity")).distinct()
    there = contexts.select(answer, F.explode(entities("text")).alias("entity")).distinct().withColumn("hit", F.lit(1))
    n = wanted.join(there, [answer, "entity"], "left").groupBy(answer).agg(F.count(F.lit(1)).alias("n_entities"), F.count("hit").alias("n_found"))
    return n.withColumn("entity_recall", F.col("n_found") / F.col("n_entities"))
