"""Queries of evaluation: extraction from answers, votes, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import answers
from ..operators import evaluation as ev
from ..session import written
from .registry import query
from .retrieval import neighbours

NL = "chr(10)"
RESPONSES = f"""responses AS (SELECT conv_id, turn, turn % 2 = 1 AS truncated, text || CASE (conv_id + turn) % 6 WHEN 0 THEN '</think>' || {NL} || 'Answer: 3' WHEN 1 THEN {NL} || 'Final answer: 2. common rust' WHEN 2 THEN {NL} || '- **Disease**: Leaf_Blast' || {NL} || 'Confidence level: **High**'
  WHEN 3 THEN ' 85 % confidence apple scab' WHEN 4 THEN '</think>' || {NL} || '5' ELSE '' END AS response FROM conversations)"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    tails = ["</think>\nAnswer: 3", "\nFinal answer: 2. common rust", "\n- **Disease**: Leaf_Blast\nConfidence level: **High**", " 85 % confidence apple scab", "</think>\n5", ""]
    c = t.load(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 6
    return c.select("conv_id", "turn", (F.col("turn") % 2 == 1).alias("truncated"), F.concat("text", F.get(F.array(*map(F.lit, tails)), k.cast("int"))).alias("response"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
AFTER = "regexp_extract(resp, '(?is)^.*(?:</think>|</thinking>|final answer:)(.*)$', 1)"
SAID = r"regexp_extract_all(low, 'confidence(?:\s+level)?\s*:\s*([^\n\r]+)', 1)[-1]"
FINAL = f"CASE WHEN regexp_matches(resp, '(?is)^.*(?:</think>|</thinking>|final answer:)(.*)$') THEN {STRIP.format(AFTER)} ELSE resp END"
PLAIN = r"regexp_replace(translate(lower(" + STRIP + r"), '_-', '  '), '\s+', ' ', 'g')"


def label_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({PLAIN.format(x)}, '{label}') THEN '{label}'" for label in sorted(answers.LABELS, key=len, reverse=True)) + " END"


NUMBERED = "['" + "', '".join(answers.LABELS) + "']"
AT = r"(?s)^(?:.*[^0-9])?([1-6])(?:\s*[.):-])?(?:\s|$)(.*)$"
LAST_LABEL = "list_max([" + ", ".join(f"CASE WHEN contains(low, '{x}') THEN {{'p': length(low) - strpos(reverse(low), '{x[::-1]}') - {len(x)} + 1, 'l': '{x}'}} END" for x in answers.LABELS) + "]).l"
FIELD_SQL = ", ".join(f"list_filter(list_transform(list_reverse(regexp_extract_all(low, '{f}\\s*:\\s*([^\\n\\r]+)', 1)), lambda x: {label_sql('x')}), lambda x: x IS NOT NULL)[1]" for f in answers.FIELDS)
PREDICTED = f"""{RESPONSES}, b AS (SELECT conv_id, turn, truncated, {STRIP.format("response")} AS resp FROM responses), f AS (SELECT *, lower(resp) AS low, {FINAL} AS final FROM b),
n AS (SELECT *, regexp_extract(lower(final), '{AT}', 1) AS num, regexp_extract(lower(final), '{AT}', 2) AS tail FROM f),
pred AS (SELECT conv_id, turn, coalesce({NUMBERED}[try_cast(regexp_extract_all(low, '\\banswer\\s*:\\s*([1-6])\\b', 1)[-1] AS INT)],
  CASE WHEN num <> '' THEN coalesce({label_sql("tail")}, CASE WHEN length(final) <= 40 OR (regexp_extract(lower(final), '^\\s*([0-9])\\s*[.):-]?\\s*', 1) = num AND starts_with(regexp_replace(lower(final), '^\\s*[0-9]\\s*[.):-]?\\s*', ''), {NUMBERED}[num::INT])) THEN {NUMBERED}[num::INT] END) END,
  {FIELD_SQL}, {label_sql("final")}, {LAST_LABEL}, CASE WHEN truncated THEN 'incomplete' ELSE 'unknown' END) AS prediction FROM n)"""


@query("final_answer", f"WITH {RESPONSES}, b AS (SELECT conv_id, turn, {STRIP.format('response')} AS resp FROM responses) SELECT conv_id, turn, {FINAL} AS final FROM b")
def final_answer(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("conv_id", "turn", answers.final_answer("response").alias("final"))


@query("extract_prediction", f"WITH {PREDICTED} SELECT conv_id, turn, prediction FROM pred")
def extract_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("conv_id", "turn", answers.prediction("response", "truncated").alias("prediction"))


@query("label_in_text", f"WITH {RESPONSES} SELECT conv_id, turn, {label_sql('response')} AS label FROM responses")
def label_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("conv_id", "turn", answers.label_in("response").alias("label"))


@query(
    "extract_confidence",
    f"WITH {RESPONSES}, l AS (SELECT conv_id, turn, lower(response) AS low FROM responses) SELECT conv_id, turn, coalesce(substr(trim({STRIP.format(SAID)}, ' *_\"'''), 1, 40), replace(regexp_extract_all(low, '([0-9]{{1,3}}\\s*%)\\s*confidence', 1)[-1], ' ', ''), 'unknown') AS confidence FROM l",
)
def extract_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("conv_id", "turn", answers.confidence("response").alias("confidence"))


@query(
    "extract_fields",
    f"WITH {RESPONSES} SELECT conv_id, turn, nullif(trim(regexp_extract(response, '(?im)^\\s*(?:[-*+]\\s+)?(?:\\*\\*)?Disease(?:\\*\\*)?\\s*:\\s*(.+?)\\s*$', 1), ' *'), '') AS disease FROM responses",
)
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("conv_id", "turn", answers.field("response", *answers.ALIASES["disease"]).alias("disease"))




@query("ground_truth_path", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'leaf blast' WHEN 1 THEN 'black rot' END AS truth FROM part")
def ground_truth_path(spark: SparkSession, sf: str) -> DataFrame:
    p, k = t.load(spark, sf, "part"), F.col("p_partkey") % 3
    path = F.when(k == 0, F.concat(F.lit("/data/Rice___Leaf_Blast/set/"), "p_name", F.lit(".jpg"))).when(k == 1, F.concat(F.lit("/data/"), "p_name", F.lit("/black-rot.png"))).otherwise(F.concat(F.lit("/data/"), "p_name", F.lit("/x.png")))
    return p.select("p_partkey", answers.path_truth(path).alias("truth"))


LOOSE = "regexp_replace(regexp_replace({0}, '___|__|_', ' ', 'g'), '\\s+', ' ', 'g')"
TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ')"


@query("loose_label", f"WITH {t.NAMES} SELECT p_partkey, {TITLE.format(LOOSE.format('folder'))} AS label FROM names")
def loose_label(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat("folder", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".JPG"))
    return t.names(spark, sf).select("p_partkey", answers.loose_label(named).alias("label"))


@query(
    "labels_match",
    f"WITH {t.NAMES}, x AS (SELECT p_partkey, lower({LOOSE.format('folder')}) AS a, lower('tomato ' || noun || ' ' || colour) AS b FROM names) SELECT p_partkey, contains(a, b) OR contains(b, a) OR list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda w: w NOT IN ('tomato', 'potato', 'apple', 'grape', 'pepper', 'bell'))) = list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda w: w NOT IN ('tomato', 'potato', 'apple', 'grape', 'pepper', 'bell'))) AS matched FROM x",
)
def labels_match(spark: SparkSession, sf: str) -> DataFrame:
    n = t.names(spark, sf)
    return n.select("p_partkey", answers.labels_match("folder", F.concat_ws("_", F.lit("Tomato"), "noun", "colour")).alias("matched"))


@query(
    "response_quality",
    f"WITH {PREDICTED}, r AS (SELECT r.conv_id, r.turn, lower(r.response) AS low, prediction FROM responses r JOIN pred p ON p.conv_id = r.conv_id AND p.turn = r.turn) SELECT conv_id, turn, round(((length(low) > 20)::INT + (prediction NOT IN ('unknown', 'incomplete'))::INT + "
    + " + ".join("(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")::INT" for ws in answers.RUBRIC.values())
    + ") / 7 * 100, 2) AS score FROM r",
)
def response_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = ~answers.prediction("response", "truncated").isin("unknown", "incomplete")
    checks = answers.rubric("response", found)
    total = sum((c.cast("int") for c in checks.values()), F.lit(0))
    return responses(spark, sf).select("conv_id", "turn", F.round(total / len(checks) * 100, 2).alias("score"))


# labels as truth and prediction, in two classes

PAIRS = "pairs AS (SELECT quality::VARCHAR AS truth, toxic::VARCHAR AS prediction FROM labels)"
REPORT = """ct AS (SELECT truth, prediction, count(*) AS n FROM {0} GROUP BY ALL), lab AS ({1}), rep AS (SELECT label, coalesce((SELECT sum(n) FROM ct WHERE truth = label), 0) AS support, coalesce((SELECT sum(n) FROM ct WHERE prediction = label), 0) AS predicted,
  coalesce((SELECT sum(n) FROM ct WHERE truth = label AND prediction = label), 0) AS tp FROM lab), pr AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM rep),
report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
SEEN = "SELECT truth AS label FROM ct UNION SELECT prediction FROM ct"
MEANS = "round((SELECT avg((truth = prediction)::INT) FROM {0}), 6) AS accuracy, " + ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "f1"))
THREE = "SELECT unnest(['0', '1', '2']) AS label"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "labels").select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("prediction"))


def three(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("0",), ("1",), ("2",)], "label string")


@query("eval_metrics", f"WITH {PAIRS}, {REPORT.format('pairs', THREE)} SELECT {MEANS.format('pairs')} FROM report")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.metrics(pairs(spark, sf), three(spark))


@query("eval_metrics_union", f"WITH {PAIRS}, {REPORT.format('pairs', SEEN)} SELECT {MEANS.format('pairs')} FROM report")
def eval_metrics_union(spark: SparkSession, sf: str) -> DataFrame:
    return ev.metrics(pairs(spark, sf))


@query("eval_per_class_binary", f"WITH {PAIRS}, {REPORT.format('pairs', SEEN)} SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report")
def eval_per_class_binary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.class_report(pairs(spark, sf)).select("label", "support", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")))


# nearest neighbours as the base model, a vote of three as the other

NN = """nv AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), un AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM nv),
ns AS (SELECT a.vec_id, a.label, b.label AS other, round(list_dot_product(a.v, b.v), 6) AS score, b.vec_id AS oid FROM un a, un b WHERE a.vec_id <> b.vec_id), nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, oid) AS k FROM ns) WHERE k <= 3),
vote AS (SELECT vec_id, label, other, count(*) AS votes, min(k) AS first FROM nk GROUP BY ALL), three AS (SELECT vec_id, label, other AS lora FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, first) AS n FROM vote) WHERE n = 1),
ab AS (SELECT t.vec_id, t.label::VARCHAR AS truth, k.other::VARCHAR AS base, t.lora::VARCHAR AS lora FROM three t JOIN nk k ON k.vec_id = t.vec_id AND k.k = 1),
av AS (SELECT *, CASE WHEN base = truth AND lora = truth THEN 'BOTH CORRECT' WHEN lora = truth THEN 'IMPROVED' WHEN base = truth THEN 'REGRESSED' ELSE 'BOTH INCORRECT' END AS verdict FROM ab)"""


def ab(spark: SparkSession, sf: str) -> DataFrame:
    near = written(neighbours(spark, sf).filter("k <= 3"))  # both models read it
    three = ev.majority(near, "query_id", "other", "k").select("query_id", F.col("other").cast("string").alias("lora"))
    one = near.filter("k = 1").select("query_id", F.col("label").cast("string").alias("truth"), F.col("other").cast("string").alias("base"))
    return one.join(three, "query_id").withColumn("verdict", ev.verdict("truth", "base", "lora")).withColumnRenamed("query_id", "vec_id")


@query("ab_verdict", f"WITH {NN} SELECT vec_id, truth, base, lora, verdict FROM av")
def ab_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return ab(spark, sf).select("vec_id", "truth", "base", "lora", "verdict")


@query("verdict_counts", f"WITH {NN} SELECT verdict, count(*) AS n FROM av GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ab(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("per_class_ab", f"WITH {NN} SELECT truth, count(*) AS total, count(*) FILTER (base = truth) AS base_correct, count(*) FILTER (lora = truth) AS lora_correct FROM av GROUP BY truth")
def per_class_ab(spark: SparkSession, sf: str) -> DataFrame:
    hit = lambda c: F.count_if(F.col(c) == F.col("truth"))
    return ab(spark, sf).groupBy("truth").agg(F.count(F.lit(1)).alias("total"), hit("base").alias("base_correct"), hit("lora").alias("lora_correct"))


@query("class_report", f"WITH {NN}, nn AS (SELECT truth, base AS prediction FROM av), {REPORT.format('nn', SEEN)} SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM report")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    r = ev.class_report(written(ab(spark, sf).select("truth", F.col("base").alias("prediction"))))
    return r.select("label", "support", *(F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")))


def _means(side: str) -> str:
    return f"WITH {NN}, nn AS (SELECT truth, {side} AS prediction FROM av), {REPORT.format('nn', SEEN)} SELECT {MEANS.format('nn')} FROM report"


@query("metric_delta", f"WITH b AS (UNPIVOT ({_means('base')}) ON COLUMNS(*) INTO NAME metric VALUE base), l AS (UNPIVOT ({_means('lora')}) ON COLUMNS(*) INTO NAME metric VALUE other) SELECT metric, base, other, round(other - base, 6) AS delta FROM b JOIN l USING (metric)")
def metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    x = written(ab(spark, sf).select("truth", "base", "lora"))  # four aggregates read it
    side = lambda c: ev.metrics(x.select("truth", F.col(c).alias("prediction")))
    return ev.metric_delta(side("base"), side("lora"))




@query(
    "confusion_matrix",
    "WITH m AS (SELECT label::VARCHAR AS truth, CASE WHEN vec_id % 13 = 0 THEN 'none' ELSE ((label + vec_id) % 12)::VARCHAR END AS prediction FROM embeddings) SELECT truth, " + ", ".join(f"count(*) FILTER (prediction = '{k}') AS \"{k}\"" for k in range(10)) + ", count(*) FILTER (prediction NOT IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9')) AS other FROM m GROUP BY truth",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = t.load(spark, sf, "embeddings")
    p = F.when(F.col("vec_id") % 13 == 0, "none").otherwise(((F.col("label") + F.col("vec_id")) % 12).cast("string"))
    return ev.confusion(e.select(F.col("label").cast("string").alias("truth"), p.alias("prediction")), [str(k) for k in range(10)])


@query("confusion_long", f"WITH {PAIRS}, l AS (SELECT truth AS l FROM pairs UNION SELECT prediction FROM pairs) SELECT a.l AS truth, b.l AS prediction, (SELECT count(*) FROM pairs p WHERE p.truth = a.l AND p.prediction = b.l) AS n FROM l a, l b")
def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_long(pairs(spark, sf))


# events as repeated runs

RUNS = "runs AS (SELECT user_id AS item, event_id AS seq, event_type AS prediction, value AS seconds FROM events), votes AS (SELECT item, prediction, count(*) AS votes, min(seq) AS first FROM runs GROUP BY ALL), maj AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, first) AS n, sum(votes) OVER (PARTITION BY item) AS runs FROM votes)"


@query("majority_vote", f"WITH {RUNS} SELECT item, prediction, votes, votes || '/' || runs AS agreement, round((SELECT sum(seconds) FROM runs r WHERE r.item = maj.item), 4) AS total_seconds FROM maj WHERE n = 1")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return ev.agreement(t.predictions(spark, sf)).select("item", "prediction", "votes", "agreement", "total_seconds")


@query("stability", f"WITH {RUNS} SELECT count(*) FILTER (votes = runs) AS unanimous, count(*) FILTER (votes <> runs) AS split FROM maj WHERE n = 1")
def stability(spark: SparkSession, sf: str) -> DataFrame:
    m = ev.majority(t.predictions(spark, sf))
    return m.agg(F.count_if(F.col("votes") == F.col("runs")).alias("unanimous"), F.count_if(F.col("votes") != F.col("runs")).alias("split"))


@query("eval_valid_only", "SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS hits FROM events WHERE event_type NOT IN ('error', 'Unknown')")
def eval_valid_only(spark: SparkSession, sf: str) -> DataFrame:
    p = t.predictions(spark, sf).filter(~F.col("prediction").isin("error", "Unknown"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "purchase").alias("hits"))


@query("latency_summary", "SELECT event_type, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_seconds, count(*) FILTER (value > 100) AS over_limit FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("mean_seconds"), F.count_if(F.col("value") > 100).alias("over_limit"))


@query("confidence_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events WHERE value IS NOT NULL GROUP BY event_type")
def confidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "events").groupBy("event_type").agg(*(F.round(f("value"), 6).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("low", F.min), ("high", F.max))))


@query("geo_confidence", "SELECT label, round(exp(avg(ln(greatest(least(abs(x), 1), 1e-12)))) * 100, 6) AS confidence FROM (SELECT label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings) GROUP BY label")
def geo_confidence(spark: SparkSession, sf: str) -> DataFrame:
    x = t.vectors(spark, sf).select("label", F.explode("vector").alias("x"))
    return x.groupBy("label").agg(F.round(ev.geometric_confidence(F.abs("x")), 6).alias("confidence"))


@query("label_rollup", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ROLLUP (quality, toxic)")
def label_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "labels").rollup("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
