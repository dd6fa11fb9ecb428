"""Queries of web ingestion, cleanup, refresh and incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as t
from ..operators import html, table_functions
from ..sources import manifest
from ..streaming import resume
from .registry import query

PLAIN = r"regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"

INNER = "regexp_replace(b, '^<[^>]*>', '')"
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "pages").withColumn("source_id", F.concat(F.lit("page-"), F.col("page_id").cast("string")))


@query("html_title", f"SELECT page_id, nullif({PLAIN.format(TITLE)}, '') AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", html.title("html").alias("title"))


@query(
    "html_blocks",
    f"WITH b AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style|noscript|iframe)\\b.*?</(?:script|style|noscript|iframe)>', ' ', 'g'), '(?is)<(?:h[1-4]|p|li|table)\\b[^>]*>[^<]*')) AS b FROM pages) SELECT page_id, lower(regexp_extract(b, '(?i)^<([a-z0-9]+)', 1)) AS tag, count(*) AS n, sum(length({PLAIN.format(INNER)}))::BIGINT AS chars FROM b GROUP BY ALL",
)
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = html.blocks(pages(spark, sf), "page_id")
    return b.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("html_sections")
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    return html.sections(pages(spark, sf), "page_id").select("page_id", "knowledge_id", "document_id", "document_title", "section", "subsection", "content")


@query("html_sections_sql")
def html_sections_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The sections by a table function and a lateral join; tests hold it against html_sections."""
    table_functions.register(spark)
    return spark.sql("SELECT page_id, s.counter, s.section, s.subsection, s.content FROM {pages}, LATERAL page_sections(html) s", pages=pages(spark, sf).select("page_id", "html"))


LINES = r"array_to_string(list_filter(list_transform(regexp_split_to_array(translate(text, chr(160) || 'Â', '  '), '\r\n|\n|\r'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> ''), chr(10))"


@query("clean_html_text", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim({LINES}, ' ' || chr(10)) ELSE {LINES} END AS cleaned FROM documents")
def clean_html_text(spark: SparkSession, sf: str) -> DataFrame:
    dressed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Home | About Us |  Success Stories | Farmers Association | Contact \n"), "text", F.lit("\n© TNAU. All rights \n Content validator: x"))).otherwise(F.concat("text", F.lit("\nSource of Images: y")))
    return t.load(spark, sf, "documents").select("doc_id", html.clean_page_text(dressed).alias("cleaned"))


SAYS = ["Tomato - early blight", "NCLB on sweet corn", "powdery mildew seen", "Tomatoes wilt", "infected maize stands", "Maize Northern Leaf Blight", "nothing here"]


@query(
    "derive_crop_disease",
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Tomato' WHEN 1 THEN 'Corn' WHEN 3 THEN 'Tomato' WHEN 4 THEN 'Corn' WHEN 5 THEN 'Corn' END AS crop, CASE p_partkey % 7 WHEN 0 THEN 'early blight' WHEN 1 THEN 'Northern Corn Leaf Blight' WHEN 2 THEN 'powdery mildew' WHEN 5 THEN 'Northern Leaf Blight' END AS disease FROM part",
)
def derive_crop_disease(spark: SparkSession, sf: str) -> DataFrame:
    said = F.get(F.array(*map(F.lit, SAYS)), (F.col("p_partkey") % 7).cast("int"))
    return t.load(spark, sf, "part").select("p_partkey", html.crop_disease(said, "p_type").alias("c")).select("p_partkey", "c.*")


@query(
    "derive_evidence_type",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'treatment' WHEN 1 THEN 'symptoms' WHEN 2 THEN 'host_range' WHEN 3 THEN 'epidemiology' WHEN 4 THEN 'treatment' END AS evidence_type FROM part",
)
def derive_evidence_type(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("p_partkey") % 6).cast("int")
    head = F.get(F.array(*map(F.lit, ["Disease Management", "Symptoms", "Host range", "", "", ""])), k)
    body = F.get(F.array(*map(F.lit, ["symptoms: spots", "management: prune", "x", "spread and survival of spores", "rotate crops yearly", "plain words"])), k)
    return t.load(spark, sf, "part").select("p_partkey", html.evidence_type(F.concat_ws(" ", body, "p_name"), head).alias("evidence_type"))


@query("derive_policy", "SELECT doc_id, 'General' AS recommendation_preference, doc_id % 3 = 0 AS organic_eligible, doc_id % 4 = 0 AS ipm_eligible FROM documents")
def derive_policy(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Grown organically.").otherwise(" Inorganic."), F.when(F.col("doc_id") % 4 == 0, " Use IPM.").otherwise(" Shipment."))
    return t.load(spark, sf, "documents").select("doc_id", html.policy_flags(said).alias("p")).select("doc_id", "p.*")


REJECTS = r"norm AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), rej AS (SELECT doc_id, source, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 200 THEN 'short' WHEN contains(t, 'all rights reserved') THEN 'boilerplate' WHEN doc_id <> min(doc_id) OVER (PARTITION BY t) THEN 'duplicate' END AS reject_reason FROM norm)"


def rejects(spark: SparkSession, sf: str) -> DataFrame:
    return html.reject_reasons(t.load(spark, sf, "documents"), "doc_id", "text", 200, ("All rights reserved",))


@query("cleanup_accept", f"WITH {REJECTS} SELECT doc_id FROM rej WHERE reject_reason IS NULL")
def cleanup_accept(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(spark, sf).filter("reject_reason IS NULL").select("doc_id")


@query("cleanup_rejects", f"WITH {REJECTS} SELECT doc_id, reject_reason FROM rej WHERE reject_reason IS NOT NULL")
def cleanup_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(spark, sf).filter("reject_reason IS NOT NULL").select("doc_id", "reject_reason")


@query("cleanup_counts", f"WITH {REJECTS} SELECT reject_reason, count(*) AS n FROM rej WHERE reject_reason IS NOT NULL GROUP BY reject_reason")
def cleanup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(spark, sf).filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("count_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")
def count_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


@query("index_meta", f"WITH {REJECTS} SELECT count(*) AS raw_records, count(*) FILTER (reject_reason IS NULL) AS accepted_records, count(*) FILTER (reject_reason IS NOT NULL) AS rejected_records, count(DISTINCT source) AS sources FROM rej")
def index_meta(spark: SparkSession, sf: str) -> DataFrame:
    return rejects(spark, sf).agg(F.count(F.lit(1)).alias("raw_records"), F.count_if(F.col("reject_reason").isNull()).alias("accepted_records"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected_records"), F.count_distinct("source").alias("sources"))


@query(
    "changed_sources",
    "WITH a AS (SELECT lang AS domain, source AS name, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT lang AS domain, source AS name, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ALL) SELECT domain, name, CASE WHEN a.n IS NULL THEN 'new' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (domain, name) WHERE a.n IS NULL OR a.n <> b.n OR a.size <> b.size",
)
def changed_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents")
    snap = lambda x: x.groupBy(F.col("lang").alias("domain"), F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"))
    return manifest.changes(snap(d.filter(F.col("doc_id") % 2 == 0)), snap(d), ["domain", "name"], ["n", "size"])


@query("resume_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 44)")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = t.load(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 44").select(F.col("l_partkey").alias("p_partkey"))
    return resume.pending(t.load(spark, sf, "part").select("p_partkey"), done, "p_partkey")


@query("latest_case_state", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_case_state(spark: SparkSession, sf: str) -> DataFrame:
    return resume.latest_state(t.load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", "value")


@query("events_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    w = resume.windowed_counts(t.load(spark, sf, "events"), "ts", "1 hour", "event_type")
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "events_session",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id",
)
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    s = resume.sessions(t.load(spark, sf, "events"), "ts", "30 minutes", "user_id")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))
