"""Queries of loading, chunking, rendering and the evidence policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import text
from ..operators import chunking, contracts, hybrid, policy, table_functions
from ..sources import readers
from . import retrieval as r
from ..session import by_size
from .registry import query

WORDS = r"list_filter(regexp_split_to_array(content, '[\s\x{00A0}\x0B]+'), lambda x: x <> '')"
WINDOWS = f"""tk AS (SELECT knowledge_id, {WORDS} AS tk FROM records), win AS (SELECT knowledge_id, tk, unnest(generate_series(0, greatest(ceil((len(tk) - 800) / 700.0), 0)::BIGINT * 700, 700)) AS start FROM tk WHERE len(tk) > 0),
chunks AS (SELECT knowledge_id, start, start // 700 AS chunk_index, count(*) OVER (PARTITION BY knowledge_id) AS total_chunks, tk[start + 1 : start + 800] AS tokens FROM win)"""


@query("scan_json_props", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT) AS total FROM events GROUP BY event_type")
def scan_json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "FAILFAST"})["k"]
    return t.load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query(
    "load_diagnosis",
    f"WITH {t.NAMES} SELECT p_partkey::VARCHAR AS knowledge_id, brand AS source, concat_ws('. ', 'Crop: ' || noun, 'Disease or condition: ' || colour, 'Original label: ' || folder) AS content, brand || ' diagnosis evidence' AS title FROM names",
)
def load_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    n = t.names(spark, sf).select(F.col("p_partkey").alias("sample_id"), F.col("noun").alias("crop"), F.col("colour").alias("disease"), F.lit("").alias("health_status"), F.col("folder").alias("original_label"), F.col("brand").alias("source"))
    return readers.diagnosis_records(n).select("knowledge_id", "source", "content", "title")


@query(
    "load_treatment_defaults",
    f"WITH {t.RECORDS} SELECT knowledge_id, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'agricultural_guidance' END AS source_type, 'treatment' AS evidence_type, CASE WHEN doc_id % 2 = 0 THEN recommendation_preference ELSE 'General' END AS recommendation_preference, CASE WHEN doc_id % 2 = 0 THEN organic_eligible ELSE false END AS organic_eligible, false AS ipm_eligible, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR END AS extra FROM records",
)
def load_treatment_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rec = t.records(spark, sf)
    some = lambda c: F.when(F.col("doc_id") % 2 == 0, c)
    line = F.to_json(F.struct("knowledge_id", "source", "content", some(F.lit("web")).alias("source_type"), some(F.col("recommendation_preference")).alias("recommendation_preference"), some(F.col("organic_eligible")).alias("organic_eligible"), some(F.col("doc_id")).alias("origin_row")))
    out = readers.treatment_records(rec.select(line.alias("value")))
    return out.select("knowledge_id", "source_type", "evidence_type", "recommendation_preference", "organic_eligible", "ipm_eligible", F.element_at("metadata", "origin_row").alias("extra"))


@query("union_sources", "SELECT 'doc-' || doc_id AS knowledge_id, source, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'page-' || page_id, NULL, url FROM pages")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.load(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("knowledge_id"), "source")
    pages = t.load(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("knowledge_id"), "url")
    return readers.all_records(docs, pages).select("knowledge_id", "source", "url")


@query("clean_text", f"WITH {t.RECORDS} SELECT knowledge_id, regexp_replace(regexp_replace(regexp_replace(replace(content, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM records")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return t.records(spark, sf).select("knowledge_id", text.clean("content").alias("cleaned"))


@query("stable_ids", "SELECT page_id, 'ext-' || substr(sha256('page-' || page_id || '||' || url || '||'), 1, 16) AS document_id FROM pages")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = t.load(spark, sf, "pages")
    return p.select("page_id", text.stable_id(F.concat(F.lit("page-"), F.col("page_id").cast("string")), "url", F.lit(None).cast("string")).alias("document_id"))


@query(
    "context_label",
    "SELECT p_partkey, replace(lower(split_part(p_name, ' ', 1)), ' ', '_') || '_' || lower(split_part(p_name, ' ', 2)) AS label FROM part",
)
def context_label(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("  "), "p_name", F.lit(" (var. "), "p_brand", F.lit("), which is  often seen — note. "))
    return t.load(spark, sf, "part").select("p_partkey", text.context_label(said).alias("label"))


@query(
    "lookup_label",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'northern_leaf_blight' WHEN 1 THEN 'bacterial_leaf_blight' ELSE replace(lower(p_name), ' ', '_') END AS lookup, CASE p_partkey % 4 WHEN 0 THEN 'northern_leaf_blight' WHEN 1 THEN 'bacterial_leaf_blight' WHEN 2 THEN replace(lower(p_name), ' ', '_') ELSE replace(lower(p_name), ' ', '_') || '__' END AS filter_key FROM part",
)
def lookup_label(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, " NCLB ").when(k == 1, "Bacterial  Leaf Blight").when(k == 2, F.concat(F.lit(" "), "p_name")).otherwise(F.concat("p_name", F.lit("__")))
    return t.load(spark, sf, "part").select("p_partkey", text.lookup_label(said).alias("lookup"), text.filter_label(said).alias("filter_key"))


@query("metadata_map", f"WITH {t.RECORDS} SELECT knowledge_id, recommendation_preference AS preference, '3' AS n_keys FROM records")
def metadata_map(spark: SparkSession, sf: str) -> DataFrame:
    own = F.create_map(F.lit("recommendation_preference"), F.lit("overwritten"), F.lit("note"), F.lit("kept"))
    m = t.records(spark, sf).select("knowledge_id", chunking.metadata_map(own, "source", "recommendation_preference").alias("m"))
    return m.select("knowledge_id", F.element_at("m", "recommendation_preference").alias("preference"), F.size("m").cast("string").alias("n_keys"))


RENDER_HEAD = "concat_ws(chr(10), 'Source: ' || source, 'Evidence type: ' || evidence_type, 'Crop: ' || nullif(crop, ''), 'Disease: ' || nullif(disease, '')"
RENDER_FLAGS = "'Recommendation preference: ' || recommendation_preference, 'Organic eligible: ' || organic_eligible::VARCHAR, 'IPM eligible: ' || ipm_eligible::VARCHAR"


@query("render_record", f"WITH {t.RECORDS} SELECT knowledge_id, CASE evidence_type WHEN 'diagnosis' THEN {RENDER_HEAD}) ELSE {RENDER_HEAD}, {RENDER_FLAGS}, 'Content: ' || nullif(content, '')) END AS rendered FROM records")
def render_record(spark: SparkSession, sf: str) -> DataFrame:
    return t.records(spark, sf).select("knowledge_id", chunking.retrieval_text().alias("rendered"))


@query(
    "render_chunk",
    f"WITH {t.RECORDS}, {WINDOWS}, c AS (SELECT chunks.*, source, evidence_type, crop, disease, recommendation_preference, organic_eligible, ipm_eligible, array_to_string(tokens, ' ') AS content FROM chunks JOIN records USING (knowledge_id)) SELECT knowledge_id, chunk_index, CASE evidence_type WHEN 'diagnosis' THEN {RENDER_HEAD}, 'Chunk: ' || (chunk_index + 1) || '/' || total_chunks, 'Content: ' || content) ELSE {RENDER_HEAD}, {RENDER_FLAGS}, 'Chunk: ' || (chunk_index + 1) || '/' || total_chunks, 'Content: ' || content) END AS rendered FROM c",
)
def render_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rec = t.records(spark, sf)
    chunks = chunking.chunk_windows(rec).withColumn("content", F.array_join("tokens", " "))
    out = chunks.join(rec.drop("content"), "knowledge_id")
    return out.select("knowledge_id", F.col("chunk_index").cast("long").alias("chunk_index"), chunking.retrieval_text(chunk=("chunk_index", "total_chunks")).alias("rendered"))


SPLIT = r"""para AS (SELECT knowledge_id, list_filter(regexp_split_to_array(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\n\s*\n+'), lambda x: x <> '') AS ps FROM records),
tidy AS (SELECT knowledge_id, list_transform(ps, lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10))) AS ps FROM para),
pieces AS (SELECT knowledge_id, list_filter(flatten(list_transform(ps, lambda p: string_split(regexp_replace(p, '\n((?:[-*•]|[0-9]+[.)]|[A-Za-z][.)])[ \t]+)', chr(1) || '\1', 'g'), chr(1)))), lambda x: x <> '') AS pieces FROM tidy)"""


@query("split_structures", f"WITH {t.RECORDS}, {SPLIT} SELECT knowledge_id, len(pieces) AS n, array_to_string(pieces, chr(30)) AS pieces FROM pieces")
def split_structures(spark: SparkSession, sf: str) -> DataFrame:
    out = t.records(spark, sf).select("knowledge_id", text.structures("content").alias("p"))
    return out.select("knowledge_id", F.size("p").cast("long").alias("n"), F.array_join("p", "\x1e").alias("pieces"))


@query("chunk_windows", f"WITH {t.RECORDS}, {WINDOWS} SELECT knowledge_id, start, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS content FROM chunks")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_windows(t.records(spark, sf))
    return c.select("knowledge_id", F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("content"))


@query("chunk_positions", f"WITH {t.RECORDS}, {WINDOWS} SELECT format('{{:s}}::chunk-{{:04d}}', knowledge_id, chunk_index) AS chunk_id, chunk_index, total_chunks FROM chunks")
def chunk_positions(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_windows(t.records(spark, sf))
    return c.select(chunking.chunk_id("knowledge_id", "chunk_index").alias("chunk_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"))


#: The packing as two folds: units into chunks of at most 800 tokens, then small chunks into the one before.
PACKED = rf"""WITH RECURSIVE {t.RECORDS}, {SPLIT}, piece AS (SELECT knowledge_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS b FROM pieces),
blk AS (SELECT knowledge_id, b, list_filter(regexp_split_to_array(piece, '[\s\x{{00A0}}]+'), lambda x: x <> '') AS tk FROM piece),
units AS (SELECT knowledge_id, row_number() OVER (PARTITION BY knowledge_id ORDER BY b, s) AS u, tk[s + 1 : s + 800] AS tk FROM blk, unnest(CASE WHEN len(tk) > 800 THEN range(0, (len(tk) - 101) // 700 * 700 + 1, 700) ELSE [0] END) x(s) WHERE len(tk) > 0),
fold AS (SELECT knowledge_id, u, tk AS now, []::VARCHAR[][] AS closed FROM units WHERE u = 1
  UNION ALL SELECT knowledge_id, u, CASE WHEN fits THEN now || tk WHEN len(joined) > 800 THEN joined[701:] ELSE joined END, CASE WHEN fits THEN [] WHEN len(joined) > 800 THEN [now, joined[:800]] ELSE [now] END
  FROM (SELECT n.knowledge_id, n.u, f.now, n.tk, len(f.now) + len(n.tk) <= 650 AS fits, f.now[greatest(len(f.now) - 99, 1):] || n.tk AS joined FROM fold f JOIN units n ON n.knowledge_id = f.knowledge_id AND n.u = f.u + 1)),
shut AS (SELECT knowledge_id, u, unnest(closed) AS chunk, generate_subscripts(closed, 1) AS k FROM fold UNION ALL SELECT knowledge_id, u, now, 3 FROM (SELECT *, max(u) OVER (PARTITION BY knowledge_id) AS last_ FROM fold) WHERE u = last_),
chunks AS (SELECT knowledge_id, chunk, row_number() OVER (PARTITION BY knowledge_id ORDER BY u, k) AS c FROM shut),
mend AS (SELECT knowledge_id, c, chunk AS now, NULL::VARCHAR[] AS done FROM chunks WHERE c = 1
  UNION ALL SELECT n.knowledge_id, n.c, CASE WHEN len(n.chunk) < 120 AND len(m.now) + len(n.chunk) <= 800 THEN m.now || n.chunk ELSE n.chunk END, CASE WHEN len(n.chunk) < 120 AND len(m.now) + len(n.chunk) <= 800 THEN NULL ELSE m.now END
  FROM mend m JOIN chunks n ON n.knowledge_id = m.knowledge_id AND n.c = m.c + 1),
whole AS (SELECT knowledge_id, c, done AS chunk FROM mend WHERE done IS NOT NULL UNION ALL SELECT knowledge_id, c + 1, now FROM (SELECT *, max(c) OVER (PARTITION BY knowledge_id) AS last_ FROM mend) WHERE c = last_)
SELECT format('{{:s}}::chunk-{{:04d}}', knowledge_id, row_number() OVER (PARTITION BY knowledge_id ORDER BY c) - 1) AS chunk_id, (count(*) OVER (PARTITION BY knowledge_id))::INT AS total_chunks, array_to_string(chunk, ' ') AS content FROM whole"""


@query("chunk_pack", PACKED)
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.chunk_pack(t.records(spark, sf))
    return c.select(chunking.chunk_id("knowledge_id", "chunk_index").alias("chunk_id"), "total_chunks", "content")


@query("chunk_pack_sql", PACKED)
def chunk_pack_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The packed chunks by a table function and a lateral join."""
    table_functions.register(spark)
    return spark.sql(
        "SELECT format_string('%s::chunk-%04d', knowledge_id, c.chunk_index) AS chunk_id, c.total_chunks, c.content FROM {docs}, LATERAL packed_chunks(content, 650, 100, 800, 120) c",
        docs=t.records(spark, sf).select("knowledge_id", "content"),
    )


@query("chunk_lines_sql", PACKED)
def chunk_lines_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The packed chunks by a table function over the lines of all texts, brought together by text and in order."""
    table_functions.register(spark)
    lines = t.records(spark, sf).select("knowledge_id", F.posexplode(F.split("content", "\n")).alias("position", "line"))
    return spark.sql(
        "SELECT format_string('%s::chunk-%04d', knowledge_id, chunk_index) AS chunk_id, total_chunks, content FROM packed_lines(TABLE(SELECT * FROM {lines}), 'knowledge_id', 'position', 'line')",
        lines=lines,
    )


# policy

THRESHOLD = 0.2
OVERLAP = f"round(len(list_intersect(list_distinct({r.TOKENS.format('query')}), list_distinct({r.TOKENS.format('content')}))) / len(list_distinct({r.TOKENS.format('query')})), 6)"
CANDS = f"{r.CANDIDATES}, cand AS (SELECT m.query_id, m.knowledge_id, q.query, q.preference, q.want_crop, r.* EXCLUDE (knowledge_id), m.vector_score, m.bm25_score FROM merged m JOIN queries q USING (query_id) JOIN records r USING (knowledge_id))"
NARROW = f"{CANDS}, narrow AS (SELECT * EXCLUDE (hit) FROM (SELECT *, bool_or(recommendation_preference = preference) OVER (PARTITION BY query_id) AS hit FROM cand) WHERE NOT hit OR recommendation_preference = preference)"
RERANK = f"{NARROW}, scored AS (SELECT *, {OVERLAP} AS reranker_score FROM narrow), reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, knowledge_id) AS rerank FROM scored) WHERE rerank <= 8)"
REASON = f"""CASE WHEN lower(crop) <> want_crop THEN 'Context mismatch: crop=''' || lower(crop) || ''', expected=''' || want_crop || '''.'
  WHEN evidence_type <> 'treatment' THEN 'Evidence type mismatch: ''' || evidence_type || ''', expected=''treatment''.'
  WHEN preference IN ('Organic', 'IPM') AND recommendation_preference <> preference THEN 'Policy mismatch: evidence preference ''' || recommendation_preference || ''' cannot satisfy requested ''' || preference || '''.'
  WHEN preference = 'Organic' AND NOT organic_eligible THEN 'Policy violation: evidence is not Organic eligible.' WHEN preference = 'IPM' AND NOT ipm_eligible THEN 'Policy violation: evidence is not IPM eligible.'
  WHEN reranker_score IS NULL THEN 'Missing or invalid reranker relevance score.' WHEN reranker_score < {THRESHOLD} THEN printf('Weak relevance: score %.6f is below configured threshold {THRESHOLD:.6f}.', reranker_score) END"""
JUDGED = f"{RERANK}, judged AS (SELECT *, {REASON} AS reason, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = reranked.doc_id AND l.toxic = 1) AS conflict FROM reranked)"
STATUS = f"{JUDGED}, status AS (SELECT query_id, count(*) FILTER (reason IS NULL) AS n_accepted, count(*) FILTER (reason IS NOT NULL) AS n_rejected, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'INSUFFICIENT' WHEN bool_or(reason IS NULL AND conflict) THEN 'CONFLICTING' ELSE 'SUFFICIENT' END AS status FROM judged GROUP BY query_id)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    q = by_size(t.queries(spark, sf))
    return r.merged(spark, sf).select("query_id", "knowledge_id", "vector_score", "bm25_score").join(q, "query_id").join(t.records(spark, sf), "knowledge_id")


def narrow(spark: SparkSession, sf: str) -> DataFrame:
    return policy.narrowed(candidates(spark, sf), F.col("recommendation_preference") == F.col("preference"))


def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return policy.reranked(narrow(spark, sf).withColumn("reranker_score", policy.overlap_score("query", "content")), "reranker_score", 8)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    policy.check_request("General", "treatment")
    bad = t.load(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("conflict", F.lit(True))
    out = reranked(spark, sf).withColumn("want_type", F.lit("treatment")).join(bad, "doc_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return out.withColumn("reason", policy.refusal("want_crop", None, "want_type", "preference", THRESHOLD))


@query(
    "api_evidence",
    f"""WITH {r.CANDIDATES} SELECT f.query_id, f.knowledge_id, f.knowledge_id || '::chunk-0000' AS chunk_id, source, 'Unknown' AS source_type, crop, disease, evidence_type, recommendation_preference, {OVERLAP} AS reranker_score,
CASE WHEN vector_rank IS NOT NULL THEN vector_score END AS vector_score, CASE WHEN bm25_rank IS NOT NULL THEN bm25_score END AS bm25_score, round(rrf_score, 6) AS hybrid_score FROM fused f JOIN records USING (knowledge_id) JOIN queries USING (query_id)""",
)
def api_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates in the service's shape: a score is null where that retriever did not find the record."""
    q, m = t.queries(spark, sf), r.merged(spark, sf)
    policy.demand_queries(q)
    found = lambda score, rank: F.when(F.col(rank).isNotNull(), F.col(score))
    m = m.withColumns({"vector_score": found("vector_score", "vector_rank"), "bm25_score": found("bm25_score", "bm25_rank"), "hybrid_score": F.round(hybrid.rrf("vector_rank", "bm25_rank"), 6)})
    rows = m.join(by_size(q.select("query_id", "query")), "query_id").join(t.records(spark, sf), "knowledge_id")
    rows = rows.withColumns({"chunk_id": F.concat("knowledge_id", F.lit("::chunk-0000")), "reranker_score": policy.overlap_score("query", "content")})
    return contracts.api_evidence(rows, "query_id")


@query("preference_narrowing", f"WITH {NARROW} SELECT query_id, knowledge_id FROM narrow")
def preference_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    return narrow(spark, sf).select("query_id", "knowledge_id")


@query("rerank_topk", f"WITH {RERANK} SELECT query_id, knowledge_id, reranker_score, rerank FROM reranked")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return reranked(spark, sf).select("query_id", "knowledge_id", "reranker_score", F.col("rerank").cast("long").alias("rerank"))


@query("evidence_filter", f"WITH {JUDGED} SELECT query_id, knowledge_id, reason FROM judged")
def evidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("query_id", "knowledge_id", "reason")


@query("evidence_status", f"WITH {STATUS} SELECT query_id, status, n_accepted, n_rejected FROM status")
def evidence_status(spark: SparkSession, sf: str) -> DataFrame:
    return policy.status(judged(spark, sf)).select("query_id", "status", "n_accepted", "n_rejected")


@query("abstention", f"WITH {STATUS} SELECT query_id, status = 'SUFFICIENT' AND n_accepted > 0 AS model_called FROM status")
def abstention(spark: SparkSession, sf: str) -> DataFrame:
    return policy.status(judged(spark, sf)).select("query_id", policy.may_generate().alias("model_called"))


@query("traceability", f"WITH {JUDGED} SELECT query_id, knowledge_id || '::chunk-0000' AS chunk_id, source, crop, disease, evidence_type, recommendation_preference, organic_eligible, ipm_eligible, reranker_score, vector_score, bm25_score FROM judged WHERE reason IS NULL")
def traceability(spark: SparkSession, sf: str) -> DataFrame:
    ok = judged(spark, sf).filter("reason IS NULL")
    return ok.select("query_id", chunking.chunk_id("knowledge_id", F.lit(0)).alias("chunk_id"), "source", "crop", "disease", "evidence_type", "recommendation_preference", "organic_eligible", "ipm_eligible", "reranker_score", "vector_score", "bm25_score")


BLOCK = "'[EVIDENCE ' || i || ']' || chr(10) || 'knowledge_id: ' || knowledge_id || chr(10) || 'source: ' || source || chr(10) || 'crop: ' || crop || chr(10) || 'recommendation_preference: ' || recommendation_preference || chr(10) || 'content:' || chr(10) || content || chr(10) || '[/EVIDENCE ' || i || ']'"


@query("render_evidence", f"WITH {JUDGED}, ok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank) AS i FROM judged WHERE reason IS NULL) SELECT query_id, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY i) AS evidence FROM ok GROUP BY query_id")
def render_evidence(spark: SparkSession, sf: str) -> DataFrame:
    ok = judged(spark, sf).filter("reason IS NULL").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rerank")))
    block = policy.evidence_block(F.col("i").cast("string"), [(c, F.col(c)) for c in ("knowledge_id", "source", "crop", "recommendation_preference")], F.col("content"))
    # at most as many rows a query as re-ranking leaves
    return ok.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))).alias("bs")).select("query_id", F.array_join(F.col("bs.b"), "\n\n").alias("evidence"))


@query("knowledge_retrieve", f"WITH {STATUS}, acc AS (SELECT query_id, string_agg(knowledge_id, ',' ORDER BY rerank) AS accepted FROM judged WHERE reason IS NULL GROUP BY query_id) SELECT query_id, status, n_accepted, coalesce(accepted, '') AS accepted FROM status LEFT JOIN acc USING (query_id)")
def knowledge_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    j = judged(spark, sf)
    ids = F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("rerank", "knowledge_id"))))
    acc = j.groupBy("query_id").agg(ids.alias("a")).select("query_id", F.array_join(F.col("a.knowledge_id"), ",").alias("accepted"))
    return policy.status(j).join(acc, "query_id").select("query_id", "status", "n_accepted", "accepted")


@query("guardrail_block", "SELECT conv_id, turn, contains(text || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' I cannot comply with this.' ELSE '' END, 'I cannot comply') AS blocked FROM conversations")
def guardrail_block(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat("text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, " I cannot comply with this.").otherwise(""))
    return t.load(spark, sf, "conversations").select("conv_id", "turn", policy.blocked(answer).alias("blocked"))
