"""Queries of lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import text, vectors
from ..operators import dense, grounding, hybrid, lexical, nested, scopes, segments
from ..session import by_size, delete, temporary
from .registry import query

TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9]+(?:[_-][a-z0-9]+)*')"
POSTINGS = f"""toks AS (SELECT knowledge_id, {TOKENS.format("content")} AS tk FROM records), long AS (SELECT knowledge_id, len(tk) AS dl, unnest(tk) AS term FROM toks),
post AS (SELECT knowledge_id, term, count(*) AS tf, any_value(dl) AS dl FROM long GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stats AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM toks)"""
SCORES = f"""{POSTINGS}, qt AS (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM queries), qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
bm25 AS (SELECT query_id, knowledge_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-12)))), 6) AS score
  FROM post JOIN df USING (term) JOIN qc USING (term), stats GROUP BY query_id, knowledge_id)"""
UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_sum(list_transform({0}, lambda y: y * y))), 1e-12))"
COSINE = f"""{t.RECORD_VECTORS}, {t.QUERY_VECTORS}, qn AS (SELECT query_id, {UNIT.format("vector")} AS q FROM query_vectors), vn AS (SELECT vec_id, label, {UNIT.format("vector")} AS v FROM vecs),
rn AS (SELECT knowledge_id, {UNIT.format("vector")} AS v FROM record_vectors)"""
WITH_SCORES = f"WITH {t.RECORDS}, {t.QUERIES}, {SCORES}"
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {0}) AS rank"


@query("tokenize", f"WITH {t.RECORDS} SELECT knowledge_id, array_to_string({TOKENS.format('content')}, ' ') AS tokens FROM records")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return t.records(spark, sf).select("knowledge_id", F.array_join(text.tokens("content"), " ").alias("tokens"))


@query("ws_tokens", f"WITH {t.RECORDS} SELECT knowledge_id, len(list_filter(regexp_split_to_array(content, '[\\s\\x{{00A0}}]+'), lambda x: x <> '')) AS n_words FROM records")
def ws_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return t.records(spark, sf).select("knowledge_id", F.size(text.words("content")).cast("long").alias("n_words"))


@query("bm25_tf", f"WITH {t.RECORDS}, {POSTINGS} SELECT knowledge_id, term, tf, dl FROM post")
def bm25_tf(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(t.records(spark, sf), "knowledge_id", "content").select("knowledge_id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@query("bm25_df", f"WITH {t.RECORDS}, {POSTINGS} SELECT term, df FROM df")
def bm25_df(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(t.records(spark, sf), "knowledge_id", "content"))


@query("bm25_stats", f"WITH {t.RECORDS}, {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(t.records(spark, sf), "content").select("n", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_idf", f"WITH {t.RECORDS}, {POSTINGS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    r = t.records(spark, sf)
    df = lexical.document_frequency(lexical.postings(r, "knowledge_id", "content"))
    return df.join(F.broadcast(lexical.corpus_stats(r, "content"))).select("term", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.scores(t.records(spark, sf), t.queries(spark, sf), "knowledge_id", "content")


@query("bm25_scores", f"{WITH_SCORES} SELECT query_id, knowledge_id, score FROM bm25")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


@query("bm25_topk", f"{WITH_SCORES} SELECT query_id, knowledge_id, score, rank FROM (SELECT *, {TOP.format('knowledge_id')} FROM bm25) WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25_best(spark, sf, 5)[0]


def _bm25_best(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, segments.Work]:
    """The k best records of each query from a stored index, which is deleted when it has been searched, and the work done."""
    path = temporary(spark, "index")
    index = segments.Index(spark, path)
    index.add(t.records(spark, sf), "knowledge_id", "content")
    found = index.search(t.queries(spark, sf), k, key="knowledge_id")
    delete(spark, path)
    return found


@query("bm25_postings", f"{WITH_SCORES} SELECT query_id, sum(df)::BIGINT AS postings, true AS read_at_most_these FROM qc JOIN df USING (term) GROUP BY query_id")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Of each query the postings of its terms; those that the search read are among them."""
    work = _bm25_best(spark, sf, 5)[1].rows
    return work.select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("read_at_most_these"))


@query("bm25_work")
def bm25_work(spark: SparkSession, sf: str) -> DataFrame:
    """Of each query the postings that the search read and skipped; how many depends on how documents are dealt into blocks."""
    return _bm25_best(spark, sf, 5)[1].rows.select("query_id", "read", (F.col("postings") - F.col("read")).alias("skipped"))


CHILDREN = r"""tk AS (SELECT knowledge_id, list_filter(regexp_split_to_array(content, '[\s\x{00A0}]+'), lambda x: x <> '') AS tk FROM base),
parents AS (SELECT knowledge_id, s // 1400 AS parent, s AS parent_start, tk[s + 1:s + 1400] AS own FROM tk, unnest(range(0, len(tk), 1400)) u(s)),
kids AS (SELECT knowledge_id, parent, parent_start, parent_start + len(own) AS parent_end, c // 550 AS child, parent_start + c AS child_start, own[c + 1:c + 650] AS got FROM parents, unnest(range(0, (greatest(ceil((len(own) - 650) / 550.0), 0) * 550 + 1)::BIGINT, 550)) u(c)),
children AS (SELECT format('{:s}::chunk-{:04d}', knowledge_id, parent) AS parent_id, format('{:s}::chunk-{:04d}.{:02d}', knowledge_id, parent, child) AS child_id, parent_start, parent_end, child_start, child_start + len(got) AS child_end, array_to_string(got, ' ') AS content FROM kids)"""
NESTED = f"""WITH {t.RECORDS.replace("records AS", "base AS", 1)}, {CHILDREN}, records AS (SELECT child_id AS knowledge_id, content FROM children), {t.QUERIES}, {SCORES},
pool AS (SELECT query_id, knowledge_id AS child_id, score FROM (SELECT *, {TOP.format("knowledge_id")} FROM bm25) WHERE rank <= 40),
one AS (SELECT *, count(*) OVER (PARTITION BY query_id, parent_id) AS n_children, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, child_id) AS nth FROM pool JOIN children USING (child_id))
SELECT query_id, parent_id, child_id, score, parent_start, parent_end, child_start, child_end, n_children, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM one WHERE nth = 1) WHERE rank <= 5"""


@query("parent_child_search", NESTED)
def parent_child_search(spark: SparkSession, sf: str) -> DataFrame:
    """Five parents a query, found by its 40 best children."""
    path = temporary(spark, "index")
    children, index = nested.parents_and_children(t.records(spark, sf)), segments.Index(spark, path)
    index.add(children, "child_id", "content")
    hits = index.search(t.queries(spark, sf), 40, key="child_id")[0]
    delete(spark, path)
    longs = [F.col(c).cast("long").alias(c) for c in ("parent_start", "parent_end", "child_start", "child_end")]
    return nested.best_parents(hits, children, 5).select("query_id", "parent_id", "child_id", "score", *longs, "n_children", "rank")


SUPPORT = f"""{WITH_SCORES}, pairs AS (SELECT query_id, knowledge_id, rank FROM (SELECT *, {TOP.format("knowledge_id")} FROM bm25) WHERE rank <= 5),
sent AS (SELECT query_id, unnest(regexp_split_to_array(query, '[.!?]+\\s+|\\n+')) AS sentence, generate_subscripts(regexp_split_to_array(query, '[.!?]+\\s+|\\n+'), 1) AS s FROM queries),
st AS (SELECT query_id, s, {TOKENS.format("sentence")} AS tk FROM sent), sz AS (SELECT *, len(tk) AS size, least(len(tk), 4) AS n FROM st WHERE len(tk) > 0),
sr AS (SELECT query_id, s, size, n, i AS at_, array_to_string(tk[i + 1:i + n], ' ') AS run FROM sz, unnest(range(0, size - n + 1)) u(i)),
cr AS (SELECT DISTINCT knowledge_id, array_to_string(tk[i + 1:i + k], ' ') AS run FROM (SELECT * FROM toks WHERE knowledge_id IN (SELECT knowledge_id FROM pairs)), (VALUES (1), (2), (3), (4)) v(k), unnest(range(0, greatest(len(tk) - k + 1, 0))) u(i)),
met AS (SELECT sr.*, knowledge_id, rank FROM sr JOIN pairs USING (query_id) JOIN cr USING (knowledge_id, run)), spot AS (SELECT DISTINCT query_id, s, size, knowledge_id, rank, p FROM met, unnest(range(at_, at_ + n)) u(p)),
whole AS (SELECT query_id, count(*) AS n_supported FROM (SELECT query_id, s FROM spot GROUP BY query_id, s HAVING count(DISTINCT p) * 2 >= any_value(size)) GROUP BY query_id),
each_ AS (SELECT DISTINCT query_id, rank FROM (SELECT query_id, s, knowledge_id, rank FROM spot GROUP BY ALL HAVING count(*) * 2 >= any_value(size))),
prec AS (SELECT query_id, avg(so_far / rank) AS context_precision FROM (SELECT query_id, rank, count(*) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM each_) GROUP BY query_id)
SELECT query_id, count(*) AS n_sentences, coalesce(any_value(n_supported), 0) AS n_supported, round(coalesce(any_value(n_supported), 0) / count(*), 6) AS context_recall, round(coalesce(any_value(context_precision), 0), 6) AS context_precision
FROM sz LEFT JOIN whole USING (query_id) LEFT JOIN prec USING (query_id) GROUP BY query_id"""


@query("answer_support", SUPPORT)
def answer_support(spark: SparkSession, sf: str) -> DataFrame:
    """How far each benchmark text, as an answer, rests on the five records found for it."""
    answers, r = t.queries(spark, sf), t.records(spark, sf)
    pairs = _bm25_best(spark, sf, 5)[0]
    out = grounding.support(answers.select("query_id", F.col("query").alias("text")), pairs, r.select("knowledge_id", F.col("content").alias("text")), "query_id", "knowledge_id")
    return out.select("query_id", "n_sentences", "n_supported", F.round("context_recall", 6).alias("context_recall"), F.round("context_precision", 6).alias("context_precision"))


ENTITIES = "regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*|[0-9]+(?:[.,][0-9]+)*')"


@query(
    "entity_recall",
    f"""WITH e AS (SELECT conv_id, turn, role, unnest({ENTITIES}) AS entity FROM conversations), a AS (SELECT DISTINCT conv_id, turn, entity FROM e WHERE role = 'assistant'), c AS (SELECT DISTINCT conv_id, entity FROM e WHERE role <> 'assistant')
SELECT a.conv_id || ':' || a.turn AS answer_id, count(*) AS n_entities, count(c.entity) AS n_found, round(count(c.entity) / count(*), 6) AS entity_recall FROM a LEFT JOIN c ON c.conv_id = a.conv_id AND c.entity = a.entity GROUP BY a.conv_id, a.turn""",
)
def entity_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of each assistant turn's entities, those that the conversation's other roles name."""
    c = t.load(spark, sf, "conversations")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id")
    answers = c.filter("role = 'assistant'").select("conv_id", name, "text")
    others = c.filter("role <> 'assistant'").select("conv_id", "text").join(answers.select("conv_id", "answer_id").distinct(), "conv_id").select("answer_id", "text")
    return grounding.entity_recall(answers, others).withColumn("entity_recall", F.round("entity_recall", 6))


TREE = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
above AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT above.node, nodes.parent, distance + 1 FROM above JOIN nodes ON nodes.node = ancestor WHERE nodes.parent IS NOT NULL),
own AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS nth, count(*) OVER () AS total FROM supplier)"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in nations in regions, as (node, parent)."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = t.load(spark, sf, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = t.load(spark, sf, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    return r.unionByName(n).unionByName(t.load(spark, sf, "supplier").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent")))


@query("scope_closure", f"WITH RECURSIVE {TREE} SELECT node, ancestor, distance FROM above")
def scope_closure(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.closure(_tree(spark, sf))


@query(
    "scope_widened",
    f"""WITH RECURSIVE {TREE}, {t.RECORDS}, {t.QUERIES}, {SCORES}, at_doc AS (SELECT knowledge_id, 's' || s_suppkey AS node FROM records JOIN own ON nth = doc_id % total), at_query AS (SELECT query_id, 's' || s_suppkey AS node FROM queries JOIN own ON nth = query_id % total),
wanted AS (SELECT query_id, b.node, min(a.distance) AS level FROM at_query q JOIN above a ON a.node = q.node JOIN above b ON b.ancestor = a.ancestor GROUP BY query_id, b.node),
met AS (SELECT bm25.query_id, knowledge_id, score, level FROM bm25 JOIN at_doc USING (knowledge_id) LEFT JOIN wanted ON wanted.query_id = bm25.query_id AND wanted.node = at_doc.node),
reach AS (SELECT query_id, min(level) AS reach FROM (SELECT query_id, level, sum(count(*)) OVER (PARTITION BY query_id ORDER BY level) AS so_far FROM met WHERE level IS NOT NULL GROUP BY query_id, level) WHERE so_far >= 5 GROUP BY query_id),
kept AS (SELECT met.*, reach FROM met LEFT JOIN reach USING (query_id) WHERE reach IS NULL OR level <= reach)
SELECT query_id, knowledge_id, score, level, reach, rank FROM (SELECT *, {TOP.format("knowledge_id")} FROM kept) WHERE rank <= 5""",
)
def scope_widened(spark: SparkSession, sf: str) -> DataFrame:
    """Five records a query from its supplier, or from its nation or region, if the supplier's that match are fewer."""
    own = t.load(spark, sf, "supplier").select("s_suppkey")
    nth = own.withColumn("nth", F.row_number().over(Window.orderBy("s_suppkey")) - 1)  # places of the fixture, two longs a supplier
    total = nth.count()
    place = lambda key: F.pmod(F.col(key), F.lit(total)).cast("long").alias("nth")
    at = by_size(nth.select(F.col("nth").cast("long").alias("nth"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")))
    docs = t.records(spark, sf).select("knowledge_id", place("doc_id")).join(at, "nth").select("knowledge_id", "node")
    asked = t.queries(spark, sf).select("query_id", place("query_id")).join(at, "nth").select("query_id", "node")
    return scopes.widened(_bm25(spark, sf).join(docs, "knowledge_id"), asked, scopes.closure(_tree(spark, sf)), 5)


LAST_STATE = f"""{t.RECORDS.replace("records AS", "base AS", 1)},
records AS (SELECT knowledge_id, CASE WHEN doc_id % 3 <> 2 AND doc_id % 7 = 0 THEN 'revised ' || crop || ' ' || content ELSE content END AS content FROM base WHERE doc_id % 3 = 2 OR doc_id % 11 <> 0)"""
LAST_SCORES = f"WITH {LAST_STATE}, {t.QUERIES}, {SCORES}"


def _changed_index(spark: SparkSession, sf: str) -> tuple[segments.Index, str]:
    """An index that got two thirds of the records, then changed ones, then deletes, then the last third (changed ones anew)."""
    path, r = temporary(spark, "index"), t.records(spark, sf)
    index = segments.Index(spark, path)
    index.add(r.filter("doc_id % 3 <> 2"), "knowledge_id", "content")
    index.add(r.filter("doc_id % 7 = 0").withColumn("content", F.concat(F.lit("revised "), "crop", F.lit(" "), "content")), "knowledge_id", "content", replace=True)
    index.delete(r.filter("doc_id % 11 = 0").select("knowledge_id"))
    index.add(r.filter("doc_id % 3 = 2"), "knowledge_id", "content", replace=True)
    return index, path


@query("bm25_segments", f"{LAST_SCORES} SELECT query_id, knowledge_id, score, rank FROM (SELECT *, {TOP.format('knowledge_id')} FROM bm25) WHERE rank <= 5")
def bm25_segments(spark: SparkSession, sf: str) -> DataFrame:
    index, path = _changed_index(spark, sf)
    out = index.search(t.queries(spark, sf), 5, key="knowledge_id")[0]
    delete(spark, path)
    return out


@query("bm25_segments_df", f"WITH {LAST_STATE}, {POSTINGS} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM df, stats")
def bm25_segments_df(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies by subtraction. The index stays until the application ends, since the result reads it."""
    index, _ = _changed_index(spark, sf)
    return index.frequency().join(F.broadcast(index.stats())).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


@query("bm25_merged", f"{LAST_SCORES} SELECT query_id, knowledge_id, score, rank FROM (SELECT *, {TOP.format('knowledge_id')} FROM bm25) WHERE rank <= 5")
def bm25_merged(spark: SparkSession, sf: str) -> DataFrame:
    index, path = _changed_index(spark, sf)
    index.merge()
    out = index.search(t.queries(spark, sf), 5, key="knowledge_id")[0]
    delete(spark, path)
    return out


@query("bm25_incremental", f"WITH {t.RECORDS}, {POSTINGS} SELECT term, df FROM df")
def bm25_incremental(spark: SparkSession, sf: str) -> DataFrame:
    r = t.records(spark, sf)
    parts = [lexical.document_frequency(lexical.postings(r.filter(F.col("doc_id") % 2 == k), "knowledge_id", "content")) for k in (0, 1)]
    return lexical.merge_index(*parts)


@query("vector_topk", f"WITH {COSINE}, s AS (SELECT query_id, vec_id, round(list_dot_product(v, q), 6) AS score FROM vn, qn) SELECT query_id, vec_id, score, rank FROM (SELECT *, {TOP.format('vec_id')} FROM s) WHERE rank <= 5")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.vector_top(t.vectors(spark, sf), t.query_vectors(spark, sf), "vec_id", 5)


@query(
    "vector_filtered",
    f"""WITH {t.RECORDS}, {t.QUERIES}, {COSINE}, s AS (SELECT query_id, knowledge_id, round(list_dot_product(v, q), 6) AS score FROM rn, qn), pool AS (SELECT * FROM (SELECT *, {TOP.format("knowledge_id")} FROM s) WHERE rank <= 25),
hit AS (SELECT query_id, knowledge_id, score FROM pool JOIN records USING (knowledge_id) JOIN queries USING (query_id) WHERE CASE preference WHEN 'Organic' THEN organic_eligible WHEN 'IPM' THEN ipm_eligible ELSE true END AND evidence_type = 'treatment')
SELECT query_id, knowledge_id, score, rank FROM (SELECT *, {TOP.format("knowledge_id")} FROM hit) WHERE rank <= 5""",
)
def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    pool = dense.vector_top(t.record_vectors(spark, sf), t.query_vectors(spark, sf), "knowledge_id", 25).drop("rank")
    hits = pool.join(t.records(spark, sf).drop("content"), "knowledge_id").join(by_size(t.queries(spark, sf).select("query_id", "preference")), "query_id")
    hits = hits.filter(hybrid.eligible("preference") & (F.col("evidence_type") == "treatment")).select("query_id", "knowledge_id", "score")
    return lexical.top(hits, "query_id", "score", "knowledge_id", 5)


CANDIDATES = f"""{t.RECORDS}, {t.QUERIES}, {SCORES}, {COSINE}, vs AS (SELECT query_id, knowledge_id, round(list_dot_product(v, q), 6) AS score FROM rn, qn),
vt AS (SELECT * FROM (SELECT *, {TOP.format("knowledge_id")} FROM vs) WHERE rank <= 40), bt AS (SELECT * FROM (SELECT *, {TOP.format("knowledge_id")} FROM bm25) WHERE rank <= 40),
merged AS (SELECT query_id, knowledge_id, vt.rank AS vector_rank, bt.rank AS bm25_rank, coalesce(vt.score, 0.0) AS vector_score, coalesce(bt.score, 0.0) AS bm25_score FROM vt FULL OUTER JOIN bt USING (query_id, knowledge_id)),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS rrf_score FROM merged)"""
PREFERENCE = """CASE preference WHEN 'Organic' THEN CASE WHEN recommendation_preference = 'Organic' THEN 1.0 WHEN recommendation_preference = 'General' AND organic_eligible THEN 0.5 ELSE 0.0 END
  WHEN 'IPM' THEN CASE WHEN recommendation_preference = 'IPM' THEN 1.0 WHEN recommendation_preference = 'General' AND ipm_eligible THEN 0.5 ELSE 0.0 END ELSE CASE WHEN recommendation_preference = 'General' THEN 1.0 ELSE 0.8 END END::DOUBLE"""
ELIGIBLE = "CASE preference WHEN 'Organic' THEN organic_eligible WHEN 'IPM' THEN ipm_eligible ELSE true END"
HYBRID = f"""{CANDIDATES}, found AS (SELECT f.*, {PREFERENCE} AS preference_score FROM fused f JOIN records USING (knowledge_id) JOIN queries USING (query_id) WHERE {ELIGIBLE}),
final AS (SELECT *, round(rrf_score + 0.05 * preference_score, 6) AS final_score FROM found),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, knowledge_id) AS rank FROM final) WHERE rank <= 8)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    v = dense.vector_top(t.record_vectors(spark, sf), t.query_vectors(spark, sf), "knowledge_id", 40)
    return hybrid.merge(v, _bm25_best(spark, sf, 40)[0], "knowledge_id")


def hybrid_hits(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.search(merged(spark, sf), t.records(spark, sf), t.queries(spark, sf).select("query_id", "preference"), "knowledge_id")


@query("hybrid_merge", f"WITH {CANDIDATES} SELECT query_id, knowledge_id, vector_rank, bm25_rank, vector_score, bm25_score FROM merged")
def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("query_id", "knowledge_id", F.col("vector_rank").cast("long"), F.col("bm25_rank").cast("long"), "vector_score", "bm25_score")


@query("hybrid_rrf", f"WITH {CANDIDATES} SELECT query_id, knowledge_id, round(rrf_score, 6) AS rrf_score FROM fused")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("query_id", "knowledge_id", F.round(hybrid.rrf("vector_rank", "bm25_rank"), 6).alias("rrf_score"))


@query("hybrid_search", f"WITH {HYBRID} SELECT query_id, knowledge_id, rank, final_score, preference_score, vector_rank, bm25_rank FROM hybrid")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_hits(spark, sf).select("query_id", "knowledge_id", F.col("rank").cast("long").alias("rank"), "final_score", "preference_score", F.col("vector_rank").cast("long"), F.col("bm25_rank").cast("long"))


@query("preference_score", f"WITH {t.RECORDS}, want AS (SELECT unnest(['Organic', 'IPM', 'General']) AS preference) SELECT knowledge_id, preference, {PREFERENCE} AS preference_score FROM records, want")
def preference_score(spark: SparkSession, sf: str) -> DataFrame:
    want = F.explode(F.array(*map(F.lit, hybrid.PREFERENCES))).alias("preference")
    return t.records(spark, sf).select("*", want).select("knowledge_id", "preference", hybrid.preference_score("preference").alias("preference_score"))


@query("eligibility_filter", f"WITH {t.RECORDS}, want AS (SELECT unnest(['Organic', 'IPM', 'General']) AS preference) SELECT knowledge_id, preference FROM records, want WHERE {ELIGIBLE} AND evidence_type = 'treatment' AND lower(crop) = lower('EN')")
def eligibility_filter(spark: SparkSession, sf: str) -> DataFrame:
    want = F.explode(F.array(*map(F.lit, hybrid.PREFERENCES))).alias("preference")
    r = t.records(spark, sf).filter((F.col("evidence_type") == "treatment") & (F.lower("crop") == F.lower(F.lit("EN"))))
    return r.select("*", want).filter(hybrid.eligible("preference")).select("knowledge_id", "preference")


@query("recommendation_search", f"WITH {t.RECORDS}, {t.QUERIES}, {COSINE} SELECT query_id, knowledge_id, round(list_dot_product(v, q), 6) AS score FROM rn JOIN records USING (knowledge_id), qn JOIN queries USING (query_id) WHERE lower(trim(crop)) = lower(trim(want_crop))")
def recommendation_search(spark: SparkSession, sf: str) -> DataFrame:
    crops = t.records(spark, sf).select("knowledge_id", text.lookup_label("crop").alias("c"))
    wanted = t.queries(spark, sf).select("query_id", text.lookup_label("want_crop").alias("c"))
    v = t.record_vectors(spark, sf).join(crops, "knowledge_id")
    q = t.query_vectors(spark, sf).join(wanted, "query_id")
    return dense.pair_scores(v, q, "knowledge_id", "c").select("query_id", "knowledge_id", F.round("score", 6).alias("score"))


@query("normalized_lookup", f"WITH {t.RECORDS}, {t.QUERIES} SELECT query_id, count(*) AS n FROM records JOIN queries ON lower(trim(crop)) = lower(trim(want_crop)) GROUP BY query_id")
def normalized_lookup(spark: SparkSession, sf: str) -> DataFrame:
    r = t.records(spark, sf).groupBy(text.lookup_label("crop").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return t.queries(spark, sf).select("query_id", text.lookup_label("want_crop").alias("c")).join(r, "c").select("query_id", "n")


@query("mean_pool", "WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, pos, round(avg(v::DOUBLE), 6) AS mean FROM x GROUP BY label, pos")
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    x = t.vectors(spark, sf).select("label", F.posexplode("vector").alias("p", "v"))
    return x.groupBy("label", (F.col("p") + 1).cast("long").alias("pos")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query("softmax_prob", f"WITH {t.RECORD_VECTORS}, m AS (SELECT vec_id, vector, list_max(vector) AS top FROM vecs), e AS (SELECT vec_id, list_transform(vector, lambda x: exp(x - top)) AS ex FROM m) SELECT vec_id, round(list_max(ex) / list_sum(ex), 6) AS p_max FROM e")
def softmax_prob(spark: SparkSession, sf: str) -> DataFrame:
    return t.vectors(spark, sf).select("vec_id", F.round(F.array_max(vectors.softmax("vector")), 6).alias("p_max"))


@query("l2_normalize", f"WITH {t.RECORD_VECTORS}, n AS (SELECT vec_id, {UNIT.format('vector')} AS u FROM vecs) SELECT vec_id, round(u[1], 6) AS first, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm FROM n")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    u = t.vectors(spark, sf).select("vec_id", vectors.normalized("vector").alias("u"))
    return u.select("vec_id", F.round(F.get("u", 0), 6).alias("first"), F.round(vectors.norm("u"), 6).alias("norm"))


@query("norm_range", f"WITH {t.RECORD_VECTORS}, n AS (SELECT sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS norm FROM vecs) SELECT round(min(norm), 6) AS low, round(max(norm), 6) AS high FROM n")
def norm_range(spark: SparkSession, sf: str) -> DataFrame:
    n = t.vectors(spark, sf).select(vectors.norm("vector").alias("norm"))
    return n.agg(F.round(F.min("norm"), 6).alias("low"), F.round(F.max("norm"), 6).alias("high"))


BROKEN = {3: "CAST('NaN' AS DOUBLE)", 5: "CAST('Infinity' AS DOUBLE)", 7: "CAST(NULL AS DOUBLE)"}


@query(
    "nonfinite_vectors",
    f"""SELECT vec_id FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0.05 THEN x {" ".join(f"WHEN vec_id % 11 = {k} THEN {v}" for k, v in BROKEN.items())} ELSE x END) AS e FROM embeddings)
WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0""",
)
def nonfinite_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings whose larger components are broken in some rows."""
    broken = F.expr(f"transform(vector, x -> CASE WHEN x < 0.05 THEN x {' '.join(f'WHEN vec_id % 11 = {k} THEN {v}' for k, v in BROKEN.items())} ELSE x END)")
    return t.vectors(spark, sf).withColumn("vector", broken).filter(~vectors.finite("vector")).select("vec_id")


@query(
    "eval_retrieval_at_k",
    f"WITH {t.RECORD_VECTORS}, n AS (SELECT vec_id, label, {UNIT.format('vector')} AS v FROM vecs), s AS (SELECT a.vec_id, a.label, b.label AS other, round(list_dot_product(a.v, b.v), 6) AS score, b.vec_id AS oid FROM n a, n b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, oid) AS k FROM s) SELECT label, round(avg((label = other)::INT), 6) AS precision_at_5 FROM r WHERE k <= 5 GROUP BY label",
)
def eval_retrieval_at_k(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours(spark, sf).filter("k <= 5")
    return near.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("precision_at_5"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with every other, ranked: a stated query set against all rows."""
    v = t.vectors(spark, sf)
    near = dense.vector_top(v, v.withColumnRenamed("vec_id", "query_id"), "vec_id", 5, others=True).withColumnRenamed("rank", "k")
    labels = v.select("vec_id", "label")
    return near.join(labels.withColumnsRenamed({"vec_id": "query_id"}), "query_id").join(labels.withColumnRenamed("label", "other"), "vec_id")
