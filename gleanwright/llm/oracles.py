"""DuckDB SQL for the queries of this folder that SQL can tell."""

from __future__ import annotations

from .licenses import ENDS, KEYS, LABELLED, LOWER, RULES, SENTENCES, TAG, TAGGED, rule_pattern

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licence_sql() -> str:
    low = f"translate(s, {q(LOWER[0])}, {q(LOWER[1])})"
    words = f"trim(regexp_replace(regexp_replace({low}, '[^a-z0-9.+]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'))"
    norm = f"CASE WHEN regexp_extract({low}, {q(TAG)}, 1) <> '' THEN 'spdx license identifier ' || regexp_extract({low}, {q(TAG)}, 1) ELSE {words} END"
    ident = f"CASE WHEN regexp_matches(n, {q(SENTENCES[0][1])}) THEN 'SPDX=' || regexp_extract(n, {q(SENTENCES[0][1])}, 1)"
    for name, phrase in SENTENCES[1:]:
        found = f"regexp_replace('{name}=' || regexp_extract(n, {q(phrase)}, 1), '=$', '')" if "([0-9" in phrase else f"'{name}'"
        ident += f" WHEN regexp_matches(n, {q(phrase)}) THEN {found}"
    ident += " END"
    named = "joined"
    for name, sequence in RULES:
        named = f"regexp_replace({named}, {q(rule_pattern(sequence))}, {q('<' + name.replace('[v]', chr(92) + '1') + '>')}, 'g')"
    named = f"regexp_replace(regexp_replace({named}, '\\|[^|<>]*\\|', '<UNKNOWN>', 'g'), '-?>', '>', 'g')"
    gap = "chr(10) || chr(10)"
    tagged = f"regexp_replace(regexp_replace(text, {q(LABELLED)}, 'spdx-license-identifier: \\1', 'g'), {q(TAGGED)}, {gap} || 'spdx-license-identifier=\\1' || {gap}, 'g')"
    return f"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace({tagged}, {q(ENDS)}, chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace({tagged}, {q(ENDS)}, chr(1), 'g'), chr(1)), 1) AS k FROM documents),
n AS (SELECT doc_id, k, {norm} AS n FROM s), i AS (SELECT doc_id, k, {ident} AS id FROM n WHERE regexp_matches(n, {q(KEYS)})),
g AS (SELECT doc_id, count(*) AS c, string_agg(id, ',' ORDER BY k) AS ids, string_agg('|' || id || '|', '' ORDER BY k) AS joined FROM i WHERE id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, coalesce(c, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(regexp_extract_all({named}, '<([^>]*)>', 1), ','), '') AS licenses FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""


LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), m AS (SELECT doc_id, pos, trim(raw) AS line FROM l WHERE length(trim(raw)) >= 1),
f AS (SELECT line, min(doc_id * 2147483648::HUGEINT + pos) AS place FROM m GROUP BY line),
k AS (SELECT place, hash(n, i, left(line, i - 1) || chr(1) || substr(line, i + 1)) AS key FROM (SELECT place, line, length(line) AS n, unnest(range(1, length(line) + 1)) AS i FROM f)
  UNION ALL SELECT place, hash(n + 1, i, left(line, i - 1) || chr(1) || substr(line, i)) AS key FROM (SELECT place, line, length(line) AS n, unnest(range(1, length(line) + 2)) AS i FROM f)),
low AS (SELECT key, min(place) AS first FROM k GROUP BY key HAVING min(place) < max(place)), near AS (SELECT DISTINCT place FROM k JOIN low USING (key) WHERE place > first),
gone AS (SELECT m.doc_id, m.pos FROM m JOIN f USING (line) WHERE m.doc_id * 2147483648::HUGEINT + m.pos <> f.place OR f.place IN (SELECT place FROM near)),
left_ AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_removed FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(left_.text, '') END AS text FROM documents d LEFT JOIN left_ ON left_.doc_id = d.doc_id"""

REACH = "reach AS (SELECT id, id AS seen FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.seen), comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LOWER[0]}', '{LOWER[1]}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
edge AS (SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN comp ON comp.id = d.doc_id"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {FINITE} AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v), edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}
SELECT d.vec_id, (SELECT count(*) FROM edge WHERE a = d.vec_id) AS n_links, component_id, d.vec_id = component_id AS kept FROM embeddings d JOIN comp ON comp.id = d.vec_id"""

TOP = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {FINITE}),
s AS (SELECT x.vec_id AS query_id, y.vec_id, list_dot_product(x.e, y.e)::BIGINT AS score FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE x.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: The tampered rows' CRC-32 is a fold over digits and bits; levels of a tree, and the way of each leaf up, are recursions.
MERKLE = """WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
e AS (SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other FROM d),
l AS (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS m, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM e),
low AS (SELECT grp, 0 AS k, idx, m, leaf AS h FROM l UNION ALL SELECT grp, any_value(k) + 1, idx // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE m > 1 GROUP BY grp, idx // 2),
roots AS (SELECT grp, h FROM low WHERE m = 1), g AS (SELECT count(*) AS m FROM roots),
top AS (SELECT 0 AS k, grp AS idx, g.m, h FROM roots, g UNION ALL SELECT any_value(k) + 1, idx // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE m > 1 GROUP BY idx // 2),
up AS (SELECT grp, idx, 0 AS part, k, h FROM low UNION ALL SELECT NULL, idx, 1, k, h FROM top),
climb AS (SELECT doc_id, grp, idx AS start, idx AS at, 0 AS part, 0 AS k, m, other AS own, leaf, '' AS proof FROM l
  UNION ALL SELECT c.doc_id, c.grp, c.start, CASE WHEN c.m = 1 THEN c.grp ELSE c.at // 2 END, CASE WHEN c.m = 1 THEN 1 ELSE c.part END, CASE WHEN c.m = 1 THEN 0 ELSE c.k + 1 END, CASE WHEN c.m = 1 THEN g.m ELSE (c.m + 1) // 2 END,
    CASE WHEN c.m = 1 THEN c.own ELSE sha256(CASE WHEN c.at % 2 = 1 THEN s.h || c.own ELSE c.own || coalesce(s.h, '') END) END, c.leaf, c.proof || CASE WHEN c.m = 1 THEN '' ELSE coalesce(s.h, '') END
    FROM climb c CROSS JOIN g LEFT JOIN up s ON s.part = c.part AND (s.grp = c.grp OR c.part = 1) AND s.k = c.k AND s.idx = xor(c.at, 1) WHERE c.m > 1 OR c.part = 0),
root AS (SELECT h FROM top WHERE m = 1)
SELECT c.doc_id, c.leaf, r.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.own AS folded_root, c.own = root.h AS verified FROM climb c JOIN roots r ON r.grp = c.grp CROSS JOIN root WHERE c.part = 1 AND c.m = 1"""

ORACLES = {"op1_license_scan": _licence_sql(), "op5_line_dedup": LINES, "op8_minhash_dedup": NEAR, "op9_embedding_dedup": VECTORS, "op10_exact_topk": TOP, "op13_merkle_manifest": MERKLE}
