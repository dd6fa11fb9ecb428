"""Queries of label curation, splitting and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as t
from ..functions import labels, text
from ..operators import curation
from ..session import by_size
from .registry import query

N = f"WITH {t.NAMES}"
CAP = "upper({0}[1]) || lower(substr({0}, 2))"


@query(
    "folder_labels",
    f"{N} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {CAP.format('colour')} WHEN 1 THEN {CAP.format('colour')} ELSE 'Unknown' END AS crop, CASE p_partkey % 4 WHEN 0 THEN noun WHEN 1 THEN noun WHEN 2 THEN folder ELSE 'healthy' END AS disease, CASE p_partkey % 4 WHEN 3 THEN 'Healthy' ELSE 'Diseased' END AS health_status FROM names",
)
def folder_labels(spark: SparkSession, sf: str) -> DataFrame:
    return t.names(spark, sf).select("p_partkey", labels.folder_label("folder").alias("f")).select("p_partkey", "f.*")


#: A label mapping over the nouns and colours that name parts: ord, crop, canonical, alias.
def mapping_rows(names: DataFrame) -> DataFrame:
    """Every noun as a crop, with its colours as conditions and one more alias of each."""
    m = names.select("noun", "colour").distinct()
    alias = F.explode(F.array(F.col("colour"), F.concat("colour", F.lit("-spot")))).alias("alias")
    return m.select(F.lower("noun").alias("crop"), F.col("colour").alias("canonical"), alias).withColumn("ord", F.concat_ws("|", "crop", "canonical", "alias"))


MAPPING = "mapping AS (SELECT DISTINCT lower(noun) AS crop, colour AS canonical, unnest([colour, colour || '-spot']) AS alias FROM names), maps AS (SELECT crop || '|' || canonical || '|' || alias AS ord, crop AS mc, canonical AS mcan, trim(replace(replace(lower(alias), '-', '_'), ' ', '_'), ' _') AS a FROM mapping)"


@query(
    "normalize_labels",
    f"""{N}, {MAPPING}, given AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN noun WHEN 1 THEN colour ELSE 'Unknown' END AS crop, CASE p_partkey % 4 WHEN 3 THEN 'healthy' WHEN 2 THEN 'leaf_' || noun || ' ' || colour ELSE colour || '_Spot_' END AS disease FROM names),
k AS (SELECT crop, disease, lower(trim(crop)) AS c, trim(replace(replace(lower(disease), '-', '_'), ' ', '_'), ' _') AS d FROM given), kk AS (SELECT *, trim(c || '_' || d, '_') AS both_ FROM k),
hit AS (SELECT crop, disease, CASE WHEN mc = c AND (d = a OR (length(a) > 4 AND contains(d, a)) OR (length(d) > 4 AND contains(a, d))) THEN 0 WHEN a = both_ AND both_ <> 'unknown' THEN 1 WHEN a = d AND d <> 'unknown' THEN 2 WHEN a = c AND c <> 'unknown' THEN 3
  WHEN (length(a) >= 4 AND (contains(both_, a) OR contains(d, a) OR contains(c, a))) OR (length(both_) > 5 AND contains(a, both_)) THEN 4 END AS s, ord, mc, mcan FROM kk, maps),
best AS (SELECT crop, disease, s, mc, mcan FROM (SELECT *, row_number() OVER (PARTITION BY crop, disease ORDER BY s, ord) AS n FROM hit WHERE s IS NOT NULL) WHERE n = 1),
r AS (SELECT kk.crop, kk.disease, c, d, s, mc, mcan, trim(replace(replace(d, 'leaf_', ''), '_leaf', ''), ' _') AS rest FROM kk LEFT JOIN best USING (crop, disease)), cc AS (SELECT *, CASE WHEN contains(d, 'healthy') OR s IS NULL OR s = 0 THEN c ELSE mc END AS nc FROM r)
SELECT crop, disease, {CAP.format("nc")} AS norm_crop, CASE WHEN contains(d, 'healthy') THEN 'healthy' WHEN s IS NOT NULL THEN mcan WHEN rest NOT IN ('', 'unknown') THEN rest ELSE 'UNKNOWN' END AS norm_disease FROM cc""",
)
def normalize_labels(spark: SparkSession, sf: str) -> DataFrame:
    n, k = t.names(spark, sf), F.col("p_partkey") % 4
    given = n.select(
        F.when(k == 0, F.col("noun")).when(k == 1, F.col("colour")).otherwise("Unknown").alias("crop"),
        F.when(k == 3, "healthy").when(k == 2, F.concat(F.lit("leaf_"), "noun", F.lit(" "), "colour")).otherwise(F.concat("colour", F.lit("_Spot_"))).alias("disease"),
    ).distinct()
    return curation.normalize_labels(given, mapping_rows(n))


@query("dict_normalize", f"{N} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'apple_scab' WHEN 1 THEN 'spider_mites' WHEN 2 THEN 'UNKNOWN' ELSE lower(colour) END AS condition, CASE p_partkey % 4 WHEN 0 THEN 'Soybean' WHEN 1 THEN 'Unknown' ELSE noun END AS crop FROM names")
def dict_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    condition = F.when(k == 0, " Scab").when(k == 1, "Two_Spotted_Spider_Mites").when(k == 2, "").otherwise(F.upper("colour"))
    crop = F.when(k == 0, "Soyabean").when(k == 1, F.lit(None).cast("string")).otherwise(F.col("noun"))
    return t.names(spark, sf).select("p_partkey", labels.dictionary_condition(condition).alias("condition"), labels.dictionary_crop(crop).alias("crop"))


@query("class_dir_name", "SELECT n_nationkey, replace(n_name, ' ', '_') || '___' || CASE WHEN n_nationkey % 3 = 0 THEN 'healthy' ELSE replace(r_name, ' ', '_') END AS folder FROM nation JOIN region ON n_regionkey = r_regionkey")
def class_dir_name(spark: SparkSession, sf: str) -> DataFrame:
    n = t.load(spark, sf, "nation").join(by_size(t.load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", labels.class_folder("n_name", F.col("n_nationkey") % 3 == 0, "r_name", F.lit("")).alias("folder"))


@query(
    "class_match",
    f"{N}, f AS (SELECT DISTINCT folder FROM names), g AS (SELECT DISTINCT noun AS target FROM names), h AS (SELECT target, folder, row_number() OVER (PARTITION BY target ORDER BY (folder <> target)::INT, folder) AS n FROM g, f WHERE folder = target OR contains(lower(folder), lower(target)) OR contains(lower(target), lower(folder))) SELECT target, folder FROM h WHERE n = 1",
)
def class_match(spark: SparkSession, sf: str) -> DataFrame:
    n = t.names(spark, sf)
    return curation.class_folders(n.select(F.col("noun").alias("target")), n.select("folder"))


@query("coalesce_fields", f"{N} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN colour WHEN 1 THEN noun ELSE 'Unknown' END AS crop, CASE p_partkey % 2 WHEN 0 THEN folder ELSE 'unknown' END AS disease FROM names")
def coalesce_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    n = t.names(spark, sf).select("p_partkey", F.when(k % 3 == 0, F.col("colour")).otherwise("").alias("crop"), F.when(k % 3 == 1, F.col("noun")).alias("plant"), F.when(k % 2 == 0, F.col("folder")).otherwise("").alias("label"))
    return n.select("p_partkey", text.coalesce_blank("crop", "plant", default="Unknown").alias("crop"), text.coalesce_blank("label", default="unknown").alias("disease"))


@query("resolve_path", f"{N} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || folder ELSE '/workspace/' || folder END AS path FROM names")
def resolve_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/abs/").otherwise(""), "folder")
    return t.names(spark, sf).select("p_partkey", text.resolve_path(path, "/workspace/").alias("path"))


@query("semi_existing", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def semi_existing(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "part").select("p_partkey", "p_name").join(t.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


UNIQUE = "u AS (SELECT l_partkey, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN min(l_suppkey) END AS l_suppkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)"


@query("repair_unique_map", f"WITH {UNIQUE} SELECT l_partkey, l_suppkey, n FROM u")
def repair_unique_map(spark: SparkSession, sf: str) -> DataFrame:
    return curation.unique_map(t.load(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("repair_labels", f"WITH {UNIQUE} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN coalesce(l_suppkey::VARCHAR, 'Unknown') ELSE p_brand END AS label FROM part LEFT JOIN u ON p_partkey = l_partkey")
def repair_labels(spark: SparkSession, sf: str) -> DataFrame:
    fixes = curation.unique_map(t.load(spark, sf, "lineitem"), "l_partkey", "l_suppkey").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("label"))
    rows = t.load(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "Unknown").otherwise(F.col("p_brand")).alias("label"))
    return curation.repair(rows, fixes, "p_partkey", "label", F.col("label") == "Unknown")


@query("unmapped_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)")
def unmapped_anti(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "part").select("p_partkey").join(t.load(spark, sf, "lineitem").filter("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("except_files", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000")
def except_files(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(t.load(spark, sf, "supplier").filter("s_acctbal < 2000").select("s_nationkey"))


@query("intersect_names", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_names(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(t.load(spark, sf, "supplier").select("s_nationkey"))


@query("dedup_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    # the text is only hashed: first ids are a minimum, summed up before the shuffle
    d = t.load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


BLOCKS = r"list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '')"


@query(
    "dedup_blocks",
    f"WITH b AS (SELECT doc_id, {BLOCKS} AS bs FROM documents), k AS (SELECT doc_id, bs, list_transform(bs, lambda b: lower(trim(regexp_replace(b, '\\s+', ' ', 'g')))) AS ks FROM b) SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(generate_series(1, len(bs)), lambda i: CASE WHEN list_position(ks, ks[i]) = i THEN bs[i] END), lambda b: b IS NOT NULL), chr(10) || chr(10)), '') AS text FROM k",
)
def dedup_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents")
    kept = curation.dedup_blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.coalesce(kept, F.lit("")).alias("text"))


@query("dup_groups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = t.load(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


SPLIT = "strat AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY sha256(p_partkey || '42'), p_partkey) AS i, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part), split AS (SELECT p_partkey, p_brand, p_type, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM strat)"


def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return curation.stratified_split(t.load(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey")


@query("stratified_split", f"WITH {SPLIT} SELECT p_partkey, split FROM split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return stratified(spark, sf).select("p_partkey", "split")


@query("split_leakage", f"WITH {SPLIT}, s AS (SELECT p_name, split FROM split JOIN part USING (p_partkey)) SELECT p_name, bool_or(split = 'train') AND bool_or(split = 'test') AS leaks FROM s GROUP BY p_name")
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    s = stratified(spark, sf)
    return s.groupBy("p_name").agg((F.bool_or(F.col("split") == "train") & F.bool_or(F.col("split") == "test")).alias("leaks"))


@query("holdout_split", "SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY sha256(p_partkey || '42'), p_partkey) <= count(*) OVER () - floor(count(*) OVER () * 0.1::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM part")
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    return curation.holdout(t.load(spark, sf, "part").select("p_partkey"), "p_partkey")


MOST = 500


@query(
    "balanced_sample",
    f"WITH c AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'unknown' ELSE p_brand END AS cls, sha256(p_partkey || '42') AS h FROM part), k AS (SELECT greatest(1, {MOST} // count(DISTINCT cls)) AS q FROM c WHERE cls <> 'unknown'), p AS (SELECT p_partkey, cls, h FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY h, p_partkey) AS i FROM c WHERE cls <> 'unknown'), k WHERE i <= q), r AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS i FROM c WHERE p_partkey NOT IN (SELECT p_partkey FROM p)) SELECT p_partkey, cls FROM p UNION ALL SELECT p_partkey, cls FROM r WHERE i <= greatest(0, {MOST} - (SELECT count(*) FROM p))",
)
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = t.load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "unknown").otherwise(F.col("p_brand")).alias("cls"))
    return curation.balanced_sample(c, "cls", "p_partkey", MOST)


@query("first_k_per_class", "SELECT p_brand, p_name, p_partkey, position FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part) WHERE position <= 20")
def first_k_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return curation.first_k(t.load(spark, sf, "part"), "p_brand", "p_partkey", 20).select("p_brand", "p_name", "p_partkey", F.col("position").cast("long").alias("position"))


SHOWN = "CASE WHEN p_partkey % 4 = 3 THEN 'Healthy' ELSE upper(colour[1]) || lower(substr(colour, 2)) || ' Spot' END"


@query(
    "instruction_tasks",
    f"{N}, x AS (SELECT p_partkey, noun, {SHOWN} AS shown, CASE WHEN p_partkey % 4 = 3 THEN 'Healthy' ELSE 'Diseased' END AS health FROM names) SELECT p_partkey, unnest(['a', 'b', 'd']) AS task, unnest([noun, 'Crop: ' || noun || chr(10) || 'Disease: ' || shown || chr(10) || 'Status: ' || health, '{{\"crop\":\"' || noun || '\",\"disease\":\"' || shown || '\",\"health_status\":\"' || health || '\",\"visual_symptoms\":[]}}']) AS response FROM x",
)
def instruction_tasks(spark: SparkSession, sf: str) -> DataFrame:
    n = t.names(spark, sf).select("p_partkey", F.col("noun").alias("crop"), F.when(F.col("p_partkey") % 4 == 3, "healthy").otherwise(F.concat("colour", F.lit("_spot"))).alias("disease"))
    return curation.instruction_tasks(n, "p_partkey").select("p_partkey", "task", "response")


@query("collision_suffix", f"{N} SELECT p_partkey, folder || CASE WHEN n > 1 THEN '_' || (n - 1) ELSE '' END || '.jpg' AS target FROM (SELECT p_partkey, folder, row_number() OVER (PARTITION BY brand, folder ORDER BY p_partkey) AS n FROM names)")
def collision_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return curation.collision_names(t.names(spark, sf), "brand", "folder", F.lit(".jpg"), "p_partkey").select("p_partkey", "target")


@query("sft_records")
def sft_records(spark: SparkSession, sf: str) -> DataFrame:
    n = t.names(spark, sf).select("p_partkey", F.concat(F.lit("/img/"), "folder").alias("image"), F.col("noun").alias("crop"), F.col("colour").alias("disease"), F.col("brand").alias("source"))
    return curation.sft_records(n, "p_partkey", "image").select("sample_id", F.to_json("conversation").alias("conversation"), F.to_json("metadata").alias("metadata"))


@query(
    "sft_flat",
    f"{N} SELECT p_partkey, 'Crop: ' || noun || chr(10) || 'Most likely disease or condition: ' || colour || chr(10) || 'Health status: Diseased' || chr(10) || 'Dataset source: ' || brand || chr(10) || chr(10) || 'The image is associated with the ' || colour || ' condition in the training dataset.' || chr(10) || chr(10) || 'For a complete diagnosis, visual symptoms and field information should also be considered.' AS answer FROM names",
)
def sft_flat(spark: SparkSession, sf: str) -> DataFrame:
    return t.names(spark, sf).select("p_partkey", curation.answer_text("noun", "colour", "brand").alias("answer"))


@query("sft_summary", "SELECT count(*) AS available, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem)) AS found, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS missing FROM part")
def sft_summary(spark: SparkSession, sf: str) -> DataFrame:
    seen = t.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    p = t.load(spark, sf, "part").select("p_partkey").join(seen, "p_partkey", "left")
    return p.agg(F.count(F.lit(1)).alias("available"), F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("class_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("unbalanced_classes", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) <> 80")
def unbalanced_classes(spark: SparkSession, sf: str) -> DataFrame:
    return t.load(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).filter("n <> 80")


@query("dataset_stats", f"{N} SELECT count(*) AS n, string_agg(DISTINCT noun, ',' ORDER BY noun) AS crops, string_agg(DISTINCT colour, ',' ORDER BY colour) AS diseases FROM names")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    # sets of class names
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.names(spark, sf).agg(F.count(F.lit(1)).alias("n"), names("noun").alias("crops"), names("colour").alias("diseases"))


@query("distinct_pairs", f"{N} SELECT DISTINCT noun AS crop, colour AS disease FROM names ORDER BY 1, 2")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return t.names(spark, sf).select(F.col("noun").alias("crop"), F.col("colour").alias("disease")).distinct().orderBy("crop", "disease")
