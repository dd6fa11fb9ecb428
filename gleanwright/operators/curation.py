"""Curation of labelled samples: normalisation, repair, deduplication, splits, samples and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import capital, clean_label, health_status
from ..functions.text import title_case
from ..session import by_size
from .containment import holding


def normalize_labels(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(crop, disease) with norm_crop, norm_disease: healthy; the crop's own mapping; any crop's mapping; else the cleaned label.

    mapping: (ord, crop, canonical, alias), each canonical name being an alias too. Pairs are reduced to distinct ones; those that
    an alias may fit are found by equality and by the index of `containment`, and only these are looked at. The smallest ord that
    fits wins; equality before containment where the order asks for it."""
    keys = pairs.select("crop", "disease").distinct()
    keys = keys.withColumns({"c": F.lower(F.btrim("crop")), "d": clean_label("disease")})
    keys = keys.withColumn("both", F.btrim(F.concat_ws("_", "c", "d"), F.lit("_")))
    m = mapping.select("ord", F.col("crop").alias("mc"), F.col("canonical").alias("mcan"), clean_label("alias").alias("a")).distinct()
    n, d, c, both, a = F.length("a"), F.col("d"), F.col("c"), F.col("both"), F.col("a")
    own = (F.lower("mc") == c) & ((d == a) | ((n > 4) & d.contains(a)) | ((F.length(d) > 4) & a.contains(d)))
    equal = F.when((a == both) & (both != "unknown"), 0).when((a == d) & (d != "unknown"), 1).when((a == c) & (c != "unknown"), 2)
    inside = ((n >= 4) & (both.contains(a) | d.contains(a) | c.contains(a))) | ((F.length(both) > 5) & a.contains(both))
    # rank: own crop's mapping, then equality by candidate, then containment; each by the mapping's order
    step = F.when(own, 0).when(equal.isNotNull(), 1 + equal).when(inside, 4)
    said = F.array("both", "d", "c")  # what an alias may equal or be inside of
    each = keys.select("crop", "disease", F.explode(F.array_distinct(said)).alias("text"))
    strings, aliases = each.select("text").distinct(), m.select("a").distinct()
    alike = strings.join(aliases, F.col("text") == F.col("a")).select("text", "a")
    alike = alike.unionByName(holding(strings, aliases.filter(F.length("a") >= 4)).withColumnRenamed("pattern", "a"))
    alike = alike.unionByName(holding(aliases, strings.filter(F.length("text") > 4)).select(F.col("pattern").alias("text"), F.col("text").alias("a")))
    found = each.join(alike.distinct(), "text").select(F.col("crop").alias("k1"), F.col("disease").alias("k2"), F.col("a").alias("fits")).distinct()
    near = keys.join(found, (F.col("crop") == F.col("k1")) & (F.col("disease") == F.col("k2"))).drop("k1", "k2").join(m, F.col("fits") == F.col("a")).drop("fits")
    hit = near.filter(own | equal.isNotNull() | inside).groupBy("crop", "disease", "c", "d").agg(F.min(F.struct(step.alias("s"), "ord", "mc", "mcan")).alias("m"))
    out = keys.join(hit.select(F.col("crop").alias("k1"), F.col("disease").alias("k2"), "m"), (F.col("crop") == F.col("k1")) & (F.col("disease") == F.col("k2")), "left")
    rest = F.btrim(F.replace(F.replace(d, F.lit("leaf_"), F.lit("")), F.lit("_leaf"), F.lit("")), F.lit(" _"))
    fallback = F.when((rest != "") & (rest != "unknown"), rest).otherwise("UNKNOWN")
    out = out.withColumns(
        {
            "norm_crop": F.when(d.contains("healthy") | F.col("m").isNull() | (F.col("m.s") == 0), capital(c)).otherwise(capital(F.col("m.mc"))),
            "norm_disease": F.when(d.contains("healthy"), "healthy").otherwise(F.coalesce("m.mcan", fallback)),
        }
    ).select("crop", "disease", "norm_crop", "norm_disease")
    return pairs.join(out, ["crop", "disease"])


def class_folders(targets: DataFrame, folders: DataFrame) -> DataFrame:
    """(target, folder): the folder that is the target; else the first by name that holds it or lies in it, apart from case."""
    t = targets.select("target").filter("target <> ''").distinct().withColumn("b", F.lower("target"))
    f = folders.select("folder").filter("folder <> ''").distinct().withColumn("a", F.lower("folder"))
    inside = holding(f.select("a"), t.select("b")).select(F.col("text").alias("a"), F.col("pattern").alias("b"))
    alike = inside.unionByName(holding(t.select("b"), f.select("a")).select(F.col("pattern").alias("a"), F.col("text").alias("b"))).distinct()
    best = F.min(F.struct((F.col("folder") != F.col("target")).cast("int").alias("s"), "folder")).alias("m")
    return t.join(alike, "b").join(f, "a").groupBy("target").agg(best).select("target", "m.folder")


def unique_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the one value of each key; keys with several have n > 1 and no value."""
    g = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(value).alias("n"))
    return g.select(key, F.when(F.col("low") == F.col("high"), F.col("low")).alias(value), "n")


def repair(rows: DataFrame, fixes: DataFrame, key: str, column: str, broken: Column) -> DataFrame:
    """rows with `column` taken from fixes (key, fixed) where it is broken and a fix is there."""
    f = fixes.select(key, F.col(column).alias("_fix"))
    return rows.join(f, key, "left").withColumn(column, F.when(broken, F.coalesce("_fix", column)).otherwise(F.col(column))).drop("_fix")


def first_of(rows: DataFrame, key: Column | str, order: str) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def dedup_blocks(text: Column | str) -> Column:
    """A text without paragraphs that repeat an earlier one, apart from case and spacing. Paragraphs are sorted, so time grows with n log n."""
    t = F.col(text) if isinstance(text, str) else text
    blocks = F.filter(F.transform(F.split(t, "\n\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    key = lambda b: F.lower(F.btrim(F.regexp_replace(b, r"\s+", " ")))
    keyed = F.sort_array(F.transform(blocks, lambda b, i: F.struct(key(b).alias("k"), i.alias("i"), b.alias("b"))))
    first = lambda s: F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["k"] != x["k"]), F.struct(x["i"].alias("i"), x["b"].alias("b"))))
    # an array of one makes the sorted paragraphs a variable, which is computed once a text
    kept = F.get(F.transform(F.array(keyed), lambda s: F.filter(first(s), lambda x: x.isNotNull())), F.lit(0))
    return F.array_join(F.transform(F.sort_array(kept), lambda x: x["b"]), "\n\n")


def hash_order(key: Column | str, seed: int | str = 42) -> Column:
    """A shuffle that depends on the row and the seed alone."""
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(k.cast("string"), F.lit(str(seed))), 256)


def stratified_split(rows: DataFrame, strata: list[str], key: str, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with `split`: in each stratum the first floor(train n) in hash order, then floor(validation n), the rest test.

    Places are found by counting hash prefixes of each stratum, so a task ranks one part in 4,096 of a stratum; a null is a stratum too."""
    h = rows.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.substring("_h", 1, 3))
    names = [f"_s{k}" for k in range(len(strata))]
    prefix = h.groupBy(*(F.col(s).alias(n) for s, n in zip(strata, names, strict=True)), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = prefix.withColumns({"_before": before, "_n": F.sum("_c").over(own)})
    on = F.col("_p") == F.col("_q")
    for s, n in zip(strata, names, strict=True):
        on = on & F.col(s).eqNullSafe(F.col(n))
    ranked = h.join(by_size(prefix), on).withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(*strata, "_p").orderBy("_h", key)))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    split = F.when(F.col("_i") <= a, "train").when(F.col("_i") <= a + b, "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*rows.columns, "split")


def holdout(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42, least: int = 0, front: bool = False) -> DataFrame:
    """rows with `split`: the `share` of rows with the highest hashes (front: the lowest), at least `least`, is validation.
    The cut is found by counting hash prefixes, so no task sorts all rows."""
    h = rows.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.substring("_h", 1, 4))
    prefix = h.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))  # 65,536 rows at most
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    prefix = prefix.withColumns({"_before": F.coalesce(F.sum("c").over(up), F.lit(0)), "_all": F.sum("c").over(Window.partitionBy())}).drop("c")
    held = F.greatest(F.floor(F.col("_all") * share), F.lit(least))
    keep, low, high = (held, "validation", "train") if front else (F.col("_all") - held, "train", "validation")
    ranked = h.join(F.broadcast(prefix), "_p").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    return ranked.withColumn("split", F.when(F.col("_i") <= keep, low).otherwise(high)).drop("_h", "_p", "_before", "_all", "_i")


def balanced_sample(rows: DataFrame, cls: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows: the same number of each known class, then filled from the rest, unknown ones too."""
    n = rows.filter(F.col(cls) != "unknown").select(cls).distinct().count()
    if not n:
        return rows.limit(0)
    h = rows.withColumn("_h", hash_order(key, seed))
    i = F.row_number().over(Window.partitionBy(cls).orderBy("_h", key))
    picked = h.filter(F.col(cls) != "unknown").withColumn("_i", i).filter(F.col("_i") <= max(1, most // n)).drop("_i")
    rest = h.join(picked.select(key), key, "left_anti").orderBy("_h", key).limit(max(0, most - picked.count()))
    return picked.unionByName(rest.select(picked.columns)).orderBy("_h").limit(most).drop("_h")


def first_k(rows: DataFrame, cls: str, order: str, k: int) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(cls).orderBy(order))).filter(F.col("position") <= k)


def collision_names(rows: DataFrame, folder: str, stem: str, suffix: Column, order: str) -> DataFrame:
    """rows with `target`: the second and later equal names of a folder get _1, _2, ..."""
    i = F.row_number().over(Window.partitionBy(folder, stem).orderBy(order)) - 1
    return rows.withColumn("target", F.concat(stem, F.when(i > 0, F.concat(F.lit("_"), i.cast("string"))).otherwise(""), suffix))


def instruction_tasks(rows: DataFrame, *keep: str) -> DataFrame:
    """Three instruction tasks of each row (crop, disease): the crop, crop and condition, and the diagnosis as JSON."""
    shown = F.when(F.lower("disease") == "healthy", "Healthy").otherwise(title_case("disease"))
    health = F.when(F.lower("disease") == "healthy", "Healthy").otherwise("Diseased")
    text = F.concat(F.lit("Crop: "), "crop", F.lit("\nDisease: "), shown, F.lit("\nStatus: "), health)
    js = F.to_json(F.struct("crop", shown.alias("disease"), health.alias("health_status"), F.array().cast("array<string>").alias("visual_symptoms")))
    tasks = [("Identify the crop.", F.col("crop")), ("Identify the crop and disease in this image.", text), ("Output the diagnosis as structured JSON.", js)]
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("task"), F.lit(f"<image>\n{i}").alias("instruction"), r.alias("response")) for k, (i, r) in zip("abd", tasks, strict=True)))).alias("t")
    return rows.select(*keep, made).select(*keep, "t.*")


#: The texts of a training record.
ASK = (
    "Analyze this plant image for possible disease.\n\nIdentify:\n1. Crop\n2. Most likely disease or plant health condition\n3. Visual symptoms\n4. Confidence level\n"
    "5. Possible causes\n6. Organic treatment recommendations\n7. Preventive measures\n\nFocus only on what can reasonably be inferred from the image."
)


def answer_text(crop: str, disease: str, source: str) -> Column:
    return F.concat(
        F.lit("Crop: "), crop, F.lit("\nMost likely disease or condition: "), disease, F.lit("\nHealth status: "), health_status(disease), F.lit("\nDataset source: "), source,
        F.lit("\n\nThe image is associated with the "), disease, F.lit(" condition in the training dataset.\n\nFor a complete diagnosis, visual symptoms and field information should also be considered."),
    )


def sft_records(rows: DataFrame, key: str, image: str, crop: str = "crop", disease: str = "disease", source: str = "source") -> DataFrame:
    """(sample_id, conversation, metadata): nested training records."""
    none = F.lit(None).cast("string")
    item = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"))
    user = F.struct(F.lit("user").alias("role"), F.array(item("image", F.col(image), none), item("text", none, F.lit(ASK))).alias("content"))
    told = F.struct(F.lit("assistant").alias("role"), F.array(item("text", none, answer_text(crop, disease, source))).alias("content"))
    meta = F.struct(F.col(key).cast("string").alias("sample_id"), F.col(crop).alias("crop"), F.col(disease).alias("disease"), health_status(disease).alias("health_status"), F.col(source).alias("source"))
    return rows.select(F.col(key).cast("string").alias("sample_id"), F.array(user, told).alias("conversation"), meta.alias("metadata"))
