"""Labels of class folders, and fixed dictionaries of crops and conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, mapped, shave

#: Crops that folder names may begin with, in the order in which they are tried.
CROPS = ("Tomato", "Apple", "Potato", "Corn", "Grape", "Peach", "Pepper", "Bell_pepper", "Strawberry", "Cherry", "Blueberry", "Raspberry", "Soybean", "Soyabean", "Squash", "Rice")
#: Conditions whose dictionary form differs from their own.
CONDITIONS = {
    "scab": "apple_scab",
    "rust": "common_rust",
    "corn_rust": "common_rust",
    "apple_rust": "cedar_apple_rust",
    "mold": "leaf_mold",
    "tomato_mold": "leaf_mold",
    "yellow_virus": "yellow_leaf_curl_virus",
    "two_spotted_spider_mites": "spider_mites",
}
CROP_NAMES = {"Soyabean": "Soybean"}
HEALTHY = ("healthy", "normal", "no disease", "no_disease")


def _rest(c: Column, sep: str) -> Column:
    """What follows the first sep."""
    return F.substring(c, F.locate(sep, c) + len(sep), F.length(c))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def folder_label(name: Column | str, style: str = "words", crops: tuple[str, ...] = CROPS) -> Column:
    """(crop, disease, health_status) of a class folder. Crop and disease stand around ___ or __; without them, style "words" takes the
    first word if it is a known crop, style "prefix" the first known crop that the name begins with, and style "rice" the whole name."""
    n = col(name)
    healthy = F.lower(n).contains("healthy")
    if style == "rice":
        return F.struct(F.lit("Rice").alias("crop"), n.alias("disease"), F.when(healthy, "Healthy").otherwise("Diseased").alias("health_status"))
    low = [x.lower() for x in crops]
    parts = F.split(n, "_")
    first = F.element_at(parts, 1)
    if style == "prefix":
        crop, disease = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
        for c in crops:
            starts = F.lower(n).startswith(c.lower())
            crop, disease = crop.when(starts, c), disease.when(starts, shave(F.substring(n, F.lit(len(c) + 1), F.length(n)), " _-"))
        crop, disease = crop.otherwise("Unknown"), disease.otherwise(n)
    else:
        known = F.regexp_replace(F.lower(first), r"\(+$", "").isin(*low)
        crop = F.when(known, first).otherwise("Unknown")
        disease = F.when(known, F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "_")).otherwise("Unknown")).otherwise(n)
    for sep in ("__", "___"):
        has = n.contains(sep)
        crop, disease = F.when(has, F.substring(n, F.lit(1), F.locate(sep, n) - 1)).otherwise(crop), F.when(has, _rest(n, sep)).otherwise(disease)
    if style != "prefix":
        crop = capital(shave(F.replace(F.split_part(crop, F.lit("("), F.lit(1)), F.lit(","), F.lit("")), " _-"))
    lc = F.lower(crop)
    crop = F.when(lc.isin("pepper", "pepper_bell", "pepper bell", "bell_pepper", "bell pepper"), "Pepper").when(lc.isin("soyabean", "soybean"), "Soybean").otherwise(capital(crop))
    disease = shave(disease, " _-")
    well = F.lower(disease).isin("healthy", "leaf", "") | healthy
    return F.struct(crop.alias("crop"), F.when(well, "healthy").otherwise(disease).alias("disease"), F.when(well, "Healthy").otherwise("Diseased").alias("health_status"))


def clean_label(c: Column | str) -> Column:
    return shave(F.translate(F.lower(col(c)), "- ", "__"), " _")


def dictionary_condition(c: Column | str) -> Column:
    x = F.lower(F.btrim(col(c)))
    return F.when(F.coalesce(col(c), F.lit("")) == "", "UNKNOWN").otherwise(F.coalesce(mapped(x, CONDITIONS), x))


def dictionary_crop(c: Column | str) -> Column:
    x = F.btrim(col(c))
    return F.when(F.coalesce(col(c), F.lit("")) == "", "Unknown").otherwise(F.coalesce(mapped(x, CROP_NAMES), x))


def health_status(c: Column | str) -> Column:
    return F.when(F.lower(col(c)).isin(*HEALTHY), "Healthy").otherwise("Diseased")


def class_folder(host: Column | str, healthy: Column, disease: Column | str, label: Column | str) -> Column:
    """crop___condition for a downloaded sample, else its class label, else unknown; spaces and slashes become underscores."""
    some = lambda c: F.nullif(F.replace(F.btrim(col(c)), F.lit(" "), F.lit("_")), F.lit(""))
    condition = F.when(healthy, F.lit("healthy")).otherwise(F.coalesce(some(disease), some(label), F.lit("unknown")))
    return F.translate(F.coalesce(F.concat(some(host), F.lit("___"), condition), some(label), F.lit("unknown")), "/\\", "__")
