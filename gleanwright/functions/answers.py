"""What free-text answers say: final part, predicted label, confidence, fields; and labels from paths and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, col, mapped, shave, strip

#: The labels of the evaluation set, in the order of their numbers.
LABELS = ("apple scab", "common rust", "northern leaf blight", "black rot", "leaf blast", "septoria leaf spot")
#: Marks of the final answer, fields that name a condition.
FINAL = r"(?is)^.*(?:</think>|</thinking>|final answer:)(.*)$"
FIELDS = ("most likely disease", "disease", "diagnosis", "class")
#: Labels with a display name that title case would not give.
DISPLAY = {
    "tomato spider mites two spotted spider mite": "Tomato Spider Mites",
    "grape esca black measles": "Grape Esca",
    "pepper bell bacterial spot": "Pepper Bacterial Spot",
    "pepper bell healthy": "Pepper Healthy",
}
#: Crop words that loose labels leave out, and aliases.
CROP_WORDS = ("tomato", "potato", "apple", "grape", "pepper", "bell")
ALIASES = {
    "disease": ("Most likely disease or condition", "Most likely disease", "Disease", "Disease or condition"),
    "symptoms": ("Key visual symptoms supporting the diagnosis", "Key visual symptoms", "Symptoms", "Key symptoms", "Visual symptoms"),
    "confidence": ("Confidence",),
    "crop": ("Crop", "Crop or plant"),
}
#: Words that tell what an answer gives.
RUBRIC = {
    "crop_identified": ("crop", "tomato", "potato", "apple", "grape", "rice", "pepper"),
    "symptoms_provided": ("symptom", "spot", "yellow", "lesion", "discolor", "leaf"),
    "immediate_action_provided": ("remove", "apply", "treat", "spray", "fungicide", "bactericide", "isolate", "action"),
    "preventive_measures_provided": ("prevent", "prevention", "rotate", "rotation", "monitor", "avoid", "sanitation", "air circulation"),
    "image_recommendation_provided": ("image", "photo", "picture", "leaf image"),
}


def final_answer(c: Column | str) -> Column:
    """What follows the last marker of the end of reasoning; all of it without one."""
    whole = strip(F.coalesce(col(c), F.lit("")))
    return F.when(whole.rlike(FINAL), strip(F.regexp_extract(whole, FINAL, 1))).otherwise(whole)


def plain(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.lower(strip(c)), "_-", "  "), r"\s+", " ")


def label_in(c: Column | str, labels: tuple[str, ...] = LABELS) -> Column:
    """The longest label that the text holds, else null."""
    text, out = plain(c), F.when(F.lit(False), F.lit(""))
    for label in sorted(labels, key=len, reverse=True):
        out = out.when(text.contains(label), label)
    return out


def by_number(n: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.get(F.array(*map(F.lit, labels)), n.cast("int") - 1)


def last_label(low: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label that occurs last in a lower-case text, else null."""
    at = [F.struct(F.when(F.locate(x, low) > 0, F.length(low) - F.locate(x[::-1], F.reverse(low)) - len(x) + 1).alias("p"), F.lit(x).alias("l")) for x in labels]
    best = F.array_max(F.filter(F.array(*at), lambda s: s["p"].isNotNull()))
    return best["l"]


def first_label(low: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label that occurs first in a lower-case text, else null."""
    at = [F.struct(F.when(F.locate(x, low) > 0, F.locate(x, low)).alias("p"), F.lit(x).alias("l")) for x in labels]
    return F.array_min(F.filter(F.array(*at), lambda s: s["p"].isNotNull()))["l"]


def prediction(c: Column | str, truncated: Column | str, labels: tuple[str, ...] = LABELS) -> Column:
    """The predicted label: the last `answer: N`, the last number that ends or opens the final part, a disease field, a label in the
    final part, the last label anywhere; else incomplete or unknown."""
    text = strip(F.coalesce(col(c), F.lit("")))
    low, final = F.lower(text), final_answer(text)
    digits = f"[1-{len(labels)}]"
    answers = F.regexp_extract_all(low, F.lit(rf"\banswer\s*:\s*({digits})\b"), F.lit(1))
    number_at = rf"(?s)^(?:.*[^0-9])?({digits})(?:\s*[.):-])?(?:\s|$)(.*)$"
    low_final = F.lower(final)
    number, tail = F.regexp_extract(low_final, number_at, 1), F.regexp_extract(low_final, number_at, 2)
    named = by_number(number, labels)
    opens = F.coalesce(F.regexp_extract(low_final, r"^\s*([0-9])\s*[.):-]?\s*", 1) == number, F.lit(False)) & F.regexp_replace(low_final, r"^\s*[0-9]\s*[.):-]?\s*", "").startswith(named)
    by_final = F.when(number != "", F.coalesce(label_in(tail, labels), F.when((F.length(final) <= 40) | opens, named)))
    fields = [F.try_element_at(F.filter(F.transform(F.reverse(F.regexp_extract_all(low, F.lit(rf"{f}\s*:\s*([^\n\r]+)"), F.lit(1))), lambda x: label_in(x, labels)), lambda x: x.isNotNull()), F.lit(1)) for f in FIELDS]
    none = F.when(col(truncated), "incomplete").otherwise("unknown")
    return F.when(text == "", none).otherwise(F.coalesce(by_number(F.try_element_at(answers, F.lit(-1)), labels), by_final, *fields, label_in(final, labels), last_label(low, labels), none))


def confidence(c: Column | str) -> Column:
    low = F.lower(F.coalesce(col(c), F.lit("")))
    said = F.try_element_at(F.regexp_extract_all(low, F.lit(r"confidence(?:\s+level)?\s*:\s*([^\n\r]+)"), F.lit(1)), F.lit(-1))
    share = F.try_element_at(F.regexp_extract_all(low, F.lit(r"([0-9]{1,3}\s*%)\s*confidence"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.substring(shave(strip(said), " *_\"'"), 1, 40), F.replace(share, F.lit(" "), F.lit("")), F.lit("unknown"))


def field(c: Column | str, *names: str) -> Column:
    """The value of the first of the named fields that has one, plain or in Markdown."""
    out = []
    for name in names:
        value = F.regexp_extract(col(c), rf"(?im)^\s*(?:[-*+]\s+)?(?:\*\*)?{name}(?:\*\*)?\s*:\s*(.+?)\s*$", 1)
        value = strip(F.regexp_replace(strip(shave(strip(value), "*")), r"[ .;:]+$", ""))
        out.append(blank_to_null(value))
    return F.coalesce(*out)


def folder_truth(name: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of a class folder: what follows the first ___, with spaces for _ and -; null if it is none."""
    low = F.lower(strip(name))
    low = F.when(low.contains("___"), F.array_join(F.slice(F.split(low, "___"), F.lit(2), F.size(F.split(low, "___"))), "___")).otherwise(low)
    text = strip(F.regexp_replace(F.translate(low, "_-", "  "), r"\s+", " "))
    return F.when(text.isin(*labels), text)


def path_truth(path: Column | str, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of the nearest folder above a file, else of its name without the extension."""
    parts = F.split(col(path), "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    near = F.try_element_at(F.filter(F.transform(folders, lambda x: folder_truth(x, labels)), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(near, folder_truth(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), labels))


def loose_label(c: Column | str, display: dict[str, str] = DISPLAY) -> Column:
    """A display name: no extension, no bare numbers, words in title case."""
    x = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\.(jpg|jpeg|png|bmp|webp)$", "")
    x = F.regexp_replace(F.translate(x, "-_", "  "), r"\b[0-9]+\b", " ")
    x = strip(F.regexp_replace(x, r"\s+", " "))
    return F.coalesce(mapped(x, display), F.initcap(x))


def labels_match(a: Column | str, b: Column | str) -> Column:
    """Equal display names, one inside the other, or the same words without crops."""
    x, y = F.lower(loose_label(a)), F.lower(loose_label(b))
    rest = lambda s: F.array_sort(F.array_except(F.array_distinct(F.split(s, " ")), F.array(*map(F.lit, CROP_WORDS))))
    return x.contains(y) | y.contains(x) | ((F.size(rest(x)) > 0) & (rest(x) == rest(y)))


def rubric(response: Column | str, disease_found: Column) -> dict[str, Column]:
    """The seven checks of an answer."""
    low = F.lower(F.coalesce(col(response), F.lit("")))
    some = lambda ws: F.array_max(F.array(*(low.contains(w) for w in ws)))
    return {"response_generated": F.length(low) > 20, "disease_identified": disease_found, **{k: some(ws) for k, ws in RUBRIC.items()}}
