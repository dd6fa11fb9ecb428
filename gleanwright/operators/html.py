"""Web pages to records: titles, text blocks, sections, cleaning, and what the text says about crop, condition, evidence and policy."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean, col, stable_id, strip, tidy_label
from ..session import ready, spread

#: Elements whose content is not read.
DROPPED = "(?is)<(script|style|noscript|iframe)\\b.*?</(?:script|style|noscript|iframe)>"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT, HEADS = frozenset(("h1", "h2", "h3", "h4", "p", "li", "table")), ("h1", "h2")
#: Characters of section texts that a worker holds before it hands them on.
OUT_CHARS = 1 << 20
#: Marks of site navigation, footers and credits.
NAVIGATION, FOOTERS, CREDITS = ("Home | About Us | Success Stories",), ("© TNAU",), ("Content validator:", "Source of Images:")
#: Crops and conditions that texts name, in the order in which they are tried.
CROPS = ("Tomato", "Corn", "Maize", "Rice", "Potato", "Wheat", "Soybean", "Cotton", "Apple", "Cherry")
CONDITIONS = (
    "Early Blight",
    "Late Blight",
    "Powdery Mildew",
    "Bacterial Leaf Blight",
    "Bacterial Canker",
    "Bacterial Speck",
    "Leaf Mold",
    "Septoria Leaf Spot",
    "Anthracnose",
    "Gray Mold",
    "Phytophthora Blight",
    "White Mold",
    "Tomato Spotted Wilt Virus",
)
#: Evidence type by words of the section, then of the body.
SECTION_TYPES = (
    (r"\bdisease\s+management\b|\bmanagement\b", "treatment"),
    (r"\bsymptoms?\b", "symptoms"),
    (r"\bdisease\s+development\b|\bpathogen\b|\bcausal\s+agent\b|\bepidemiology\b", "epidemiology"),
    (r"\bhosts?\b|\bhost\s+range\b", "host_range"),
    (r"\bsignificance\b|\bimportance\b|\byield\s+impact\b", "impact"),
    (r"\bconditions?\b|\bfavou?rable\s+condition\b", "conditions"),
)
BODY_TYPES = (
    (r"\bdisease\s+management\s*:", "treatment"),
    (r"\bmanagement\s*:\b|\btreatment\s*:\b|\bcontrol\s*:\b", "treatment"),
    (r"\bsymptoms?\s*:\b", "symptoms"),
    (r"\bspread\s+and\s+survival\b|\bfavou?rable\s+condition\b", "epidemiology"),
)
#: Words of management prose.
PROSE = r"\bmanage(?:ment)?\b|\bcontrol(?:ling)?\b|\bprevent(?:ion)?\b|\brotate\s+crops?\b|\bresistant\s+(?:cultivar|variet(?:y|ies)|hybrid)s?\b"


def plain(c: Column) -> Column:
    """Text of an HTML fragment: tags become spaces, the common entities characters."""
    x = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(x, r"\s+", " "))


def title(html: Column | str) -> Column:
    """The title element, else the first h1 or h2; null without either."""
    h = col(html)
    return F.coalesce(*(blank_to_null(plain(F.regexp_extract(h, p, n))) for p, n in ((r"(?is)<title[^>]*>(.*?)</title>", 1), (r"(?is)<(h[12])\b[^>]*>(.*?)</\1>", 2))))


def blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, position, tag, text): each opening heading, paragraph, item or table, with the text up to the next tag."""
    found = F.regexp_extract_all(F.regexp_replace(html, DROPPED, " "), F.lit(r"(?is)<(?:h[1-4]|p|li|table)\b[^>]*>[^<]*"), F.lit(0))
    b = pages.select(key, F.posexplode(found).alias("position", "b"))
    return b.select(key, "position", F.lower(F.regexp_extract("b", r"(?i)^<([a-z0-9]+)", 1)).alias("tag"), plain(F.regexp_replace("b", r"^<[^>]*>", "")).alias("text"))


class _Tree(HTMLParser):
    """Texts of the kept elements, in the order in which they open; text inside counts for every open element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.mute = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        texts: list[str] | None = None
        if tag in KEPT and not self.mute:
            texts = []
            self.found.append((tag, texts))
        if tag not in VOID:
            self.open.append((tag, texts))
            self.mute += tag in ("script", "style", "noscript", "iframe")

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.mute -= sum(t in ("script", "style", "noscript", "iframe") for t, _ in self.open[at:])
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if (data := data.strip()) and not self.mute:
            for _, texts in self.open:
                if texts is not None:
                    texts.append(data)


def section_rows(html: str) -> list[tuple[int, str | None, str | None, str]]:
    """(counter, section, subsection, text): the text under each heading. h1 and h2 open a section, h3 and h4 a subsection."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out: list[tuple[int, str | None, str | None, str]] = []
    section = sub = None
    buffer: list[str] = []

    def flush() -> None:
        text = "\n".join(buffer).strip()
        if text:
            out.append((len(out) + 1, section, sub, text))
        buffer.clear()

    for tag, texts in tree.found:
        text = " ".join(texts)
        if tag in ("h1", "h2"):
            flush()
            section, sub = text, None
        elif tag in ("h3", "h4"):
            flush()
            sub = text
        elif text:
            buffer.append(text)
    flush()
    return out


def sections(pages: DataFrame, key: str, html: str = "html", url: str = "url", source: str = "source_id") -> DataFrame:
    """Section records of each page: ids, title, section, subsection, content. Only the walk over the tree is Python."""

    names = [key, "counter", "section", "subsection", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One page at a time is text of Python's; sections leave in batches of OUT_CHARS characters."""
        for b in batches:
            types = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)  # noqa: B023, E731
            rows, held = [], 0
            for k, h in zip(b.column(0), b.column(1), strict=True):
                for r in section_rows(h.as_py()):
                    rows.append((k.as_py(), *r))
                    held += len(r[3])
                    if held >= OUT_CHARS:
                        yield made()
                        rows, held = [], 0
            if rows:
                yield made()

    ready(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    walked = spread(pages.select(key, html)).mapInArrow(run, f"{key} {kind}, counter int, section string, subsection string, content string")
    head = pages.select(key, F.col(source).alias("source"), F.col(url).alias("source_uri"), stable_id(url).alias("document_id"), title(html).alias("document_title"))
    out = walked.withColumn("content", clean("content")).join(head, key)
    return out.withColumn("knowledge_id", stable_id("source", "source_uri", F.col("counter").cast("string"), "section", "subsection", "content"))


def clean_page_text(c: Column | str) -> Column:
    """Collapsed lines without leading navigation and without what follows the footer or the credits."""
    x = F.translate(col(c), " Â", "  ")
    lines = F.filter(F.transform(F.split(x, r"\r\n|\n|\r"), lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    x = F.array_join(lines, "\n")
    for mark in NAVIGATION:
        at = F.locate("Contact", x, len(mark) + 1)
        x = F.when(x.startswith(mark) & (at > 0), strip(F.substring(x, at + len("Contact"), F.length(x)))).otherwise(x)
    for mark in (*FOOTERS, *CREDITS):
        at = F.locate(mark, x)
        x = F.when(at > 0, strip(F.substring(x, F.lit(1), at - 1))).otherwise(x)
    return x


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def crop_disease(text: Column | str, *context: Column | str) -> Column:
    """(crop, disease) that a text and its headings name, or nulls."""
    x = F.concat_ws(" ", *(blank_to_null(F.btrim(F.regexp_replace(col(c), r"\s+", " "))) for c in (*context, text)))
    both = rf"(?i)\b({_any(CROPS)})\b[\s\-]+(Northern Corn Leaf Blight|Northern Leaf Blight|{_any(CONDITIONS)})"
    crop, disease = blank_to_null(F.regexp_extract(x, both, 1)), blank_to_null(F.regexp_extract(x, both, 2))
    northern = x.rlike(r"(?i)\bNorthern\s+Corn\s+Leaf\s+Blight\b|\bNCLB\b")
    found = F.coalesce(*(blank_to_null(F.regexp_extract(x, rf"(?i)\b{c}\b", 0)) for c in CONDITIONS))
    northern_crop = F.when(disease.isNull() & northern & x.rlike(r"(?i)\b(sweet\s+corn|field\s+corn|corn)\b"), "Corn")
    disease = F.coalesce(disease, F.when(northern, "Northern Corn Leaf Blight"), found)
    generic = blank_to_null(F.regexp_extract(x, rf"(?i)\b(?:infected|disease|blight|mildew|rust|rot|plants?|leaves?|hosts?)\s+({_any(CROPS).lower()})\b", 1))
    crop = F.coalesce(tidy_label(crop), northern_crop, F.when(x.rlike(r"(?i)\btomato(?:es|e)?\b"), "Tomato"), tidy_label(generic))
    return F.struct(F.when(F.lower(crop) == "maize", "Corn").otherwise(crop).alias("crop"), tidy_label(disease).alias("disease"))


def evidence_type(text: Column | str, *headings: Column | str) -> Column:
    """The evidence type: by the headings first, then by terms of the text, then by management prose; else null."""
    head = F.lower(F.concat_ws(" ", *(blank_to_null(strip(h)) for h in headings))) if headings else F.lit("")
    body = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in SECTION_TYPES:
        out = out.when(head.rlike(pattern), kind)
    for pattern, kind in BODY_TYPES:
        out = out.when(body.rlike(pattern), kind)
    return out.when(F.concat_ws(" ", head, body).rlike(PROSE), "treatment")


def policy_flags(text: Column | str) -> Column:
    """(recommendation_preference, organic_eligible, ipm_eligible): only what the text says outright."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.struct(F.lit("General").alias("recommendation_preference"), low.rlike(r"\borganic(?:ally)?\b").alias("organic_eligible"), low.rlike(r"\bintegrated pest management\b|\bipm\b").alias("ipm_eligible"))


def reject_reasons(records: DataFrame, key: str, text: str, shortest: int = 200, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """records with `reject_reason`: empty, short, boilerplate, duplicate (of a smaller key, apart from case and spacing), or null."""
    norm = F.lower(F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    r = records.withColumn("_h", F.sha2(norm, 256))
    first = r.groupBy("_h").agg(F.min(key).alias("_first"))
    told = F.when(norm == "", "empty").when(F.length(norm) < shortest, "short")
    for phrase in boilerplate:
        told = told.when(norm.contains(phrase.lower()), "boilerplate")
    return r.join(first, "_h").withColumn("reject_reason", told.when(F.col(key) != F.col("_first"), "duplicate")).drop("_h", "_first")
