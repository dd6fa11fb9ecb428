"""Text and label functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:[_-][a-z0-9]+)*"
#: Aliases that lookups of conditions know.
ALIASES = {
    "northern corn leaf blight": "northern_leaf_blight",
    "northern leaf blight": "northern_leaf_blight",
    "nclb": "northern_leaf_blight",
    "bacterial leaf blight": "bacterial_leaf_blight",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """All white space off both ends (trim() takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def shave(c: Column | str, chars: str) -> Column:
    """The given characters off both ends."""
    return F.btrim(col(c), F.lit(chars))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def mapped(c: Column | str, table: dict[str, str]) -> Column:
    """The table's value for c, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col(c))


def tokens(c: Column | str) -> Column:
    """Lexical tokens: runs of ASCII letters and digits, joined by single hyphens or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    """Tokens between white space, Unicode spaces too."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda x: x != "")


def collapse(c: Column | str) -> Column:
    """White space runs to one space, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), r"\s+", " "))


def clean(c: Column | str) -> Column:
    """No-break spaces to spaces, blank runs to one, at most one blank line, ends stripped."""
    x = F.regexp_replace(F.replace(col(c), F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n\s*\n\s*\n+", "\n\n"))


def structures(c: Column | str) -> Column:
    """Paragraphs, cut again before each list line; lines stripped, blank ones dropped."""
    marker = r"(?:[-*•]|[0-9]+[.)]|[A-Za-z][.)])[^\S\n]+"
    tidy = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), "\n")
    blocks = F.filter(F.transform(F.split(strip(c), r"\n\s*\n+"), tidy), lambda x: x != "")
    return F.filter(F.flatten(F.transform(blocks, lambda p: F.split(p, rf"\n(?={marker})"))), lambda x: x != "")


def tidy_label(c: Column | str) -> Column:
    return blank_to_null(shave(collapse(c), " :;-"))


def lookup_label(c: Column | str) -> Column:
    """A label as a lookup key: lower case, known aliases, else words joined by single underscores. Empty is null."""
    low = F.lower(strip(c))
    key = shave(F.regexp_replace(F.regexp_replace(low, r"\s+", "_"), "_+", "_"), "_")
    return blank_to_null(F.coalesce(mapped(collapse(low), ALIASES), key))


def filter_label(c: Column | str) -> Column:
    """A label as the evidence filter compares it: null is empty, underscores are not squeezed."""
    compact = collapse(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.coalesce(mapped(compact, ALIASES), F.replace(compact, F.lit(" "), F.lit("_")))


def context_label(c: Column | str, *, aliases_after: bool = False) -> Column:
    """The key of a label in free words: no explanation after a dash, in brackets, after a comma or after "which is".
    aliases_after looks known aliases up once more with spaces for underscores."""
    x = strip(F.split_part(strip(c), F.lit("—"), F.lit(1)))
    x = F.regexp_replace(x, r"\s*\([^)]*\)", "")
    x = strip(F.split_part(x, F.lit(","), F.lit(1)))
    x = strip(F.element_at(F.split(x, r"(?i)\s+which\s+is\s+", 2), 1))
    x = F.regexp_replace(F.regexp_replace(F.lower(shave(x, " .;:()")), r"\s+", "_"), "_+", "_")
    x = blank_to_null(shave(x, "_"))
    return F.coalesce(mapped(F.replace(x, F.lit("_"), F.lit(" ")), ALIASES), x) if aliases_after else x


def title_case(c: Column | str) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def coalesce_blank(*columns: Column | str, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    last = [F.lit(default)] if default is not None else []
    return F.coalesce(*(blank_to_null(c) for c in columns), *last)


def stable_id(*parts: Column | str, prefix: str = "ext-") -> Column:
    """prefix and 16 hex digits of the SHA-256 of the parts, joined by ||; a missing part is empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("||", *(F.coalesce(col(p), F.lit("")) for p in parts)), 256), 1, 16))


def resolve_path(c: Column | str, root: str) -> Column:
    return F.when(col(c).startswith("/"), col(c)).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), col(c)))
