"""Source manifests: fingerprints, what changed, and which domains to build again."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("path", "size", "mtime_ns", "sha256")
SCHEMA = "domain string, name string, path string, size long, mtime_ns long, sha256 string"


def read(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """A JSON manifest {sources: {domain: {name: fields}}} as a table; None if there is none."""
    p = Path(path)
    if not p.exists():
        return None
    sources = json.loads(p.read_text()).get("sources", {})
    return spark.createDataFrame([(d, n, *(f.get(k) for k in FIELDS)) for d, names in sources.items() for n, f in names.items()], SCHEMA)


def read_config(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text()) or {}


def of_files(spark: SparkSession, domains: dict[str, str]) -> DataFrame:
    """Fingerprints of the files below each domain's path."""
    out = None
    for domain, path in domains.items():
        f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        part = f.select(F.lit(domain).alias("domain"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"))
        out = part if out is None else out.unionByName(part)
    return out


def changes(before: DataFrame, now: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, change): new, removed or changed rows of a full outer comparison, nulls being equal to nulls."""
    a = before.select(*keys, F.struct(*fields).alias("_a"))
    b = now.select(*keys, F.struct(*fields).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def changed_domains(before: DataFrame | None, now: DataFrame) -> list[str]:
    """Domains to build again: all without an earlier manifest, else those with any difference."""
    rows = now.select("domain") if before is None else changes(before, now, ["domain", "name"], list(FIELDS)).select("domain")
    return sorted(r.domain for r in rows.distinct().collect())


def plan(before: DataFrame | None, now: DataFrame, force: bool = False, check_only: bool = False) -> dict[str, str]:
    """What to do with each domain: "rebuild" if it changed (or all, with force), "stale" instead if only asked (check_only), else "keep"."""
    domains = sorted(r.domain for r in now.select("domain").distinct().collect())
    changed = set(domains if force else changed_domains(before, now))
    return {d: ("stale" if check_only else "rebuild") if d in changed else "keep" for d in sorted({*domains, *changed})}


def save(df: DataFrame, path: str | Path) -> None:
    """Write a manifest beside its place and rename it: readers see the old or the new one. Call it after a build succeeded."""
    sources: dict[str, dict] = {}
    for r in df.collect():
        sources.setdefault(r.domain, {})[r.name] = {k: r[k] for k in FIELDS}
    p = Path(path)
    tmp = p.with_name(p.name + ".tmp")
    tmp.write_text(json.dumps({"sources": sources}, indent=2))
    tmp.replace(p)
