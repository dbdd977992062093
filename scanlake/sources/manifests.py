"""Package manifests and lockfiles as dependency rows; both are map-only per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.versions import semver
from .corpus import IGNORED_DIRECTORIES

# ---- fixed values: sections in order of version lookup, and the scope each gives ----------------
SECTIONS = (("dependencies", "runtime"), ("optionalDependencies", "runtime"), ("bundledDependencies", "runtime"),
            ("devDependencies", "development"), ("peerDependencies", "unknown"))


def _workspace_file(files: DataFrame, names, max_depth: int | None) -> DataFrame:
    parts = F.split("path", "/")
    ignored = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))
    found = files.filter(tx.basename(F.col("path")).isin(list(names)) & ~ignored)
    return found if max_depth is None else found.filter(F.size(parts) - 1 <= max_depth)


def manifest_dependencies(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(scan, file, component, version, scope): scope by precedence, version from the first section that has one."""
    schema = ", ".join(f"{s} map<string,string>" for s, _ in SECTIONS)
    # an outer explode and the test after it: Spark would test a plain one, or the parsed value, by parsing again for every map it reads
    m = _workspace_file(files, ["package.json"], max_depth).withColumn("m", F.from_json("content", schema))
    empty = F.create_map().cast("map<string,string>")
    maps = [F.coalesce(F.col(f"m.{s}"), empty) for s, _ in SECTIONS]
    names = F.array_distinct(F.concat(*[F.map_keys(x) for x in maps]))
    e = m.select("scan_id", F.col("path").alias("file"), "m", F.explode_outer(names).alias("component")).filter("component is not null")
    found = [F.element_at(F.coalesce(F.col(f"m.{s}"), empty), F.col("component")) for s, _ in SECTIONS]
    has = [F.array_contains(F.map_keys(F.coalesce(F.col(f"m.{s}"), empty)), F.col("component")) for s, _ in SECTIONS]
    scope = F.coalesce(*[F.when(h, s) for h, (_, s) in zip(has, SECTIONS)])
    version = F.coalesce(*[F.when(semver(x).isNotNull(), tx.trim(x)) for x in found])
    return e.select("scan_id", "file", "component", version.alias("version"), scope.alias("scope"))


def lock_dependencies(files: DataFrame, declared: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Installed versions; the dev flag gives the scope, else the manifest next to the lockfile, else unknown."""
    names = ["package-lock.json", "npm-shrinkwrap.json"]
    k = _workspace_file(files, names, max_depth).withColumn("m", F.from_json("content", "packages map<string,struct<version:string,dev:boolean>>"))
    e = k.select("scan_id", F.col("path").alias("file"), F.explode_outer("m.packages").alias("key", "entry")) \
        .filter(F.col("key").isNotNull() & F.startswith("key", F.lit("node_modules/")) & (F.coalesce("entry.version", F.lit("")) != ""))
    e = e.select("scan_id", "file", F.regexp_replace("key", "^node_modules/", "").alias("component"), F.col("entry.version").alias("version"),
                 F.coalesce("entry.dev", F.lit(False)).alias("dev"), tx.dirname(F.col("file")).alias("dir"))
    d = declared.filter(F.endswith("file", F.lit("package.json"))).select("scan_id", tx.dirname(F.col("file")).alias("dir"), "component", F.col("scope").alias("declared"))
    return e.join(d, ["scan_id", "dir", "component"], "left").select(
        "scan_id", "file", "component", "version", F.when(F.col("dev"), "development").otherwise(F.coalesce("declared", F.lit("unknown"))).alias("scope"))
