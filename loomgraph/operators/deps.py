"""Dependencies: keys, de-duplication, version conflicts, trees and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.patterns import glob_regex


def distinct(deps: DataFrame, seq: str) -> DataFrame:
    """One row per type, name and version: the one stored last by seq."""
    others = [c for c in deps.columns if c not in ("type", "name", "version")]
    return deps.groupBy("type", "name", "version").agg(F.max_by(F.struct(*others), seq).alias("r")).select("type", "name", "version", "r.*")


def conflicts(deps: DataFrame) -> DataFrame:
    """Names with more than one version, whatever their type."""
    found = deps.groupBy("name").agg(F.sort_array(F.collect_set("version")).alias("versions"))
    return found.where(F.size("versions") > 1).select("name", F.array_join("versions", ",").alias("versions"), F.size("versions").alias("n_versions"), F.lit("latest").alias("strategy"))


def tree_summary(deps: DataFrame) -> DataFrame:
    return deps.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("depth") == 0).alias("roots"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_distinct(F.nullif("git", F.lit(""))).alias("repositories"),
    )


def matches_filter(text: str) -> Column:
    """`a*,!b*`: any plain glob on git, name or type (all, if there is none), and no negated one."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    hit = lambda g: F.coalesce(F.col("git").rlike(glob_regex(g)), F.lit(False)) | F.col("name").rlike(glob_regex(g)) | F.col("type").rlike(glob_regex(g))
    out = None
    for p in (p for p in parts if not p.startswith("!")):
        out = hit(p) if out is None else out | hit(p)
    out = F.lit(True) if out is None else out
    for p in (p for p in parts if p.startswith("!")):
        out = out & ~hit(p[1:])
    return out


def alias_expired(last_checked: Column, now: Column, ttl_s: int = 7 * 86_400) -> Column:
    return F.lit(True) if ttl_s == 0 else now - last_checked > ttl_s


def docker_image(image: Column) -> dict[str, Column]:
    """registry, name, tag and digest of an image reference."""
    digest = F.regexp_extract(image, r"@(sha256:[0-9a-f]+)$", 1)
    bare = F.regexp_replace(image, r"@sha256:[0-9a-f]+$", "")
    tag = F.regexp_extract(bare, r":([^:/]+)$", 1)
    name = F.regexp_replace(bare, r":([^:/]+)$", "")
    registry = F.regexp_extract(name, r"^([^/]*[.:][^/]*|localhost)/", 1)
    return {"registry": registry, "name": name, "tag": F.when((tag == "") & (digest == ""), "latest").otherwise(tag), "digest": digest}


def docker_url(image: Column) -> Column:
    name = docker_image(image)["name"]
    return (
        F.when(name.startswith("ghcr.io/"), F.concat(F.lit("https://github.com/"), F.regexp_extract(name, r"^ghcr\.io/(.*)$", 1)))
        .when(name.startswith("quay.io/"), F.concat(F.lit("https://"), name))
        .when(name.rlike(r"^[^/]*\.[^/]*/"), F.concat(F.lit("https://"), name))
        .when(name.contains("/"), F.concat(F.lit("https://hub.docker.com/r/"), name))
        .otherwise(F.concat(F.lit("https://hub.docker.com/_/"), name))
    )


def go_git_url(module: Column) -> Column:
    """The repository of a Go module; empty if the host isn't known."""
    return (
        F.when(module.rlike(r"^(github\.com|gitlab\.com|bitbucket\.org)/[^/]+/[^/]+"), F.concat(F.lit("https://"), F.regexp_extract(module, r"^([^/]+/[^/]+/[^/]+)", 1)))
        .when(module.startswith("golang.org/x/"), F.concat(F.lit("https://github.com/golang/"), F.regexp_extract(module, r"^golang\.org/x/([^/]+)", 1)))
        .when(module.rlike(r"^gopkg\.in/[^/]+/[^/]+\.v\d"), F.concat(F.lit("https://github.com/"), F.regexp_extract(module, r"^gopkg\.in/([^/]+/[^/.]+)", 1)))
        .when(module.rlike(r"^gopkg\.in/[^/]+\.v\d"), F.regexp_replace(module, r"^gopkg\.in/([^/.]+)\.v.*$", "https://github.com/go-$1/$1"))
        .otherwise("")
    )


def npm_version(version: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(version), r"^(\^|~|>=|>|<=|<|=)\s*", ""), " ")[0]


def is_release(tag: Column) -> Column:
    return ~F.lower(tag).rlike("alpha|beta|rc|pre|dev")


def substitute(text: Column, variables: dict[str, str]) -> Column:
    """`${V}`, `${V:-default}` and `$V`; an unknown variable without a default stays."""
    import re

    for name in sorted(variables, key=len, reverse=True):
        value = variables[name].replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, rf"\$\{{{re.escape(name)}(:-[^}}]*)?\}}|\${re.escape(name)}(?![A-Za-z0-9_])", value)
    return F.regexp_replace(text, r"\$\{[A-Za-z0-9_]+:-([^}]*)\}", "$1")


def visited_once(jobs: DataFrame) -> DataFrame:
    """path, git, depth: scan jobs (path, git, depth), each place once at its least depth. A local job is known
    by its path, another by its repository with the version."""
    place = F.when(F.col("git") == "", F.concat(F.lit("local:"), "path")).otherwise(F.concat(F.lit("git:"), "git"))
    return jobs.groupBy(place.alias("job")).agg(F.min("depth").alias("depth"))


def walk(roots: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """job, depth: the jobs that a walk visits, level by level: roots (job), and what scanning a job finds
    (job, next), at most depth levels down. A job that was visited at a lesser depth isn't queued again."""
    from loomgraph.operators.graph import dependency_walk

    return dependency_walk(found.select(F.col("job").alias("parent"), F.col("next").alias("child")), roots.select(F.col("job").alias("name")), depth).withColumnRenamed("name", "job")
