"""Scalar functions on code, versions and configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = (("net", "network"), ("http", "network"), ("database", "database"), ("sql", "database"), ("encoding", "encoding"), ("json", "encoding"), ("crypto", "crypto"), ("os", "system"), ("io", "io"), ("fmt", "formatting"), ("test", "testing"), ("log", "logging"))


def category(package: Column) -> Column:
    """The category of the first keyword that the package contains."""
    out = F.lit("other")
    for word, kind in reversed(CATEGORIES):
        out = F.when(package.contains(word), kind).otherwise(out)
    return out


def classify_library(path: Column) -> Column:
    out = F.when(~path.contains("/"), "stdlib")
    for word in ("gin", "gorilla", "echo", "gorm"):
        out = out.when(path.contains(word), word)
    return out.when(path.contains("database"), "database").otherwise("third-party")


def struct_tag_default(tag: Column) -> Column:
    return F.regexp_extract(tag, r'default:"([^"]*)"', 1)


def metric_value(count: Column, items: Column) -> Column:
    """The count if it is positive, else the length of the list; a null list has none."""
    return F.when(count > 0, count).otherwise(F.coalesce(F.size(items), F.lit(0)))


def java_complexity(body: Column) -> Column:
    """One, and the decisions that occur in the body's text."""
    return 1 + sum((F.regexp_count(body, F.lit(rf"\b{w}\b")) for w in ("if", "for", "while", "case", "catch")), F.lit(0))


def git_url(url: Column) -> dict[str, Column]:
    """repository, version and sub-folder of `url[//sub][@version]`."""
    bare = F.regexp_replace(url, r"@[^@/:]+$", "")
    return {
        "repository": F.regexp_replace(bare, r"(?<!:)//.*$", ""),
        "subdir": F.regexp_extract(bare, r"(?<!:)//(.+)$", 1),
        "version": F.regexp_extract(url, r"@([^@/:]+)$", 1),
    }


def version_alias(version: Column) -> Column:
    """HEAD, latest and GA, with an offset, are aliases."""
    return F.upper(version).rlike(r"^(HEAD|LATEST|GA)(~\d+)?$")


def api_namespace(version: Column, title: Column) -> Column:
    v = F.concat(F.lit("v"), F.replace(F.coalesce(version, F.lit("")), F.lit("."), F.lit("_")))
    slug = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(v, F.lit("v")), F.nullif(slug, F.lit("")), F.lit("api"))


def package_of_path(path: Column, language: str) -> Column:
    if language == "python":
        inner = F.regexp_extract(path, r"(?:^|/)(?:src|lib|app)/(.+)/[^/]+\.py$", 1)
    elif language == "java":
        inner = F.regexp_extract(path, r"(?:^|/)(?:src/main/java|src)/(.+)/[^/]+\.java$", 1)
    else:
        inner = F.lit("")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.coalesce(F.nullif(F.replace(inner, F.lit("/"), F.lit(".")), F.lit("")), folder)


def rule_to_import(kind: Column, pattern: Column) -> Column:
    return F.concat(F.when(kind == "deny", "!").when(kind == "override", "+").otherwise(""), pattern)


def first_json(text: str) -> str:
    """The first balanced {...} of a text, quotes respected; empty if there is none."""
    start, depth = text.find("{"), 0
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S).finditer(text, max(start, 0)):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0 and m.group() == "}":
            return text[start : m.end()]
    return ""


def interpolate(text: str, variables: dict[str, str]) -> str:
    """`${var}` from the variables; unknown ones stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: str(variables.get(m[1], m[0])), text)


def names_of(function: Column) -> Column:
    """All identifiers of a nested function row: its name and its parameters'."""
    return F.concat(F.array(function["name"]), F.coalesce(F.transform(function["parameters"], lambda p: p["name"]), F.expr("cast(array() as array<string>)")))
