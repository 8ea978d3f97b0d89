"""Configuration: quality settings merged by specificity, excludes, built-in rules and style presets."""

from __future__ import annotations

from typing import Any

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.patterns import config_path
from loomgraph.functions.text import interpolate
from loomgraph.operators.access import AccessRule, parse_line, specificity

BUILTIN_RULES: dict[str, dict[str, list[AccessRule]]] = {
    "clean_architecture": {"**/domain/**": [AccessRule("deny", pattern="infrastructure/"), AccessRule("deny", pattern="presentation/")], "**/application/**": [AccessRule("deny", pattern="presentation/")]},
    "layered_architecture": {"**/controllers/**": [AccessRule("deny", pattern="repositories/")], "**/repositories/**": [AccessRule("deny", pattern="controllers/")]},
    "secure_imports": {"**": [AccessRule("deny", pattern="unsafe"), AccessRule("deny", pattern="crypto/md5"), AccessRule("deny", pattern="crypto/sha1")]},
    "no_fmt_print": {"*.go": [AccessRule("deny", package="fmt", method="Print*")]},
    "no_console_log": {"*.js": [AccessRule("deny", package="console", method="log")]},
    "no_print_statements": {"*.py": [AccessRule("deny", package="builtins", method="print")]},
    "no_system_out_print": {"*.java": [AccessRule("deny", package="System.out", method="print*")]},
}
#: Names that are accepted and add no access rule.
EMPTY_RULES = ("no_circular_dependencies", "interface_segregation", "dependency_inversion", "single_responsibility", "immutable_entities", "proper_error_handling")
STYLE = {"strict": {"max_line_length": 80, "max_file_length": 300, "max_function_length": 30, "max_complexity": 5}, "moderate": {"max_line_length": 100, "max_file_length": 500, "max_function_length": 50, "max_complexity": 10}, "relaxed": {"max_line_length": 120, "max_file_length": 1000, "max_function_length": 100, "max_complexity": 20}}


def builtin(names: list[str]) -> dict[str, list[AccessRule]]:
    """The sections of the named built-in rules; an unknown name is an error."""
    out: dict[str, list[AccessRule]] = {}
    for name in names:
        if name not in BUILTIN_RULES and name not in EMPTY_RULES:
            raise ValueError(f"unknown built-in rule {name!r}")
        for section, rules in BUILTIN_RULES.get(name, {}).items():
            known = out.setdefault(section, [])
            known += [r for r in rules if r not in known]
    return out


def load(text: str) -> dict[str, Any]:
    """A YAML configuration with its `${variables}` put in and its import rules parsed."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict) or not isinstance(data.get("rules", {}), dict):
        raise ValueError("a configuration maps file patterns to rules")
    variables = {k: str(v) for k, v in (data.get("variables") or {}).items()}
    sections = {}
    for pattern, rule in (data.get("rules") or {}).items():
        lines = [interpolate(str(x), variables) for x in (rule or {}).get("imports", [])]
        sections[interpolate(pattern, variables)] = [r for r in map(parse_line, lines) if r]
    for pattern, rules in builtin(data.get("builtin_rules") or []).items():
        sections.setdefault(pattern, []).extend(rules)
    return {"sections": sections, "quality": data.get("quality") or {}, "linters": data.get("linters") or {}}


def enabled_linters(linters: dict[str, dict[str, Any]]) -> list[str]:
    return sorted(k for k, v in linters.items() if (v or {}).get("enabled"))


def quality_setting(path: Column, sections: dict[str, dict[str, Any]], key: str) -> Column:
    """A quality number for a file: the most specific section with a value other than zero."""
    values = [F.when(config_path(path, p), F.lit(int(sections[p][key]))) for p in sorted(sections, key=specificity, reverse=True) if sections[p].get(key)]
    return F.coalesce(*values, F.lit(0)) if values else F.lit(0)


def excludes(*lists: Column) -> Column:
    """Their union, first occurrences in order."""
    return F.array_distinct(F.concat(*lists))


def first_analyzer(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The analyzer of the first path pattern that matches, or null; no basename fallback."""
    from loomgraph.functions.patterns import glob_regex

    out = F.lit(None).cast("string")
    for pattern, analyzer in reversed(rules):
        out = F.when((path == pattern) | path.rlike(glob_regex(pattern)), F.lit(analyzer)).otherwise(out)
    return out


def style(strictness: str) -> dict[str, int]:
    return STYLE[strictness]
