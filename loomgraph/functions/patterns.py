"""Patterns over code-graph nodes: the parser, and the matchers compiled to Columns.

There are five matchers with different case and wildcard rules; each has its own function, and
none stands in for another.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cyclomatic", "parameters", "params", "returns", "lines")
LANGUAGES = ("sql", "go", "python", "javascript", "typescript", "openapi", "java", "rust", "custom")
PARTS = ("package", "type", "method", "field")
COLUMNS = {"package": "package_name", "type": "type_name", "method": "method_name", "field": "field_name"}


@dataclass(frozen=True)
class Pattern:
    package: str = ""
    type: str = ""
    method: str = ""
    field: str = ""
    file_path: str = ""
    language: str = ""
    metric: str = ""
    text: str = ""

    def __str__(self) -> str:
        return self.text or ":".join(p for p in (self.package, self.type, self.method, self.field) if p)


def parse_pattern(text: str) -> Pattern:
    """`[@glob:|path(glob) AND ][language:]package[:type[:method[:field]]][.metric]`"""
    original, rest, glob = text, text.strip(), ""
    if rest.startswith("@"):
        glob, _, rest = rest[1:].partition(":")
        rest = rest or "*"
    elif rest.startswith("path("):
        close = rest.find(")")
        if close < 0:
            raise ValueError("path( without )")
        glob, rest = rest[5:close], rest[close + 1 :].strip()
        if rest[:3].upper() == "AND" and rest[3:4].isspace():
            rest = rest[3:].strip()
        elif rest:
            raise ValueError(f"unexpected text after path(): {rest!r}")
        rest = rest or "*"
    metric = ""
    head, dot, tail = rest.rpartition(".")
    if dot and tail in METRICS:
        rest, metric = head, tail
    parts = _parts(rest)
    language = ""
    if parts and parts[0].lower() in LANGUAGES and (len(parts) > 1 or parts[0].lower() in LANGUAGES):
        language, parts = parts[0].lower(), parts[1:]
    found = Pattern(file_path=glob, language=language, metric=metric, text=original)
    if not parts:
        return replace(found, package="*")
    if len(parts) == 1:
        return replace(found, **_single(parts[0]))
    if len(parts) > 4:
        raise ValueError(f"too many parts in pattern {text!r}")
    return replace(found, **dict(zip(PARTS, parts)))


def _parts(text: str) -> list[str]:
    if ":" in text:
        before, _, after = text.partition(":")
        if "." in before:
            split = before.split(".")
            return [*split, after] if len(split) == 2 else [before, after]
        return text.split(":")
    if "." in text:
        if text.endswith(".*"):
            return [text[:-2], "*"]
        if text.startswith("*."):
            return ["*", text[2:]]
        return text.split(".")
    return [text]


def _single(part: str) -> dict[str, str]:
    if part == "*":
        return {"package": "*"}
    if "/" in part:
        return {"package": part}
    if part.startswith("*") or part.endswith("*") or "A" <= part[:1] <= "Z":
        return {"type": part}
    return {"package": part}


def sql_like(column: Column, part: str) -> Column | None:
    """M1: with `*` an ASCII-case-insensitive LIKE in which `_` is a wildcard too, else equality.
    None stands for no predicate."""
    if part in ("", "*"):
        return None
    if "*" not in part:
        return column == part
    pattern = part.lower().replace("\\", "\\\\").replace("*", "%")
    return F.lower(column).like(pattern)


def wildcard(column: Column, part: str) -> Column:
    """M2: case-sensitive; a star only at either end, else equality."""
    if part in ("", "*"):
        return F.lit(True)
    if len(part) > 1 and part.startswith("*") and part.endswith("*"):
        return column.contains(part[1:-1])
    if part.startswith("*"):
        return column.endswith(part[1:])
    if part.endswith("*"):
        return column.startswith(part[:-1])
    return column == part


def rule_text(column: Column, pattern: str) -> Column:
    """M3: rule patterns. `!` negates; a trailing `/` is a prefix; one `*` is prefix and suffix;
    otherwise the text, or anything below it by `/` or `.`."""
    if pattern.startswith("!"):
        return ~rule_text(column, pattern[1:])
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("/"):
        return (column == pattern[:-1]) | column.startswith(pattern)
    if pattern.count("*") == 1:
        head, tail = pattern.split("*")
        return column.startswith(head) & column.endswith(tail)
    return (column == pattern) | column.startswith(pattern + "/") | column.startswith(pattern + ".")


def glob_regex(glob: str, doublestar: bool = True, braces: bool = True) -> str:
    """The anchored regular expression of a glob; without doublestar, `**` is as `*`."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if doublestar and glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif doublestar and glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif doublestar and glob == "**":
            out, i = out + ".*", i + 2
        elif c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif braces and c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(g, doublestar, False)[1:-1] for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_glob(path: Column, glob: str) -> Column:
    """M4: a glob on the whole path or on its last part."""
    regex = glob_regex(glob)
    return path.rlike(regex) | basename(path).rlike(regex)


def rule_file(path: Column, pattern: str) -> Column:
    """M5, as rules apply to files: any file for an empty pattern; basename, whole path, or any suffix of its parts."""
    if not pattern:
        return F.lit(True)
    inner = glob_regex(pattern, doublestar=False, braces=False)[1:-1]
    return path.rlike(f"^(?:.*/)?{inner}$")


def config_path(path: Column, pattern: str) -> Column:
    """M5, as configuration sections apply to files."""
    if pattern in ("**", "*"):
        return F.lit(True)
    if pattern.startswith("**/"):
        inner = glob_regex(pattern[3:], doublestar=False, braces=False)
        return basename(path).rlike(inner) | path.rlike(f"^(?:.*/)?{inner[1:-1]}$")
    if pattern.endswith("/**"):
        return path.startswith(pattern[:-2]) | (path == pattern[:-3])
    if "*" not in pattern and "?" not in pattern:
        return path.endswith(pattern)
    return path.rlike(glob_regex(pattern, doublestar="**" in pattern, braces=False)) | basename(path).rlike(glob_regex(pattern, doublestar=False, braces=False))


def include_exclude(path: Column, include: list[str], exclude: list[str], workdir: str = "") -> Column:
    """Any include (all, if none) and no exclude; globs see the path below workdir, or the basename."""
    prefix = workdir.rstrip("/") + "/"
    relative = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if workdir else path
    any_of = lambda globs: [relative.rlike(glob_regex(g)) | basename(path).rlike(glob_regex(g)) for g in globs]
    kept = F.lit(True)
    for part in any_of(include)[:1]:
        kept = part
    for part in any_of(include)[1:]:
        kept = kept | part
    for part in any_of(exclude):
        kept = kept & ~part
    return kept


def infer_language(path: Column) -> Column:
    """By scheme or suffix; null if neither is known."""
    out = F.when(path.startswith("sql://"), "sql").when(path.startswith("openapi://"), "openapi")
    for language, suffixes in {"go": ["go"], "python": ["py", "pyi"], "javascript": ["js", "jsx", "mjs"], "typescript": ["ts", "tsx"], "java": ["java"], "rust": ["rs"], "markdown": ["md", "mdx"], "sql": ["sql"]}.items():
        for s in suffixes:
            out = out.when(path.endswith("." + s), language)
    return out


def language_is(language: Column, path: Column, wanted: str) -> Column:
    return F.lower(F.coalesce(F.nullif(language, F.lit("")), infer_language(path), F.lit(""))) == wanted.lower()


def _all(parts: list[Column | None]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out if p is None else out & p
    return out


def engine_predicate(p: Pattern) -> Column:
    """Rule statements: M1 on all four parts; M2, M4 and the language only if the pattern has a file glob."""
    found = _all([sql_like(F.col(COLUMNS[k]), getattr(p, k)) for k in PARTS])
    return found & matches(p) if p.file_path else found


def query_predicate(p: Pattern, workdir: str = "") -> Column:
    """Pattern queries: M1 on package, type and method (field has no effect), language, file glob, work folder."""
    parts = [sql_like(F.col(COLUMNS[k]), getattr(p, k)) for k in PARTS[:3]]
    parts.append(F.col("file_path").startswith(workdir.rstrip("/") + "/") if workdir else None)
    parts.append(language_is(F.col("language"), F.col("file_path"), p.language) if p.language else None)
    parts.append(file_glob(F.col("file_path"), p.file_path) if p.file_path else None)
    return _all(parts)


def location_predicate(p: Pattern, workdir: str = "") -> Column:
    """Location queries: M1 on all four parts; language and file glob have no effect."""
    parts = [sql_like(F.col(COLUMNS[k]), getattr(p, k)) for k in PARTS]
    return _all([*parts, F.col("file_path").startswith(workdir.rstrip("/") + "/") if workdir else None])


def matches(p: Pattern) -> Column:
    """The in-memory test: file glob, language and M2 on all four parts."""
    parts: list[Column | None] = [wildcard(F.col(COLUMNS[k]), getattr(p, k)) for k in PARTS]
    parts.append(file_glob(F.col("file_path"), p.file_path) if p.file_path else None)
    parts.append(language_is(F.col("language"), F.col("file_path"), p.language) if p.language else None)
    return _all(parts)
