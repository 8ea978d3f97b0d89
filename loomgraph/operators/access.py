"""Ordered allow/deny rules: the last rule that matches decides."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.patterns import config_path, rule_file, rule_text


@dataclass(frozen=True)
class AccessRule:
    """type is allow, deny or override; with a package the method may be given too, else pattern applies to the package."""

    type: str
    pattern: str = ""
    package: str = ""
    method: str = ""
    file_pattern: str = ""

    def __str__(self) -> str:
        sign = {"deny": "!", "override": "+"}.get(self.type, "")
        name = self.package + (":" + self.method if self.method else "") if self.package else self.pattern
        return (f"[{self.file_pattern}] " if self.file_pattern else "") + sign + name


def parse_line(line: str) -> AccessRule | None:
    """`[glob] (+|!)package(:(!)method)`; None for blanks and comments."""
    text = line.split("#", 1)[0].strip()
    if not text:
        return None
    glob = ""
    if text.startswith("["):
        close = text.find("]")
        if close < 0:
            raise ValueError(f"no ] in {line!r}")
        glob, text = text[1:close].strip(), text[close + 1 :].strip()
    kind = {"!": "deny", "+": "override"}.get(text[:1], "allow")
    text = text[1:] if kind != "allow" else text
    package, colon, method = text.partition(":")
    if not colon:
        return AccessRule(kind, pattern=text, file_pattern=glob)
    if method.startswith("!"):
        kind, method = "deny", method[1:]
    return AccessRule(kind, package=package, method=method, file_pattern=glob)


def parse_lines(files: DataFrame) -> DataFrame:
    """directory, line_number, type, pattern, package, method, file_pattern: parse_line for every line of
    rule files (file_path, text), with SQL functions; blanks and comments are left out. A `[` without its `]`
    is an error."""
    lines = files.select(F.regexp_replace("file_path", "/?[^/]*$", "").alias("directory"), F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    text = F.trim(F.regexp_replace(F.split("raw", "#")[0], r"\s+", " "))
    kept = lines.select("directory", (F.col("n") + 1).alias("line_number"), text.alias("t")).where("t <> ''")
    closed = F.when(F.col("t").startswith("[") & ~F.col("t").contains("]"), F.raise_error(F.concat(F.lit("no ] in "), "t"))).otherwise(F.col("t"))
    cut = kept.withColumn("t", closed).withColumn("file_pattern", F.trim(F.regexp_extract("t", r"^\[([^\]]*)\]", 1))).withColumn("t", F.trim(F.regexp_replace("t", r"^\[[^\]]*\]", "")))
    sign = F.when(F.col("t").startswith("!"), "deny").when(F.col("t").startswith("+"), "override").otherwise("allow")
    signed = cut.withColumn("type", sign).withColumn("t", F.regexp_replace("t", "^[!+]", ""))
    named = signed.withColumn("name", F.regexp_extract("t", "^([^:]*):", 1)).withColumn("rest", F.regexp_extract("t", "^[^:]*:(.*)$", 1)).withColumn("paired", F.col("t").contains(":"))
    negated = F.col("paired") & F.col("rest").startswith("!")
    return named.select(
        "directory", "line_number", F.when(negated, "deny").otherwise(F.col("type")).alias("type"), F.when(F.col("paired"), "").otherwise(F.col("t")).alias("pattern"),
        F.when(F.col("paired"), F.col("name")).otherwise("").alias("package"), F.when(F.col("paired"), F.regexp_replace("rest", "^!", "")).otherwise("").alias("method"), "file_pattern",
    )


def merge_rule_files(configured: DataFrame, files: DataFrame) -> DataFrame:
    """section, seq, type, pattern, package, method: configured rules (the same columns) and after them, in
    each section, those of rule files in the order of folder and line. A rule's section is its file pattern, or
    `**`; the folder that its file is in has no further effect."""
    read = parse_lines(files).withColumn("section", F.coalesce(F.nullif("file_pattern", F.lit("")), F.lit("**")))
    last = configured.groupBy("section").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("section").orderBy("directory", "line_number")  # the rules of one section
    placed = read.join(last, "section", "left").withColumn("seq", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast("int"))
    columns = ["section", "seq", "type", "pattern", "package", "method"]
    return configured.select(columns).unionByName(placed.select(columns))


def rule_matches(rule: AccessRule, package: Column, method: Column) -> Column:
    if rule.package:
        hit = rule_text(package, rule.package)
        return hit & rule_text(method, rule.method) if rule.method else hit
    return rule_text(package, rule.pattern)


def decide(rules: Iterable[AccessRule], package: Column, method: Column, path: Column | None = None) -> Column:
    """The index of the last matching rule, or null: one expression, no join and no aggregation.
    Later rules are tested first, so the first hit is the answer."""
    rules = list(rules)
    out = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        hit = rule_matches(r, package, method)
        out = F.when(hit & rule_file(path, r.file_pattern) if path is not None else hit, F.lit(i)).otherwise(out)
    return out


def is_allowed(rules: Iterable[AccessRule], package: Column, method: Column, path: Column | None = None) -> Column:
    rules = list(rules)
    denied = [F.lit(i) for i, r in enumerate(rules) if r.type == "deny"]
    return ~F.coalesce(decide(rules, package, method, path).isin(*denied), F.lit(False)) if denied else F.lit(True)


def call_violations(nodes: DataFrame, edges: DataFrame, rules: list[AccessRule]) -> DataFrame:
    """Call edges with both ends known whose last matching rule denies the target."""
    source = nodes.select(F.col("id").alias("from_ast_id"), "file_path", F.col("package_name").alias("caller_package"))
    target = nodes.select(F.col("id").alias("to_ast_id"), F.col("package_name").alias("called_package"), F.col("method_name").alias("called_method"))
    met = edges.where("relationship_type = 'call'").select("id", "from_ast_id", "to_ast_id", "line_no").join(source, "from_ast_id").join(target, "to_ast_id")
    chosen = met.withColumn("rule_seq", decide(rules, F.col("called_package"), F.col("called_method"), F.col("file_path")))
    denied = [i for i, r in enumerate(rules) if r.type == "deny"]
    return chosen.where(F.col("rule_seq").isin(denied)).select("id", "file_path", F.col("line_no").alias("line"), "caller_package", "called_package", "called_method", "rule_seq")


#: Rules of a table up to which they are broadcast.
MOST_RULES = 20_000


def fold_table(subjects: DataFrame, rules: DataFrame, match: Column, key: list[str]) -> DataFrame:
    """The fold for rules that are a table (columns seq, type, ...): the greatest seq that matches.
    The rules are counted; up to MOST_RULES they are the broadcast side of a theta join, as any condition may
    be given, and more of them are joined in slices of that many. Each slice aggregates before it shuffles."""
    slices = max(1, -(-rules.count() // MOST_RULES))
    parts = [rules] if slices == 1 else [rules.where(F.pmod(F.xxhash64("seq"), F.lit(slices)) == k) for k in range(slices)]
    met = reduce(DataFrame.unionByName, [subjects.join(F.broadcast(p), match).groupBy(*key).agg(F.max_by(F.struct("seq", "type"), "seq").alias("last")) for p in parts])
    return met.groupBy(*key).agg(F.max("last").alias("last")).select(*key, F.col("last.seq").alias("seq"), F.col("last.type").alias("type"))


def specificity(pattern: str) -> tuple[int, str]:
    """`**` first, then patterns with `**`, with `*`, and literal ones; ties by name. Later is stronger."""
    return (0 if pattern == "**" else 1 if "**" in pattern else 2 if "*" in pattern else 3), pattern


def specificity_order(pattern: Column) -> Column:
    """The same for a column of patterns: sorts as specificity does."""
    rank = F.when(pattern == "**", 0).when(pattern.contains("**"), 1).when(pattern.contains("*"), 2).otherwise(3)
    return F.struct(rank.alias("rank"), pattern.alias("pattern"))


def ordered_rules(sections: dict[str, list[AccessRule]]) -> list[tuple[str, AccessRule]]:
    """Configuration sections' rules in the order in which they fold."""
    return [(p, r) for p in sorted(sections, key=specificity) for r in sections[p]]


def section_matches(path: Column, sections: dict[str, list[AccessRule]]) -> DataFrame | Column:
    """array<string> of the sections that apply to a file, in fold order."""
    names = sorted(sections, key=specificity)
    return F.array_compact(F.array(*[F.when(config_path(path, n), F.lit(n)) for n in names]))


def deepest_directory(files: DataFrame, directories: DataFrame) -> DataFrame:
    """For each file_path the deepest rule directory that contains it: the file's ancestors are
    exploded and joined by equality, instead of a prefix join."""
    parts = F.split("file_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))
    exploded = files.select("file_path", F.explode(ancestors).alias("a")).select("file_path", "a.depth", F.when(F.col("a.directory") == "", "/").otherwise(F.col("a.directory")).alias("directory"))
    return exploded.join(directories.select("directory"), "directory").groupBy("file_path").agg(F.max_by("directory", "depth").alias("directory"))


def rules_frame(spark, rules: list[AccessRule]) -> DataFrame:
    rows = [(i, r.type, r.pattern, r.package, r.method, r.file_pattern) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "seq int, type string, pattern string, package string, method string, file_pattern string")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))
