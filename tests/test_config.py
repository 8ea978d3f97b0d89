"""Configuration, presets, module resolution and scalar functions."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import access, config, lookup
from loomgraph.sources import linters

YAML = """
variables: {layer: infrastructure}
builtin_rules: [no_fmt_print, no_circular_dependencies]
rules:
  "**": {imports: ["!${layer}/", "+infrastructure/api", "# nothing", "!${unknown}"]}
  "*.go": {imports: ["!unsafe"]}
linters: {ruff: {enabled: true}, vale: {enabled: false}}
"""


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_configuration(spark):
    found = config.load(YAML)
    assert [str(r) for r in found["sections"]["**"]] == ["!infrastructure/", "+infrastructure/api", "!${unknown}"]
    assert config.enabled_linters(found["linters"]) == ["ruff"]
    ordered = [r for _, r in access.ordered_rules(found["sections"])]
    allowed = lambda p, m="": one(spark, access.is_allowed(ordered, F.lit(p), F.lit(m), F.lit("/a/b.go")))
    assert not allowed("infrastructure/db") and allowed("infrastructure/api") and not allowed("fmt", "Println") and allowed("fmt", "Sprintf") and not allowed("unsafe")
    for bad in ("[1]", "rules: [1]", "builtin_rules: [what]"):
        with pytest.raises(ValueError, match="configuration|unknown"):
            config.load(bad)
    assert config.style("strict")["max_complexity"] < config.style("relaxed")["max_complexity"]
    assert len(config.BUILTIN_RULES) + len(config.EMPTY_RULES) == 13


def test_quality_settings_by_specificity(spark):
    sections = {"**": {"max": 500}, "*.py": {"max": 0}, "src/**": {"max": 100}, "main.py": {"max": 10}}
    for path, want in (("a.go", 500), ("src/a.py", 100), ("x/main.py", 10), ("x/a.py", 500)):
        assert one(spark, config.quality_setting(F.lit(path), sections, "max")) == want


def test_modules(spark):
    for name, language, want in (("os.path", "python", "stdlib"), (".x", "python", "relative"), ("numpy", "python", "third-party"), ("node:fs", "javascript", "stdlib"), ("./a", "javascript", "relative"), ("react", "javascript", "third-party"), ("@types/node", "typescript", "types")):
        assert one(spark, lookup.resolve_module(F.lit(name), language)) == want


def test_scalars(spark):
    assert text.first_json('so: {"a": {"b": "}"}} and {') == '{"a": {"b": "}"}}' and text.first_json("none {") == "" and text.first_json('{"a\\"}": 1}') == '{"a\\"}": 1}'
    assert one(spark, linters.clean_message(F.lit("a.go:3:1: \x1b[31mbad\x1b[0m thing (errcheck)"))) == "bad thing"
    url = text.git_url(F.lit("https://h/r.git//sub/x@v1"))
    assert [one(spark, url[k]) for k in ("repository", "subdir", "version")] == ["https://h/r.git", "sub/x", "v1"]
    assert one(spark, text.package_of_path(F.lit("a/src/main/java/b/c/D.java"), "java")) == "b.c" and one(spark, text.package_of_path(F.lit("a/lib/x/y/z.py"), "python")) == "x.y"
    assert one(spark, text.metric_value(F.lit(0), F.lit(None).cast("array<string>"))) == 0
    assert one(spark, text.version_alias(F.lit("head~2"))) and not one(spark, text.version_alias(F.lit("v1")))
