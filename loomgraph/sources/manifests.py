"""Dependency manifests, each parsed whole: (file_path, text) rows become dependency rows.

Line and JSON formats are read with SQL functions; YAML, TOML and XML ones in Arrow batches.
"""

from __future__ import annotations

import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.batches import steps
from loomgraph.operators.deps import npm_version

SCHEMA = "file_path string, name string, version string, type string, git string, indirect boolean, line int"
Row = tuple[str, str, str, str, bool, int]
NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"


def _file(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def go_mod(texts: DataFrame) -> DataFrame:
    """Required modules with replace directives applied."""
    line = F.posexplode(F.split("text", "\n")).alias("line", "raw")
    rows = texts.select("file_path", line).withColumn("s", F.trim(F.regexp_replace("raw", r"^\s*((require|replace)\s+(?!\())?", "")))
    arrow = rows.where(F.col("s").contains("=>")).select(
        "file_path", F.regexp_extract("s", r"^(\S+)", 1).alias("name"), F.regexp_extract("s", r"=>\s*(\S+)", 1).alias("to"), F.regexp_extract("s", r"=>\s*\S+\s+(v\S+)", 1).alias("to_version")
    )
    need = rows.where(F.col("s").rlike(r"^\S+\s+v\d\S*") & ~F.col("s").contains("=>")).select(
        "file_path", F.regexp_extract("s", r"^(\S+)", 1).alias("name"), F.regexp_extract("s", r"^\S+\s+(v\S+)", 1).alias("version"), F.col("raw").contains("// indirect").alias("indirect"), (F.col("line") + 1).alias("line")
    )
    met = need.join(arrow, ["file_path", "name"], "left")
    kind = F.when(F.col("name").startswith("golang.org/x/"), "stdlib").otherwise("go")
    return met.select("file_path", F.coalesce("to", "name").alias("name"), F.coalesce(F.nullif("to_version", F.lit("")), "version").alias("version"), kind.alias("type"), F.lit("").alias("git"), "indirect", "line")


def go_sum(texts: DataFrame) -> DataFrame:
    """Modules of a sum file, the first version of each."""
    rows = texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.col("raw").rlike(r"^\S+ v\S+ h1:"))
    parts = rows.select("file_path", "line", F.split("raw", " ")[0].alias("name"), F.regexp_replace(F.split("raw", " ")[1], "/go.mod$", "").alias("version"))
    first = parts.groupBy("file_path", "name").agg(F.min(F.struct("line", "version")).alias("f"))
    return first.select("file_path", "name", F.col("f.version").alias("version"), F.lit("go").alias("type"), F.lit("").alias("git"), F.lit(True).alias("indirect"), (F.col("f.line") + 1).alias("line"))


def package_json(texts: DataFrame) -> DataFrame:
    found = texts.select("file_path", F.explode(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>")).alias("name", "raw"))
    git = F.when(F.col("raw").rlike(r"^(github:|git\+|https?://)"), F.regexp_replace(F.regexp_replace("raw", "^github:", "https://github.com/"), r"^git\+", "")).otherwise("")
    return found.select("file_path", "name", npm_version(F.col("raw")).alias("version"), F.lit("npm").alias("type"), git.alias("git"), F.lit(False).alias("indirect"), F.lit(0).alias("line"))


def package_lock(texts: DataFrame) -> DataFrame:
    """`packages` of newer lock files, else `dependencies`."""
    entry = "map<string,struct<version:string>>"
    newer = F.transform(F.map_entries(F.from_json(F.get_json_object("text", "$.packages"), entry)), lambda e: F.struct(F.regexp_replace(e["key"], r"^.*node_modules/", "").alias("key"), e["value"]["version"].alias("version")))
    older = F.transform(F.map_entries(F.from_json(F.get_json_object("text", "$.dependencies"), entry)), lambda e: F.struct(e["key"].alias("key"), e["value"]["version"].alias("version")))
    found = texts.select("file_path", F.inline(F.coalesce(newer, older))).where("key <> ''")
    return found.select("file_path", F.col("key").alias("name"), "version", F.lit("npm").alias("type"), F.lit("").alias("git"), F.lit(True).alias("indirect"), F.lit(0).alias("line"))


def requirements(texts: DataFrame) -> DataFrame:
    rows = texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("s", F.trim(F.regexp_replace("raw", r"\s#.*$|^#.*$", "")))
    rows = rows.where(F.col("s").rlike(NAME))
    version = F.regexp_extract("s", r"(?:==|>=|<=|~=|!=|>|<)\s*([^,;\s]+)", 1)
    return rows.select("file_path", F.regexp_extract("s", NAME, 1).alias("name"), version.alias("version"), F.lit("pip").alias("type"), F.regexp_extract("s", r"@\s*git\+(\S+)", 1).alias("git"), F.lit(False).alias("indirect"), (F.col("line") + 1).alias("line"))


def gradle(texts: DataFrame) -> DataFrame:
    rows = texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    form = r"""^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|compile)\s*\(?\s*['"]([^:'"]+):([^:'"]+):([^:'"]+)['"]"""
    hit = rows.where(F.col("raw").rlike(form))
    return hit.select("file_path", F.concat(F.regexp_extract("raw", form, 1), F.lit(":"), F.regexp_extract("raw", form, 2)).alias("name"), F.regexp_extract("raw", form, 3).alias("version"), F.lit("maven").alias("type"), F.lit("").alias("git"), F.lit(False).alias("indirect"), (F.col("line") + 1).alias("line"))


def _requirement(text: str) -> Row:
    m = re.match(NAME, text.strip())
    v = re.search(r"(?:==|>=|<=|~=|\^|>|<)\s*([^,;\s]+)", text)
    return (m[1] if m else text, v[1] if v else "", "pip", "", False, 0)


def _table(table: dict[str, Any], kind: str = "pip") -> Iterator[Row]:
    for name, spec in (table or {}).items():
        if name.lower() != "python":
            version = spec if isinstance(spec, str) else (spec or {}).get("version", "")
            yield name, version.lstrip("^~=<> ") if version != "*" else "", kind, "" if isinstance(spec, str) else (spec or {}).get("git", ""), False, 0


def parse_toml(name: str, text: str) -> Iterator[Row]:
    data = tomllib.loads(text)
    if name == "poetry.lock":
        for p in data.get("package", []):
            yield p["name"], p.get("version", ""), "pip", "", True, 0
    elif name == "Pipfile":
        yield from _table(data.get("packages", {}))
        yield from _table(data.get("dev-packages", {}))
    else:
        project = data.get("project", {})
        for group in [project.get("dependencies", []), *project.get("optional-dependencies", {}).values()]:
            yield from map(_requirement, group)
        yield from _table(data.get("tool", {}).get("poetry", {}).get("dependencies", {}))


def parse_pnpm(name: str, text: str) -> Iterator[Row]:
    data = yaml.safe_load(text) or {}
    for key in data.get("packages") or {}:
        m = re.match(r"/?(@?[^@]+?)[@/]([^@/(]+)(?:\(.*)?$", key)
        if m:
            yield m[1], m[2], "npm", "", True, 0


def parse_yarn(name: str, text: str) -> Iterator[Row]:
    current, at = "", 0
    for i, line in enumerate(text.split("\n"), 1):
        if line and not line[0].isspace() and line[0] != "#":
            m = re.match(r'"?(@?[^@"]+)@', line)
            current, at = (m[1] if m else ""), i
        elif current and (m := re.match(r'\s+version:? "?([^"\s]+)"?', line)):
            yield current, m[1], "npm", "", True, at
            current = ""


def parse_pom(name: str, text: str) -> Iterator[Row]:
    root = ET.fromstring(text)
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    properties = {tag(p): (p.text or "") for e in root if tag(e) == "properties" for p in e}
    for dep in (e for e in root.iter() if tag(e) == "dependency"):
        got = {tag(c): (c.text or "").strip() for c in dep}
        version = re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), got.get("version", ""))
        yield f"{got.get('groupId', '')}:{got.get('artifactId', '')}", version, "maven", "", False, 0


def split_image(image: str) -> tuple[str, str]:
    image, _, digest = image.partition("@")
    head, slash, last = image.rpartition("/")
    name, _, tag = last.partition(":")
    return head + slash + name, digest or tag or "latest"


def parse_dockerfile(name: str, text: str) -> Iterator[Row]:
    """FROM and COPY --from images, with ARG values put in; stages of the file itself are no images."""
    args: dict[str, str] = {}
    stages: set[str] = set()
    put = lambda s: re.sub(r"\$\{(\w+)(?::-([^}]*))?\}|\$(\w+)", lambda m: args.get(m[1] or m[3]) or m[2] or m[0], s)
    pending, start = "", 0
    for i, raw in enumerate(text.split("\n"), 1):
        start = start if pending else i
        if raw.rstrip().endswith("\\"):
            pending += raw.rstrip()[:-1] + " "
            continue
        line, pending = (pending + raw).strip(), ""
        word = line.split(None, 1)
        if len(word) < 2 or line.startswith("#"):
            continue
        if word[0].upper() == "ARG":
            key, _, value = word[1].partition("=")
            args.setdefault(key.strip(), put(value.strip().strip("\"'")))
        elif word[0].upper() == "FROM":
            rest = re.sub(r"--\S+\s+", "", word[1]).split()
            image = put(rest[0])
            if image not in stages and image != "scratch":
                yield *split_image(image), "docker", "", False, start
            if len(rest) > 2 and rest[1].upper() == "AS":
                stages.add(rest[2])
        elif word[0].upper() == "COPY" and (m := re.search(r"--from=(\S+)", word[1])):
            image = put(m[1])
            if image not in stages and not image.isdigit():
                yield *split_image(image), "docker", "", False, start


def parse_compose(name: str, text: str) -> Iterator[Row]:
    data = yaml.safe_load(text) or {}
    lines = text.split("\n")
    for service in (data.get("services") or {}).values():
        image = (service or {}).get("image")
        if image:
            at = max((i for i, s in enumerate(lines, 1) if image in s), default=0)
            yield *split_image(image), "docker", "", False, at


def parse_helm(name: str, text: str) -> Iterator[Row]:
    data = yaml.safe_load(text) or {}
    for d in data.get("dependencies") or []:
        yield d.get("name", ""), str(d.get("version", "")), "helm", d.get("repository", "") or "", False, 0
    if name.startswith("values"):
        registry = ((data.get("global") or {}).get("imageRegistry") or "").rstrip("/")
        yield from _images(data, registry)


def _images(node: Any, registry: str) -> Iterator[Row]:
    if isinstance(node, list):
        for x in node:
            yield from _images(x, registry)
    if not isinstance(node, dict):
        return
    for key, value in node.items():
        if key.lower().endswith("image") and isinstance(value, str) and value:
            yield *split_image(value), "docker", "", False, 0
        elif key.lower().endswith("image") and isinstance(value, dict) and value.get("repository"):
            prefix = value.get("registry") or registry
            yield (f"{prefix}/" if prefix else "") + value["repository"], str(value.get("tag") or "latest"), "docker", "", False, 0
        else:
            yield from _images(value, registry)


def parse_setup(name: str, text: str) -> Iterator[Row]:
    """install_requires of setup.py (a literal list) or setup.cfg."""
    if name == "setup.cfg":
        block = re.search(r"install_requires\s*=\s*\n((?:[ \t]+\S.*\n?)+)", text)
        items = block[1].split("\n") if block else []
    else:
        block = re.search(r"install_requires\s*=\s*\[(.*?)\]", text, re.S)
        items = re.findall(r"""["']([^"']+)["']""", block[1]) if block else []
    yield from (_requirement(x) for x in items if x.strip())


PARSERS: list[tuple[str, Callable[[str, str], Iterator[Row]]]] = [
    (r"(pyproject\.toml|Pipfile|poetry\.lock)$", parse_toml), (r"pnpm-lock\.yaml$", parse_pnpm), (r"yarn\.lock$", parse_yarn), (r"pom\.xml$", parse_pom), (r"Dockerfile[^/]*$", parse_dockerfile),
    (r"(docker-)?compose[^/]*\.ya?ml$", parse_compose), (r"(Chart|requirements|values[^/]*)\.(ya?ml|lock)$", parse_helm), (r"setup\.(py|cfg)$", parse_setup),
]
JVM = {r"go\.mod$": go_mod, r"go\.sum$": go_sum, r"package\.json$": package_json, r"package-lock\.json$": package_lock, r"requirements[^/]*\.txt$": requirements, r"build\.gradle(\.kts)?$": gradle}


def parse(path: str, text: str) -> list[Row]:
    """Rows of a manifest of one of the Python-side formats; one that can't be parsed has none."""
    name = _file(path)
    for pattern, parser in PARSERS:
        if re.match(pattern, name):
            try:
                return list(parser(name, text))
            except Exception:  # noqa: BLE001: whatever a manifest holds, the others go on
                return []
    return []


def scan(texts: DataFrame) -> DataFrame:
    """All dependencies of the manifests among (file_path, text)."""
    import pyarrow as pa

    def run(batches: Any) -> Any:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.int32()]
        for batch in batches:
            for b in steps(batch, "text"):
                rows = [(p, *r) for p, t in zip(b.column("file_path").to_pylist(), b.column("text").to_pylist()) for r in parse(p, t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    name = F.element_at(F.split("file_path", "/"), -1)
    out = texts.where(name.rlike("|".join(f"^{p}" for p, _ in PARSERS))).select("file_path", "text").mapInArrow(run, SCHEMA)
    for pattern, reader in JVM.items():
        out = out.unionByName(reader(texts.where(name.rlike("^" + pattern))))
    return out


def lock_pip(texts: DataFrame) -> DataFrame:
    """Pipfile.lock: default and develop sections."""
    entry = "map<string,struct<version:string>>"
    both = F.concat(*[F.coalesce(F.map_entries(F.from_json(F.get_json_object("text", f"$.{s}"), entry)), F.expr(f"cast(array() as array<struct<key:string,value:struct<version:string>>>)")) for s in ("default", "develop")])  # noqa: F541
    found = texts.select("file_path", F.explode(both).alias("e"))
    return found.select("file_path", F.col("e.key").alias("name"), F.regexp_replace("e.value.version", "^=+", "").alias("version"), F.lit("pip").alias("type"), F.lit("").alias("git"), F.lit(True).alias("indirect"), F.lit(0).alias("line"))
