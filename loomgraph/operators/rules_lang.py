"""The rule language: text and YAML forms, parsed to plain dataclasses on the driver.

RULE "name" { LIMIT(pattern.metric op value)  FORBID(p | a -> b)  REQUIRE(p | a -> b)  ALLOW(p | a -> b) }
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import yaml

from loomgraph.functions.patterns import METRICS, Pattern, parse_pattern

OPERATORS = (">=", "<=", "==", "!=", ">", "<")
KINDS = ("LIMIT", "FORBID", "REQUIRE", "ALLOW")
TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<arrow>->)|(?P<op>>=|<=|==|!=|>|<)|(?P<number>-?\d+(?:\.\d+)?)(?![\w*])|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[\w*]+)|(?P<punct>[{}().:,])""", re.S)


class RuleError(ValueError):
    """A rule text, pattern or value that the language doesn't have."""


@dataclass(frozen=True)
class Condition:
    pattern: Pattern
    metric: str
    op: str
    value: Any


@dataclass(frozen=True)
class Statement:
    kind: str
    pattern: Pattern | None = None
    target: Pattern | None = None
    condition: Condition | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    statements: tuple[Statement, ...]


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RuleError(f"unexpected character {text[at]!r} at line {text.count(chr(10), 0, at) + 1}")
        at = m.end()
        if m.lastgroup != "skip":
            out.append((m.lastgroup or "", m.group()))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        k, t = self.peek()
        if (kind and k != kind) or (text is not None and t.upper() != text):
            raise RuleError(f"expected {text or kind}, found {t or 'the end'}")
        self.at += 1
        return t

    def rules(self) -> RuleSet:
        found = []
        while self.peek()[0] != "end":
            self.take("name", "RULE")
            name = _unquote(self.take("string"))
            self.take("punct", "{")
            statements = []
            while self.peek()[1] != "}":
                statements.append(self.statement())
            self.take("punct", "}")
            found.append(Rule(name, tuple(statements)))
        return RuleSet(tuple(found))

    def statement(self) -> Statement:
        kind = self.take("name").upper()
        if kind not in KINDS:
            raise RuleError(f"expected a statement, found {kind}")
        self.take("punct", "(")
        if kind == "LIMIT":
            out = Statement(kind, condition=self.condition())
        else:
            first = self.pattern()
            target = None
            if self.peek()[0] == "arrow":
                self.take()
                target = self.pattern()
            out = Statement(kind, pattern=first, target=target)
        self.take("punct", ")")
        return out

    def pattern(self) -> Pattern:
        text = self.take("name")
        while self.peek()[1] in (".", ":"):
            text += self.take() + (self.take("name") if self.peek()[0] == "name" else self.take("number"))
        return _pattern(text)

    def condition(self) -> Condition:
        p = self.pattern()
        if not p.metric:
            raise RuleError(f"the condition {p} has no metric")
        op = self.take("op")
        return Condition(_bare(p), p.metric, op, self.value())

    def value(self) -> Any:
        kind, text = self.peek()
        if kind == "number":
            return float(self.take())
        if kind == "string":
            return _unquote(self.take())
        if text.lower() in ("true", "false"):
            return self.take().lower() == "true"
        raise RuleError(f"expected a value, found {text or 'the end'}")


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])


def _pattern(text: str) -> Pattern:
    try:
        return parse_pattern(text)
    except ValueError as e:
        raise RuleError(str(e)) from e


def _bare(p: Pattern) -> Pattern:
    """A condition keeps a pattern's four name parts only."""
    return Pattern(p.package, p.type, p.method, p.field, text=p.text)


def parse_rules(text: str) -> RuleSet:
    return _Parser(text).rules()


def load_rules(text: str) -> RuleSet:
    """The text form if it begins with RULE (after comments), else YAML."""
    bare = re.sub(r"\A(?:\s+|//[^\n]*|/\*.*?\*/)*", "", text, flags=re.S)
    return parse_rules(text) if re.match(r"RULE\b", bare, re.I) else load_yaml(text)


def load_yaml(text: str) -> RuleSet:
    data = yaml.safe_load(text)
    rules = data.get("rules") if isinstance(data, dict) else None
    if not rules:
        raise RuleError("no rules")
    return RuleSet(tuple(_yaml_rule(r) for r in rules))


def _yaml_rule(rule: dict[str, Any]) -> Rule:
    if not rule.get("name"):
        raise RuleError("a rule has no name")
    if not rule.get("statements"):
        raise RuleError(f"rule {rule['name']} has no statements")
    return Rule(str(rule["name"]), tuple(_yaml_statement(s) for s in rule["statements"]))


def _yaml_pattern(p: Any) -> Pattern:
    if isinstance(p, str):
        return _pattern(p)
    if not isinstance(p, dict):
        raise RuleError("a pattern is missing")
    metric = p.get("metric") or ""
    if metric and metric not in METRICS:
        raise RuleError(f"unknown metric {metric}")
    return Pattern(**{k: str(p.get(k) or "") for k in ("package", "type", "method", "field", "file_path", "language")}, metric=metric, text=str(p.get("text") or ""))


def _yaml_statement(s: dict[str, Any]) -> Statement:
    kind = str(s.get("type", "")).upper()
    if kind not in KINDS:
        raise RuleError(f"unknown statement {s.get('type')}")
    if kind == "LIMIT":
        c = s.get("condition")
        if not c:
            raise RuleError("LIMIT has no condition")
        if c.get("operator") not in OPERATORS:
            raise RuleError(f"unknown operator {c.get('operator')}")
        if c.get("value") is None:
            raise RuleError("the condition has no value")
        p = _yaml_pattern(c.get("pattern"))
        metric = c.get("property") or p.metric
        if metric not in METRICS:
            raise RuleError(f"unknown metric {metric}")
        value = c["value"]
        return Statement(kind, condition=Condition(p, metric, c["operator"], float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value))
    if s.get("from_pattern") is not None or s.get("to_pattern") is not None:
        return Statement(kind, pattern=_yaml_pattern(s.get("from_pattern")), target=_yaml_pattern(s.get("to_pattern")))
    return Statement(kind, pattern=_yaml_pattern(s.get("pattern")))


def to_yaml(rules: RuleSet) -> str:
    """The YAML form of a rule set."""
    part = lambda p: {k: v for k, v in vars(p).items() if v}
    out = []
    for r in rules.rules:
        statements: list[dict[str, Any]] = []
        for s in r.statements:
            if s.condition:
                c = s.condition
                statements.append({"type": s.kind, "condition": {"pattern": part(c.pattern), "property": c.metric, "operator": c.op, "value": c.value}})
            elif s.target and s.pattern:
                statements.append({"type": s.kind, "from_pattern": part(s.pattern), "to_pattern": part(s.target)})
            elif s.pattern:
                statements.append({"type": s.kind, "pattern": part(s.pattern)})
        out.append({"name": r.name, "statements": statements})
    return yaml.safe_dump({"rules": out}, sort_keys=False)
