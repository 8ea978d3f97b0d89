r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in each whole text: at-signs, url schemes, digits, plus
signs and identifier cues. A deterministic local parser then expands each anchor to a boundary on
either side and validates what it finds. Kinds, in order:

email, ip, card, phone: the base kinds. Each is the leftmost non-overlapping matches of its
pattern, less those that fail validation, which aren't tried again at a later start:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\.[0-9]+){3}, parts at most 255
  card   [0-9]([ -]?[0-9])+, 16 to 19 digits that pass Luhn
  phone  \+[0-9][ ().0-9-]+[0-9], 8 to 15 digits
login: what a web address says of a person. The address is expanded from its scheme to the first blank,
  quote or bracket less closing punctuation. Its user information, `scheme://user[:password]@`,
  counts whatever the host; if the host is valid, so do the names after `/~` or `/@`, those after
  `/users/`, `/profile/` and the like, and the values of parameters such as `email` or `session`.
account: letters and digits after an account cue (`IBAN`, `account`, `passport`, `SSN`), 6 to 34
  characters, at least MIN_DIGITS of them digits, an IBAN only with right check digits.
secret: the value after `password=`, `token =` and the like, 8 characters or more, if it looks made
  up (a digit, or a sign between letters, and not a single word of prose); a cloud access key id
  (`AKIA` and 16 capitals or digits); a token with an issuer's prefix; a private key block, up to its
  end line if there is one.
Spans count code points, end exclusive. Kinds may overlap each other. A null or empty text has
none. A text is scanned once from left to right, in time linear in its length but for the lengths of
failing matches, and holds nothing but its spans, so very long texts need no care. Repeated rows,
or rows of one id, each give their row; an empty table gives none; no column but doc_id and text is
read, so extra columns may have any name (redact hands them on).
"""

from __future__ import annotations

import hashlib
import re
from typing import Any

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import map_text

KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
BASE = KINDS[:4]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
RUN = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|#))?\s*[:=#]?\s*([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])", re.I)
SECRET = re.compile(r"""["']?\s*[:=]\s*["']?([^\s"'&,;]{8,})""")
MADE_UP = re.compile(r"[0-9]|[A-Za-z][^A-Za-z0-9.?!)\]'-]+[A-Za-z]|[a-z][A-Z]")
MIN_DIGITS = 4
TOKEN = re.compile(r"[A-Za-z0-9_-]{16,255}(?![A-Za-z0-9_-])")
KEY_BLOCK = re.compile(r"[A-Z0-9 ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\s-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)")
URL = re.compile(r"""[^\s"'<>()\[\]{}|\\^`]+""")
HOST = re.compile(r"(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]{1,5})?\Z")
PERSONAL = re.compile(r"/[~@]([^/?#]+)|/(?:users?|u|profiles?|people|members?|account|in)/([^/?#]+)|[?&;](?:user|username|login|e?mail|phone|session(?:id)?|token|access_token)=([^&;#]+)", re.I)
ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
ACCOUNT_CUES = ("iban", "account", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key")
TOKEN_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "glpat-", "AIza", "eyJ")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "mongodb://", "amqp://")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("d", "0123456789"), ("key", ["AKIA"]), ("prefix", TOKEN_PREFIXES), ("block", ["-----BEGIN "])):
        for w in words:
            found.add_word(w, (kind, len(w)))
    for kind, words in (("login", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def logins(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans of a web address, without its scheme, that name a person."""
    url = text[start:end]
    place = re.split("[/?#]", url, maxsplit=1)[0]
    user, at, host = place.rpartition("@")
    found = [(start, start + len(user))] if at and user else []
    if HOST.match(host):
        found += [(start + m.start(m.lastindex), start + m.end(m.lastindex)) for m in PERSONAL.finditer(url, len(place))]
    return found


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    text = re.sub("[ -]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text)) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # ends: how far each kind has consumed the text (a failing match consumes too)
    email = ip = card = phone = account = secret = login = run_end = 0
    for last, (kind, size) in anchors.iter(text):
        end = last + 1
        at = end - size
        if kind == "d":
            if at < run_end:
                continue
            # the first digit of a run, as any earlier one would have moved run_end
            run_end = RUN.match(text, at).end()
            if at >= card and (m := CARD.match(text, at)):
                card = m.end()
                if m.end() - at >= 16:
                    digits = re.sub("[ -]", "", m.group())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
            if at >= ip and text.startswith(".", run_end) and (m := IP.match(text, at)):
                ip = m.end()
                if all(map(octet, m.group().split("."))):
                    out["ip"].append(m.span())
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, end)):
                email = m.end()
                out["email"].append((start, email))
        elif kind == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "login":
            if end >= login and (m := URL.match(text, end)):
                login = m.end()
                out["login"] += logins(text, end, end + len(m.group().rstrip(".,;:!?*")))
        elif kind == "account":
            if at >= account and (m := ACCOUNT.match(text, end)) and sum(c.isdigit() for c in m.group(1)) >= MIN_DIGITS:
                if text[at:end].lower() != "iban" or iban(m.group(1)):
                    account = m.end(1)
                    out["account"].append(m.span(1))
        elif kind == "secret":
            if at >= secret and (m := SECRET.match(text, end)) and MADE_UP.search(m.group(1)):
                secret = m.end(1)
                out["secret"].append(m.span(1))
        elif kind == "prefix":
            whole = at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_-")
            if whole and at >= secret and (m := TOKEN.match(text, end)) and any(c.isdigit() for c in m.group()):
                secret = m.end()
                out["secret"].append((at, secret))
        elif kind == "block":
            if at >= secret and (m := KEY_BLOCK.match(text, end)):
                secret = m.end()
                out["secret"].append((at, secret))
        elif at >= secret and (m := ACCESS_KEY.match(text, at)):
            secret = m.end()
            out["secret"].append(m.span())
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k in kinds for s, e in found[k]])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by `<kind>`; overlapping spans go as one, by the first's kind."""
    parts, done = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in found[k]):
        if start >= done:
            parts += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and all spans as text."""

    def make() -> Any:
        anchors = automaton()

        def apply(columns: dict[str, list]) -> dict[str, Any]:
            found = [spans(t or "", anchors) for t in columns["text"]]
            counts = {f"n_{k}": [len(f[k]) for f in found] for k in BASE}
            digests = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
            return {"doc_id": columns["doc_id"], **counts, "base_sha256": digests, "spans": [joined(f, KINDS) for f in found]}

        return apply

    return map_text(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redact(docs: DataFrame) -> DataFrame:
    """The columns of docs, with the personal data in text replaced; n_chars, if there, follows. Null texts stay null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, out = docs.columns, to_arrow_schema(docs.schema)

    def run(batches: Any) -> Any:
        import pyarrow as pa

        from loomgraph.llm.common import steps

        anchors, at = automaton(), names.index("text")
        for batch in batches:
            for part in steps(batch, "text"):
                texts = [t if t is None else redacted(t, spans(t, anchors)) for t in part.column(at).to_pylist()]
                columns = [pa.array(texts, out.field(i).type) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(names) if "n_chars" in names else done
