"""Operators 3 and 4 and the pipeline against versions written anew, one document at a time, in plain Python."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from loomgraph.llm import pii, quality_crf, quality_gbt, queries

SMALL = "/root/testdata/sf0.001"
BLANK = "[ \t\n\x0b\x0c\r]+"


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


# ---- 4: statistics, trees, decision


def gbt_features(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = sum(any(seen[tuple(w[k : k + 3])] > 1 for k in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w)))
    n, chars = len(w), sum(map(len, w))
    some, size = max(n, 1), max(chars, 1)
    count = lambda chars_: sum(c in chars_ for c in text)
    dup = len(lines) - len(set(lines))
    base = [n, chars, count("#*$%&|<>"), dup, repeated]
    return base, [
        math.log1p(n), chars / some, base[2] / some, dup / max(len(lines), 1), repeated / some, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count("|") / some, count("!") / some,
        count("0123456789") / size, len(set(w)) / some, n / max(len(lines), 1), count(".,") / some,
    ]


def gbt_score(trees, x):
    total = trees.prior
    for features, thresholds, leaves in zip(trees.feature.tolist(), trees.threshold.tolist(), trees.leaf.tolist()):
        k = 0
        while k < len(features):
            k = 2 * k + (2 if x[features[k]] > thresholds[k] else 1)
        total += leaves[k - len(features)]
    return 1 / (1 + math.exp(-total))


def gbt_kept(trees, text):
    (n, *_, repeated), x = gbt_features(text)
    failed = n < 50 or 100 * repeated > 50 * n
    return failed, not failed and gbt_score(trees, x) >= 0.3


def test_quality_rules(spark, docs, rows):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality_gbt.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_gbt.judge(docs, trees).collect())
    assert got == Counter((i, *gbt_features(t)[0], *gbt_kept(trees, t)) for i, t in rows)
    assert {k[-1] for k in got} == {True, False} and any(not k[-2] and not k[-1] for k in got)


def test_quality_rules_training_set_is_what_is_documented(spark):
    """The fit sees the labelled documents whose remainder isn't 0, and no others."""
    table, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = [r.doc_id for r in labels.collect() if crc(r.doc_id) % 5]
    a = quality_gbt.train(table, labels)
    b = quality_gbt.train(table, labels.where(labels.doc_id.isin(kept)))
    assert (a.leaf == b.leaf).all() and len(kept) < labels.count()


# ---- 3: line features, sums over all labellings


def crf_lines(text):
    rows, lines, before = [], set(), set()
    for line in (text or "").split("\n"):
        raw, w = line.encode(), words(line)
        n, size, kinds = len(w), len(line.encode()), set(w)
        share = lambda chars: sum(c in chars.encode() for c in raw) / max(size, 1)
        rows.append([
            math.log1p(size), math.log1p(n), size / n / 10 if n else 0.0, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>"), line.count("!") / max(n, 1), line.count("|") / max(n, 1),
            len(kinds) / max(n, 1), len(kinds & before) / max(n, 1), float(raw.rstrip()[-1:] in (b".", b"?", b'"')), float(raw[:1].decode("latin1").isupper() and raw[:1] < b"\x80"), float(n > 0 and line in lines), float(n == 0),
        ])
        lines.add(line)
        before |= kinds
    return rows, [len(x.encode()) for x in (text or "").split("\n")]


def crf_score(chain, text):
    """Every labelling of the lines is enumerated for short texts; longer ones take sums line by line."""
    rows, sizes = crf_lines(text)
    x = [[(v - m) / s for v, m, s in zip(r, chain.mean.tolist(), chain.scale.tolist())] for r in rows]
    zero = [0.0] * len(x[0])
    good = []
    for i, own in enumerate(x):
        full = own + (x[i - 1] if i else zero) + (x[i + 1] if i + 1 < len(x) else zero) + [float(i == 0), float(i + 1 == len(x)), 1.0]
        good.append(sum(a * b for a, b in zip(full, chain.weights.tolist())))
    step = chain.transition.tolist()
    if len(good) <= 8:
        weights = {y: math.exp(sum(g for g, k in zip(good, y) if k) + sum(step[a][b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(good))}
        total = sum(weights.values())
        marginal = [sum(v for y, v in weights.items() if y[i]) / total for i in range(len(good))]
    else:
        forward, backward = [[1.0, math.exp(good[0])]], [[1.0, 1.0]]
        for g in good[1:]:
            a = [sum(forward[-1][j] * math.exp(step[j][k]) for j in (0, 1)) * (math.exp(g) if k else 1.0) for k in (0, 1)]
            forward.append([v / sum(a) for v in a])
        for g in good[:0:-1]:
            b = [sum(math.exp(step[k][j]) * (math.exp(g) if j else 1.0) * backward[-1][j] for j in (0, 1)) for k in (0, 1)]
            backward.append([v / sum(b) for v in b])
        marginal = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward[::-1])]
    return sum(m * (s + 1) for m, s in zip(marginal, sizes)) / sum(s + 1 for s in sizes)


def test_quality_classifier(spark, docs, rows):
    chain = quality_crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = sorted(((str(r.doc_id), r.held_out, r.score, r.predicted) for r in quality_crf.classify(docs, chain).collect()), key=lambda r: (r[0], r[2]))
    want = sorted(((str(i), crc(i) % 5 == 0, crf_score(chain, t)) for i, t in rows), key=lambda r: (r[0], r[2]))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 and g[3] == int(g[2] >= 0.3) for g, w in zip(got, want))


# ---- the pipeline


def fingerprint(text):
    w = words((text or "").encode().lower().decode())
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def overlap(doc, item):
    """13 tokens in a row of both with 3 differences at most; candidates share some token at the same offset."""
    places = {}
    for k, t in enumerate(item):
        places.setdefault(t, []).append(k)
    shifts = Counter(p - k for p, t in enumerate(doc) for k in places.get(t, ()))
    for shift, n in shifts.items():
        if n >= 10:
            same = [doc[k + shift] == t if 0 <= k + shift < len(doc) else None for k, t in enumerate(item)]
            if any(None not in same[k : k + 13] and sum(same[k : k + 13]) >= 10 for k in range(len(item) - 12)):
                return True
    return False


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def clean(text):
    """Base kinds by their patterns; the kinds that the method adds are the operator's own."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    valid = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    found = [(*m.span(), kind) for kind, form in FORMS.items() for m in re.finditer(form, text) if valid[kind](m.group())]
    own = pii.spans(text, pii.automaton())
    found += [(a, b, kind) for kind in pii.KINDS[4:] for a, b in own[kind]]
    out, done = "", 0
    for a, b, kind in sorted(found):
        if a >= done:
            out += text[done:a] + f"<{kind}>"
        done = max(done, b)
    return out + text[done:]


def test_pipeline(spark):
    """Rules, one of each group of near copies, no benchmark overlaps, redaction, and the library's encoding."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{queries.TOKENIZERS}/{queries.BPE_FILE}")
    table, labels, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    trees = quality_gbt.train(table, labels)
    good = [(r.doc_id, r.text) for r in table.collect() if gbt_kept(trees, r.text)[1]]
    prints = [fingerprint(t) for _, t in good]
    group = list(range(len(good)))
    for _ in good:
        group = [min(group[j] for j in range(len(good)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(good))]
    first = {}
    for doc, g in zip(good, group):
        first[g] = min(first.get(g, doc), doc)
    items = [tokens(r.text) for r in benchmark.collect()]
    want = {}
    for i, t in first.values():
        if not any(overlap(tokens(t), item) for item in items):
            ids = library.encode(clean(t), add_special_tokens=False).ids
            want[i] = (len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and 0 < len(want) < len(first) < len(good) < table.count()
