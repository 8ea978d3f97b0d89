import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomgraph.llm import blocks, decontam, lm, simhash, substring_dedup, token_rollup, url_filter
from loomgraph.llm.common import shared_dir


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").encode().lower().decode()


def test_packing():
    for v in ([], [0], [5, 5, 9], [2**64 - 1], list(range(1000, 5000, 7))):
        a = np.array(v, np.uint64)
        assert (blocks.unpack(blocks.pack(a)) == a).all()
        u = np.unique(a)
        assert (blocks.unpack_sorted(blocks.pack_sorted(u)) == u).all()
    cut = blocks.cuts(np.sort(np.array([0, 1, 2**63, 2**64 - 1], np.uint64)), 4)
    assert cut.tolist() == [0, 2, 2, 3, 4]


@pytest.mark.parametrize("block_bytes", [1 << 30, 50_000])
def test_substring_dedup(docs, rows, none, block_bytes):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_duplicates(docs, block_bytes=block_bytes).collect())
    texts = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    want = Counter()
    for i, w in texts:
        covered = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                covered[k : k + 35] = [True] * 35
        kept = " ".join(x for x, c in zip(w, covered) if not c)
        want[(i, len(w), sum(covered), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want
    assert sum(k[2] * n for k, n in want.items()) > 1000
    assert substring_dedup.remove_duplicates(none).count() == 0


def test_lm_scoring(docs, rows, none):
    got = lm.score(docs, block_bytes=50_000).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    texts = [(i, [*words(lowered(t)), 1]) for i, t in rows]
    train = [w for i, w in texts if not held[i]]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([0, *w], w))
    n, v, history = sum(one.values()), len(one), Counter(one) + Counter({0: len(train)})
    want = Counter()
    for i, w in texts:
        p = lambda x: (one[x] + 1) / (n + v + 1)
        base = sum(math.log10(p(x)) for x in w)
        full = sum(math.log10((two[a, b] + lm.MU * p(b)) / (history[a] + lm.MU)) for a, b in zip([0, *w], w))
        want[(i, held[i], len(w), sum(one[x] > 0 for x in w), n, round(base, 4), round(full, 4))] += 1
    assert Counter((*r[:5], round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    assert lm.score(none).count() == 0


def test_lm_states_sum_to_one():
    rng = np.random.default_rng(1)
    one = rng.integers(1, 50, 30).astype(float)
    n, v = one.sum(), len(one)
    p = np.append(one + 1, 1) / (n + v + 1)  # the last word is unknown
    pairs = np.append(rng.multinomial(40, one / n), 0)
    assert abs(((pairs + lm.MU * p) / (pairs.sum() + lm.MU)).sum() - 1) < 1e-12


def brute_prints(rows):
    out = []
    for _, text in rows:
        w = words(lowered(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


@pytest.mark.parametrize("cell", [20_000, 12])
def test_simhash(docs, rows, cell):
    prints = np.array(brute_prints(rows), np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    component = -np.ones(len(rows), int)
    for i in range(len(rows)):
        stack = [i] if component[i] < 0 else []
        while stack:
            x = stack.pop()
            if component[x] < 0:
                component[x] = i
                stack += np.flatnonzero(close[x]).tolist()
    least = {c: min((rows[i][0] for i in np.flatnonzero(component == c) if rows[i][0] is not None), default=None) for c in set(component.tolist())}
    want = Counter((rows[i][0], f"{prints[i]:016x}", int(close[i].sum()) - 1, least[component[i]]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs, cell).collect()) == want
    kept = simhash.keep_one(docs, cell)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, least.values()))


def test_simhash_pairs_of_synthetic_fingerprints(spark):
    """Every link among fingerprints at planted distances is found once, whatever the block size."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for b in base for d in (1, 2, 3, 4)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3).sum(1) - 1
    classes = spark.createDataFrame([(int(x), 1) for x in prints.view(np.int64)], "fp long, n long")
    import pyarrow as pa

    for n in (1, 5_000_000, 500_000_000):
        rows = simhash.cells(simhash.placed(classes, n), 25)
        found = rows.groupBy("tree", "shard", "a", "b").applyInArrow(lambda t: pa.table(simhash.compare(t)), "fp long, n_near long, root long").groupBy("fp").sum("n_near").collect()
        got = {r[0]: r[1] for r in found}
        assert [got.get(int(x), 0) for x in prints.view(np.int64)] == want.tolist()


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


def test_decontamination(spark, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()
    benchmark = spark.createDataFrame([(1, " ".join(item), "x"), (2, "too short", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, pos string")
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]
    wrong = [w if i % 2 else "other" for i, w in enumerate(item)]
    lead = ["w%d" % i for i in range(30)]
    rows = [
        (1, " ".join([*lead, *item, *lead])), (2, "Alpha, " + "! ".join(item[1:14])), (3, " ".join([*lead, *changed])), (4, " ".join([*lead, *wrong])), (5, " ".join([*lead, *item[:9], *lead])),
        (6, None), (7, ""), (None, " ".join(item)), (8, " ".join(lead)), (1, " ".join([*lead, *item, *lead])), (9, "too short"),
    ]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h string, mask int")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, benchmark).collect()) == [4, 5, 6, 7, 8, 9]
    assert decontam.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.where("false")).count() == 0
    # a full filter lets every position through to the join, and nothing else changes
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, benchmark, words=1).collect()} == {(1, 1), (2, 1), (3, 1), (None, 1)}


def test_url_rules(spark):
    urls = {
        "http://x.net/a": ("x.net", "/a", "net/", "block"), "https://EXAMPLE.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"), "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://b.org/fr/x": ("b.org", "/fr/x", "org/fr/", "allow"), "http://net": ("net", "", None, "allow"), None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
        "http://a.example/Casino/x": ("a.example", "/Casino/x", None, "allow"), "http://a.example/casino/x": ("a.example", "/casino/x", None, "block"), "http://a.example/?b.net/": ("a.example", "/", None, "allow"),
        "http://h/a.zip": ("h", "/a.zip", None, "block"), "x://y://z.net/": ("y:", "//z.net/", None, "allow"), "": ("", "", None, "allow"), "http://é.org/fr/ü\nx": ("é.org", "/fr/ü\nx", "org/fr/", "allow"),
    }
    rows = [(i, u, "t") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, token string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect())
    assert got == Counter({(i, *want): 2 for i, want in enumerate(urls.values())})
    assert url_filter.judge(pages.where("false")).count() == 0


def test_rule_tokens():
    assert url_filter.compile_rule("host", "example.net/en/")[1] == ["example", "net", "en"]
    assert url_filter.compile_rule("pattern", "^page=*^ref=")[1] == ["page", "ref"]
    assert url_filter.compile_rule("pattern", "ads*")[1] == []
    assert url_filter.compile_rule("pattern", "||docs.*^")[1] == ["docs"]


def test_rollups_are_idempotent_and_compact(spark):
    change = "op string, source string, lang string, version string, n_tokens long, was long"
    make = lambda *rows: spark.createDataFrame([(*r, None)[:6] for r in rows], change)
    store = token_rollup.RollupStore(spark, shared_dir(spark, "rollup-test"))
    assert store.totals().count() == 0
    first = make(("insert", "a", "en", "v", 10), ("insert", "a", "en", "v", 5), ("insert", None, None, "v", None))
    assert store.commit("1", first) and not store.commit("1", first)
    assert store.commit("2", make(("revise", "a", "en", "v", 7, 10), ("delete", None, None, "v", None)))
    want = {("a", "en", "v", 2, 12)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want and not store.commit("2", first)
    assert store.commit("3", make(("insert", "b", "de", "v", 1)))
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want | {("b", "de", "v", 1, 1)}
    assert set(store.batches()) == {"1", "2", "3"} and len(set(store.batches().values())) == 1
    with pytest.raises(Exception, match="unknown op"):
        store.commit("4", make(("what", "b", "de", "v", 1)))


def test_token_counts_edge_cases(docs, none, spark):
    labels = spark.createDataFrame([(9008, 0, 0), (9008, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    total = {r.version: r for r in token_rollup.documents_history(docs, labels).collect()}
    assert total["words_v1"].n_docs == docs.count() - 2
    assert token_rollup.documents_history(none, labels).count() == 0
