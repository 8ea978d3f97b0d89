r"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are the runs of letters and digits of the lower-cased text. Each mask slides over the
tokens and hashes the positions that it selects, ignoring the others, so that a substituted token
under an ignored position doesn't hide a shared passage. Hashes of benchmark and documents that
agree are hits; around a hit the two texts are compared position by position, and the overlap
counts if some OVERLAP tokens in a row (all of a shorter item) with the hit among them agree in all
but MISMATCHES of their positions.

A Bloom filter of the benchmark's hashes, of 8 MB at most whatever the benchmark's size, drops the
documents' other positions before anything is shuffled; the equality join decides. Hits are
compared as classes of equal surroundings, so a passage that many items or documents share costs one
comparison. Null and empty texts, and items too short for every mask, have no hits; an empty table of
either kind gives no rows. A very long text is one row until its hits are found, and each hit carries
SPAN + 2 * REACH tokens at most. One row per document id and item that overlap; repeated rows count as
one document with all their hits, null ids as one, null item ids as one item. No column but ids and
texts is read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

#: Selected positions are ones. Any MISMATCHES positions of OVERLAP leave one mask clean somewhere,
#: so every overlap of OVERLAP tokens yields a seed.
MASKS = ("11010011", "111101", "1100010011")
OVERLAP, MISMATCHES = 13, 3
SPLIT = r"[^\p{L}\p{N}]+"
#: 64-bit words of the Bloom filter: one for each hash of the benchmark, from 2**17 (1 MB) to 2**20 (8 MB).
LEAST_WORDS, MOST_WORDS = 1 << 17, 1 << 20
SPAN = max(map(len, MASKS))
REACH = OVERLAP - min(map(len, MASKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable isn't expanded in place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """The text's tokens; empty for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")


def seeds(toks: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<mask, pos, h>> of hashed tokens: every mask at every position where it fits, if keep(h)."""
    pairs = F.transform(toks, lambda t, i: F.xxhash64(t, F.get(toks, i + 1)))

    def hashed(g: Column) -> Column:
        return F.concat(*[slid(m, mask, g) for m, mask in enumerate(MASKS)])

    def slid(m: int, mask: str, g: Column) -> Column:
        # sequence() would count down for a short text
        every = F.when(F.size(toks) >= len(mask), F.sequence(F.lit(0), F.size(toks) - len(mask))).otherwise(F.array().cast("array<int>"))

        def key(i: Column) -> Column:
            parts, k = [F.lit(m)], 0
            while k < len(mask):  # two selected neighbours take one hash
                if mask[k : k + 2] == "11":
                    parts.append(F.get(g, i + k))
                    k += 2
                else:
                    parts += [F.get(toks, i + k)] if mask[k] == "1" else []
                    k += 1
            return F.xxhash64(*parts)

        # few positions are kept, so rows are made for those alone
        kept = F.filter(every, lambda i: let_test(key(i))) if keep else every
        return F.transform(kept, lambda i: F.struct(F.lit(m).alias("mask"), i.alias("pos"), key(i).alias("h")))

    def let_test(h: Column) -> Column:
        return F.exists(F.array(h), keep)

    return let(pairs, hashed)


def filter_bits(h: Column, words: int) -> list[tuple[Column, Column]]:
    """For each of the filter's two probes the word and the bit."""
    return [(F.shiftright(h, shift).bitwiseAND(F.lit(words - 1)).cast("int"), F.shiftright(h, low).bitwiseAND(F.lit(63)).cast("int")) for shift, low in ((0, 20), (26, 46))]


def bloom(hashes: DataFrame, words: int) -> DataFrame:
    """One row: the filter of column h as array<bigint> of that many words, however many hashes there are."""
    probes = F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in filter_bits(F.col("h"), words)])
    one = F.expr("shiftleft(1L, p.b)")
    set_words = hashes.select(F.explode(probes).alias("p")).groupBy(F.col("p.w").alias("w")).agg(F.bit_or(one).alias("bits"))
    every = hashes.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(set_words, "w", "left")
    listed = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(listed, lambda s: s["bits"]).alias("filter"))


def filter_words(benchmark: DataFrame) -> int:
    """A power of two, about the number of hashes of the benchmark's tokens."""
    n = benchmark.agg(F.sum(F.size(tokens(F.col("text"))))).first()[0] or 0
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << (len(MASKS) * n).bit_length()))


def hits(docs: DataFrame, benchmark: DataFrame, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' positions that pass the filter (doc_id, text_hash, mask, pos, h, lead, near) and the
    index of the benchmark (item_id, mask, ip, h, width, back, item). near and item hold the tokens
    around a position, as many as a comparison may need and lead or back of them before it, so no row
    grows with its text."""
    words = words or filter_words(benchmark)
    listed = benchmark.select("item_id", tokens(F.col("text")).alias("toks"))

    def placed(toks: Column) -> Column:
        return F.transform(seeds(F.transform(toks, lambda t: F.hash(t))), lambda r: F.struct(r["mask"].alias("mask"), r["pos"].alias("ip"), r["h"].alias("h"), F.least(r["pos"], F.lit(REACH)).alias("back"), around(toks, r["pos"]).alias("item")))

    index = listed.select("item_id", F.least(F.lit(OVERLAP), F.size("toks")).alias("width"), F.explode(placed(F.col("toks"))).alias("s")).select("item_id", "width", "s.*")
    table = bloom(index.select("h"), words)

    def some(bits: Column) -> Callable[[Column], Column]:
        def test(h: Column) -> Column:
            probes = [F.call_function("bit_get", F.get(bits, w), b) for w, b in filter_bits(h, words)]
            return (probes[0] == 1) & (probes[1] == 1)

        return test

    def found(s: Column) -> Column:
        kept = seeds(s["hashes"], some(s["bits"]))
        return F.transform(kept, lambda r: F.struct(r["mask"].alias("mask"), r["pos"].alias("pos"), r["h"].alias("h"), F.least(r["pos"], F.lit(REACH)).alias("lead"), around(s["toks"], r["pos"]).alias("near")))

    def hashed(toks: Column) -> Column:
        return let(F.struct(toks.alias("toks"), F.transform(toks, lambda t: F.hash(t)).alias("hashes"), F.col("bits")), found)

    read = docs.select("doc_id", "text", table.scalar().alias("bits"))
    rows = read.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(let(tokens(F.col("text")), hashed)).alias("s"))
    return rows.select("doc_id", "text_hash", "s.*"), index


def around(toks: Column, pos: Column) -> Column:
    return F.slice(toks, F.greatest(pos - REACH, F.lit(0)) + 1, F.lit(SPAN + 2 * REACH))


def classes(found: DataFrame, index: DataFrame) -> DataFrame:
    """mask, h, lead, near, width, back, item, matched: the pairs of different surroundings that overlap.
    Many documents or items that share a passage share its surroundings, so each pair of them is
    compared once, not once for every document and item."""
    left = found.select("mask", "h", "lead", "near").distinct()
    right = index.select("mask", "h", "width", "back", "item").distinct()
    return verified(left.join(right, ["mask", "h"]))


def verified(met: DataFrame) -> DataFrame:
    """Hits with an overlap around them; matched: the most agreeing positions of a window with the hit.
    Tokens are compared as strings."""
    span = F.element_at(F.array(*[F.lit(len(m)) for m in MASKS]), F.col("mask") + 1)
    before = F.greatest(F.least(F.col("lead"), F.col("back"), F.col("width") - span), F.lit(0))
    ahead = F.least(F.size("near") - F.col("lead"), F.size("item") - F.col("back"), F.col("width"))
    ranged = met.withColumns({"_before": before, "_ahead": ahead})
    equal = F.transform(F.sequence(-F.col("_before"), F.col("_ahead") - 1), lambda k: (F.get("near", F.col("lead") + k) == F.get("item", F.col("back") + k)).cast("int"))
    agree = ranged.withColumn("_agree", equal)
    sums = F.when(F.size("_agree") >= F.col("width"), F.transform(F.sequence(F.lit(0), F.size("_agree") - F.col("width")), lambda s: F.aggregate(F.slice("_agree", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x)))
    return agree.withColumn("matched", F.array_max(sums)).where(F.col("matched") >= F.col("width") - MISMATCHES).drop("_before", "_ahead", "_agree")


def overlaps(docs: DataFrame, benchmark: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, text_hash, item_id, n_hits, matched, position: verified overlaps by document and item.
    The hits are written out first, so that the texts are read once."""
    found, index = hits(docs, benchmark, words)
    found = materialize(found, "hits")
    met = found.join(classes(found, index), ["mask", "h", "lead", "near"]).join(index, ["mask", "h", "width", "back", "item"])
    return met.groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_hits"), F.max("matched").alias("matched"), F.min("pos").alias("position"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_hits, matched, position."""
    found = overlaps(docs, benchmark)
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_hits").alias("n_hits"), F.max("matched").alias("matched"), F.min("position").alias("position"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item; which item doesn't matter, so none is joined. What
    overlaps is written out first: with its size known, the texts are shuffled only if it is too large
    for Spark to broadcast."""
    found, index = hits(docs, benchmark)
    found = materialize(found, "hits")
    key = ["mask", "h", "lead", "near"]
    bad = found.join(classes(found, index).select(key), key, "left_semi")
    bad = materialize(bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "overlaps")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def oracle() -> str:
    """The same overlaps as DuckDB SQL: masked token lists instead of hashes, the same comparison."""
    split = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    keys = lambda toks, pos: " UNION ALL ".join(
        f"SELECT *, {m} AS mask, {len(mask)} AS span, [{', '.join(f'{toks}[{pos} + {k + 1}]' for k, c in enumerate(mask) if c == '1')}] AS key FROM (SELECT *, unnest(range(0, len({toks}) - {len(mask) - 1})) AS {pos} FROM SRC)" for m, mask in enumerate(MASKS)
    )
    return f"""
WITH d AS (SELECT doc_id, {split} AS toks FROM documents), b AS (SELECT item_id, {split} AS item FROM benchmark),
dk AS ({keys('toks', 'pos').replace('SRC', 'd')}), bk AS ({keys('item', 'ip').replace('SRC', 'b')}),
met AS (SELECT dk.doc_id, dk.pos, dk.toks, bk.item_id, bk.ip, bk.item, dk.span, least({OVERLAP}, len(bk.item)) AS width FROM dk JOIN bk ON dk.mask = bk.mask AND dk.key = bk.key),
r AS (SELECT *, greatest(least(pos, ip, {REACH}, width - span), 0) AS back, least(len(toks) - pos, len(item) - ip, width) AS ahead FROM met),
a AS (SELECT *, list_transform(range(-back, ahead), lambda k: (toks[pos + k + 1] = item[ip + k + 1])::INT) AS agree FROM r),
m AS (SELECT *, CASE WHEN len(agree) >= width THEN list_max(list_transform(range(0, len(agree) - width + 1), lambda s: list_sum(agree[s + 1 : s + width]))) END AS matched FROM a)
SELECT doc_id, item_id, count(*) AS n_hits, max(matched)::INT AS matched, min(pos)::INT AS position FROM m WHERE matched >= width - {MISMATCHES} GROUP BY ALL"""
