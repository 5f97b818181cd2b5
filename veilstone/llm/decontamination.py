"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A text is its runs of letters and digits, lower-cased; shingles are five such words (an
item of fewer words is one shingle). An item of m shingles is sought in windows of m
shingles, or in the whole text where that has fewer. A document is contaminated where some
window's shingle multiset has weighted Jaccard similarity of at least ``SIMILARITY`` with
an item's; weights are multiplicities.

1. Items that share a shingle, directly or in a chain, are one family, so each shingle of
   the benchmark names its family. A window as similar as that holds at least
   2 m s / (1 + s) shingles of the item's family. One scan of the texts looks their
   shingles up; only windows with so many of one family go on, and none that could pass
   is lost.
2. Equal windows become one, whatever documents hold them, and get a 64-bit SimHash. Items
   are indexed by family and size under each of 8 blocks of 8 bits, with every value
   within ``RADIUS`` // 8 bit flips; a window looks its blocks up. Fingerprints within the
   radius agree in a block up to so many bits, so none is missed; items of other families
   are never fetched, however many have the size. The radius is four and a half
   deviations above the distance of windows at 0.8. A whole text shorter than the item
   needs no fingerprint: it meets the items of that size with which it shares a shingle.
3. Candidates are verified on the shingles.

Equal texts are windowed once: one row stands for all of them until the end. Nothing
wider than hits, windows and digests is shuffled while the dense windows stay within the
broadcast bounds; beyond those the texts are joined with them by a shuffle. Broadcast
tables are counted first.

Defined results: a null or empty text holds no window and is clean; an item without
words matches nothing; a null doc_id shows as null; repeated rows are judged alike; of
windows or items that are equally similar all count, and the least start is told; an empty
table gives no rows, an empty benchmark leaves all clean; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .components import components

WORDS, SIMILARITY, RADIUS = 5, 0.8, 23
#: Bounds of what is broadcast: rows of a few numbers, and numbers in the arrays of dense windows.
BROADCAST_ROWS, BROADCAST_STARTS = 500_000, 2_000_000
_WINDOW = ["w1", "w2", "family", "m"]
_TOKENS = r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)"


def _tokenised(table: DataFrame, *columns) -> DataFrame:
    return table.select(*columns, F.expr(_TOKENS).alias("w"))


def _hash(size: int) -> str:
    """Hash of the ``size`` words of w from i on."""
    return f"xxhash64({', '.join(f'get(w, i + {k})' for k in range(size))})"


def _over_shingles(size: int, value: str) -> str:
    """An array of ``value`` for the start i of every run of ``size`` words of w; none has type of the value."""
    return f"transform(CASE WHEN size(w) >= {size} THEN sequence(0, size(w) - {size}) ELSE slice(sequence(0, 0), 1, 0) END, i -> {value})"


def _shingles(size: int) -> str:
    """Hashes of all runs of ``size`` words of w."""
    return _over_shingles(size, _hash(size))


#: 64 bits of an array h of hashes: a bit is set where more than half have it.
_SIMHASH = (
    "aggregate(sequence(0, 63), 0L, (bits, b) -> bits | "
    "CASE WHEN 2 * aggregate(h, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size(h) THEN shiftleft(1L, b) ELSE 0L END)"
)
#: The array h with equal hashes told apart by their occurrence, so that set operations count multiplicities.
_MULTISET = "transform(h, (x, i) -> xxhash64(x, size(filter(slice(h, 1, i), y -> y = x))))"


def _least_shared(m: Column, held: Column, similarity: float) -> Column:
    """Shingles that multisets of m and held shingles share at least where they are so similar."""
    return F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (m + held) - 1e-9).cast("int"))


def items_of(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """item_id, size (words in a shingle), m (shingles), h (their hashes), family (least item_id of it); written."""
    told = _tokenised(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")), "item_id")
    h = F.lit(None).cast("array<bigint>")
    for k in range(1, words + 1):
        h = F.when((F.size("w") >= k) if k == words else (F.size("w") == k), F.expr(_shingles(k))).otherwise(h)
    shaped = told.filter(F.size("w") > 0).select(F.coalesce("item_id", F.lit(work.NO_ID)).alias("item_id"), F.least(F.size("w"), F.lit(words)).alias("size"), h.alias("h"))
    shaped = work.written(shaped.withColumn("m", F.size("h")).distinct(), "benchmark-items")
    held = shaped.select("item_id", F.explode("h").alias("x"))
    links = held.join(held.groupBy("x").agg(F.min("item_id").alias("v")), "x").select(F.col("item_id").alias("u"), "v").distinct()
    roots = components(links).withColumnRenamed("node", "item_id")
    return work.written(shaped.join(roots, "item_id", "left").select("item_id", "size", "m", "h", F.coalesce("root", "item_id").alias("family")), "benchmark-families")


def _digest() -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(work.id_or_least().alias("doc"), _digest().alias("tag"), F.coalesce("text", F.lit("")).alias("text"))


def _hits(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """tag, doc (one of the documents with the text), size, family, total (shingles), p (places of the family's shingles, in order); written."""
    vocabulary = work.written(items.select("family", F.explode("h").alias("x")).distinct(), "benchmark-shingles")
    one = [_over_shingles(k, f"struct({k} as size, i as at, {_hash(k)} as x)") for k in sizes]
    every = F.expr(one[0] if len(one) == 1 else f"concat({', '.join(one)})")
    placed = _tokenised(_tagged(docs), "doc", "tag").select("doc", "tag", F.size("w").alias("n"), F.explode(every).alias("o"))
    placed = placed.select("doc", "tag", "n", "o.size", "o.at", "o.x").join(work.broadcast_if(vocabulary, BROADCAST_ROWS), "x")
    held = placed.groupBy("tag", "size", "family").agg(F.collect_set("at").alias("p"), F.max("n").alias("n"), F.min("doc").alias("doc"))
    return work.written(held.select("tag", "doc", "size", "family", (F.col("n") - F.col("size") + 1).alias("total"), F.sort_array("p").alias("p")), "benchmark-hits")


def _dense(hits: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """tag, doc, size, family, m, starts: where windows of m shingles hold enough of the family; written."""
    kinds = items.select("family", "size", "m").distinct()
    held = hits.join(work.broadcast_if(kinds, BROADCAST_ROWS), ["family", "size"])
    held = held.withColumn("least", _least_shared(F.col("m"), F.least("m", "total"), similarity))
    held = held.filter((F.size("p") >= F.col("least")) & (F.col("total") >= similarity * F.col("m") - 1e-9))
    starts = F.expr(
        "CASE WHEN total < m THEN array(0) ELSE filter(array_distinct(flatten(transform(filter(sequence(0, size(p) - least), i -> get(p, i + least - 1) - get(p, i) < m),"
        " i -> sequence(greatest(0, get(p, i + least - 1) - m + 1), get(p, i))))), s -> s + m <= total) END"
    )
    return work.written(held.select("tag", "doc", "size", "family", "m", starts.alias("starts")).filter(F.size("starts") > 0), "dense-windows")


def _windows(docs: DataFrame, dense: DataFrame, sizes: list[int]) -> DataFrame:
    """tag, start, family, m, h (the window's shingles), and w1, w2 that stand for h; written."""
    rows, starts = dense.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    per_text = dense.groupBy("tag", "doc").agg(F.collect_list(F.struct("size", "family", "m", "starts")).alias("dense"))
    if rows <= BROADCAST_ROWS and starts <= BROADCAST_STARTS:
        per_text = F.broadcast(per_text)
    told = _tokenised(_tagged(docs).join(per_text, ["tag", "doc"]), "tag", "dense")
    all_of = "CASE " + " ".join(f"WHEN d.size = {k} THEN {_shingles(k)}" for k in sizes) + " END"
    told = told.select("tag", F.explode("dense").alias("d"), "w").select("tag", "d", F.expr(all_of).alias("every"))
    cut = "transform(d.starts, s -> struct(s as start, slice(every, s + 1, d.m) as h))"
    told = told.select("tag", F.col("d.family").alias("family"), F.col("d.m").alias("m"), F.explode(F.expr(cut)).alias("o")).select("tag", "family", "m", "o.start", "o.h")
    return work.written(told.withColumn("w1", F.xxhash64("h")).withColumn("w2", F.xxhash64(F.reverse("h"), F.lit(1))), "windows")


def _index(items: DataFrame, radius: int) -> DataFrame:
    """item_id, family, m, item_fp under each b, v (block, value) that a fingerprint within the radius has in one of its blocks."""
    flips = [sum(1 << b for b in c) for n in range(radius // 8 + 1) for c in combinations(range(8), n)]
    probes = items.select("item_id", "family", "m", F.expr(_SIMHASH).alias("item_fp"))
    probes = probes.select("item_id", "family", "m", "item_fp", F.explode(_blocks("item_fp")).alias("o"), F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"))
    return work.written(probes.select("item_id", "family", "m", "item_fp", F.col("o.b"), F.col("o.v").bitwiseXOR(F.col("flip")).alias("v")), "benchmark-index")


def _blocks(fp: str) -> Column:
    return F.expr(f"transform(sequence(0, 7), b -> struct(b, shiftright({fp}, 8 * b) & 255L as v))")


def fetched(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """The windows of m shingles with what the index holds under their blocks: fp, item_id, item_fp added, once for each block that agrees."""
    looked = windows.select(*_WINDOW, F.expr(_SIMHASH).alias("fp")).withColumn("o", F.explode(_blocks("fp")))
    looked = looked.select(*_WINDOW, "fp", F.col("o.b"), F.col("o.v"))
    return looked.join(work.broadcast_if(_index(items, radius), BROADCAST_ROWS), ["family", "m", "b", "v"])


def _matches(windows: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """w1, w2, family, m, item_id, similarity: windows (each once) with the items that they are similar to; written."""
    whole = windows.filter(F.size("h") == F.col("m"))
    near = fetched(whole, items, radius).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*_WINDOW, "item_id")
    pieces = work.written(items.select("item_id", "family", "m", F.explode("h").alias("x")).distinct(), "item-shingles")
    short = windows.filter(F.size("h") < F.col("m")).select(*_WINDOW, F.explode("h").alias("x")).join(work.broadcast_if(pieces, BROADCAST_ROWS), ["family", "m", "x"])
    near = near.union(short.select(*_WINDOW, "item_id")).distinct()
    own = items.select("item_id", "family", "m", F.expr(_MULTISET).alias("item"))
    both = near.join(windows.select(*_WINDOW, F.expr(_MULTISET).alias("held")), _WINDOW).join(own, ["item_id", "family", "m"])
    shared = F.size(F.array_intersect("held", "item")).cast("double")
    checked = both.select(*_WINDOW, "item_id", (shared / (F.col("m") + F.size("held") - shared)).alias("similarity"))
    return work.written(checked.filter(F.col("similarity") >= similarity), "window-matches")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """tag, item_id, start (first word of the window), similarity: each item's best window in each distinct text; written."""
    items = items_of(benchmark)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 1 to 5
    if not sizes:
        return docs.sparkSession.createDataFrame([], "tag binary, item_id long, start int, similarity double")
    windows = _windows(docs, _dense(_hits(docs, items, sizes), items, similarity), sizes)
    distinct = work.written(windows.select(*_WINDOW, "h").dropDuplicates(_WINDOW), "distinct-windows")
    matches = _matches(distinct, items, similarity, radius)
    found = windows.select("tag", "start", *_WINDOW).join(work.broadcast_if(matches, BROADCAST_ROWS), _WINDOW)
    best = found.groupBy("tag", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return work.written(best.select("tag", "item_id", (-F.col("best.back")).cast("int").alias("start"), F.col("best.similarity")), "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids in order), similarity (largest, else 0) for every row of docs."""
    found = leaks(docs, benchmark, **settings)
    per = found.groupBy("tag").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    per = work.written(per, "contaminated")
    every = docs.select(work.id_or_least().alias("doc"), _digest().alias("tag")).join(work.broadcast_if(per, BROADCAST_ROWS), "tag", "left")
    return every.select(
        work.id_or_null("doc").alias("doc_id"),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.transform(F.coalesce("items", F.array().cast("array<long>")), lambda i: F.when(i != work.NO_ID, i)).alias("items"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def keep_rows(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns."""
    found = work.written(leaks(docs, benchmark, **settings).select("tag").distinct(), "leaky")
    return work.without(docs, {"tag": _digest()}, found)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it holds an item, and which (their ids in order, comma-joined)."""
    told = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return told.select("doc_id", "contaminated", "n_items", F.array_join("items", ",").alias("item_ids"), "similarity")
