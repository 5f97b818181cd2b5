"""SimHash near-dedup with pivot distance tables.

Documents become 64-bit fingerprints, equal fingerprints one row. The pivots are a base
reference fingerprint and, for each block of two bits, the base with that block flipped;
a fingerprint's table row holds its Hamming distance to each. Distances to the base and
to a flipped base give the distance within the block, and two fingerprints within
``radius`` differ by at most ``radius`` over all blocks together. So with the blocks in
radius + 3 groups, at least three groups agree in full: the groups' coordinates, three
at a time, are the keys under which candidates meet. A pair whose largest coordinate
difference exceeds the radius is discarded; the others are verified on the bits.

A key under which more than ``CAP`` fingerprints meet is not paired up. Its members go
to their neighbourhoods instead: each fingerprint visits every bit string within half
the radius, and those that meet there are linked to the least of them. Two strings
within the radius share such a midpoint, so no link is lost, and a midpoint is visited
by at most 65 distinct fingerprints (radius 2), so no group grows with the input.

Links become components; a component's id is its smallest doc_id.

``similar_groups`` and ``keep_rows`` link by a similarity of the texts instead: five-word
shingles of which 0.8 or more of both together are the same. Fingerprints of texts that
similar lie 10 of 64 bits apart, and within such a radius chance neighbours grow with the
square of the corpus, so pivot tables alone can't find them. What the tables find within
the small radius is verified by the exact similarity and joins most copies; a prefix-filter
join (``similar_texts``) then proposes every pair between the components that can be
similar, and these are verified too. Only verified links decide, and none is left out.

Defined results: a null text counts as empty: no shingles, fingerprint zero, linked like any
other; fewer words than a shingle give one shingle; a null doc_id is the smallest id and
shows as null; repeated rows share a fingerprint and so a component; an empty table gives no
rows; only doc_id and text are read. By similarity: texts without words are all alike; the
row with the least doc_id stays of each group, of several such the one with the least
digest; rows that repeat doc_id and text stay or go together; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar_texts, work
from .components import components

WORDS, RADIUS, HASH_SEED = 3, 2, 42
#: Shingles and similarity of the links by similarity.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Turns of leaders for common keys, after which every open pair is looked at.
ROUNDS = 3
#: Texts paired with each other, by the least node near them, are cut into parts of about so many shingles (2 MB); the pairs of two parts are verified in one row.
GROUP_SHINGLES = 250_000
CAP = 64
BASE = 0x9E3779B97F4A7C15
BLOCKS = [0b11 << (2 * i) for i in range(32)]
CHUNK = 1 << 16


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """Space-joined runs of words of the text with A-Z lower-cased; the whole where it has fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return iter(())
    if len(found) < words:
        return iter((b" ".join(found),))
    return map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the shingles, big-endian."""
    import xxhash

    return np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=HASH_SEED), shingles(text, words))), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """As a signed 64-bit number. A bit is set where more than half the shingles' hashes have it."""
    return majority(hashes(text, words))


def majority(found: np.ndarray) -> int:
    """The fingerprint of hashes given as rows of eight bytes, big-endian."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += np.unpackbits(found[at : at + CHUNK], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc, fp of every row; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc", "fp"])

    with work.batch_rows(docs.sparkSession, work.ARROW_ROWS):
        return work.written(docs.select(work.id_or_least().alias("doc"), "text").mapInArrow(run, "doc long, fp long"), "fingerprints")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_distances(fp: Column) -> Column:
    """Row of the distance table: Hamming distances to the base and to the base with each block flipped."""
    pivots = F.array(*[F.lit(_signed(p)) for p in [BASE, *(BASE ^ b for b in BLOCKS)]])
    return F.transform(pivots, lambda p: F.bit_count(fp.bitwiseXOR(p)))


def pivot_keys(distinct: DataFrame, radius: int) -> DataFrame:
    """fp, key: one key for each three of the radius + 3 groups of blocks, from the pivot distances.

    A block's coordinate (0, 1 or 2, two bits of the key) is its distance to the base.
    """
    groups = np.array_split(np.arange(len(BLOCKS)), radius + 3)
    table = distinct.select("fp", pivot_distances(F.col("fp")).alias("d"))
    codes = []
    for g, group in enumerate(groups):
        code = F.lit(0).cast("long")
        for i in group:
            within = F.shiftright(F.get("d", F.lit(0)) - F.get("d", F.lit(int(i) + 1)) + 2, 1).cast("long")
            code = F.shiftleft(code, 2).bitwiseOR(within)
        codes.append(code.alias(f"g{g}"))
    coded = table.select("fp", *codes)
    width = 2 * max(len(g) for g in groups)
    join = lambda high, low: F.shiftleft(high, width).bitwiseOR(F.col(f"g{low}"))
    keys = [join(join(join(F.lit(k).cast("long"), a), b), c) for k, (a, b, c) in enumerate(combinations(range(len(groups)), 3))]
    return coded.select("fp", F.explode(F.array(*keys)).alias("key"))


def _neighbourhood(fp: Column, reach: int) -> Column:
    """Every bit string within ``reach`` (0 or 1) of fp."""
    flips = [0] + ([_signed(1 << i) for i in range(64)] if reach else [])
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: fp.bitwiseXOR(f))


def link(distinct: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """u, v: links that connect all of distinct(fp) that lie within the radius of each other."""
    if radius not in (0, 2):
        raise ValueError("the radius is 0 or 2")
    keyed = pivot_keys(distinct, radius)
    met = work.written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met")
    met = keyed.join(met, "key")
    few = work.written(met.filter(F.col("n") <= cap).select("key", "fp"), "met-few")
    pairs = few.alias("a").join(few.alias("b"), "key").filter("a.fp < b.fp").select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    apart = F.array_max(F.zip_with(pivot_distances(F.col("u")), pivot_distances(F.col("v")), lambda x, y: F.abs(x - y)))
    pairs = pairs.filter(apart <= radius).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    many = work.written(met.filter(F.col("n") > cap).select("fp").distinct(), "met-many")
    visits = many.select("fp", F.explode(_neighbourhood(F.col("fp"), radius // 2)).alias("at"))
    least = visits.groupBy("at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = visits.join(least, "at").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc, fp, component (smallest doc reachable) of every row of docs; doc is doc_id or the least long."""
    found = fingerprints(docs, words)
    distinct = work.written(found.groupBy("fp").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    roots = work.written(components(link(distinct.select("fp"), radius)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = work.written(rooted, "rooted")
    ids = work.written(rooted.groupBy("root").agg(F.min("first").alias("component")), "component-ids")
    by_fp = work.written(rooted.join(ids, "root").select("fp", "component"), "fingerprint-components")
    return found.join(by_fp, "fp")


def _digest() -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _nodes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (node, doc, digest), of which the least node of a digest stands for the text; texts (node, doc, digest, fp, n, own, cold, p); copies (node, digest, rep)."""
    spark = docs.sparkSession
    mine = docs.select(F.monotonically_increasing_id().alias("node"), work.id_or_least().alias("doc"), _digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    with work.batch_rows(spark, work.ARROW_ROWS):
        common, counts = similar_texts.common_shingles(mine.select("node", "text"), words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = []
                for text in batch.column(3).to_pylist():
                    every = similar_texts.shingle_hashes(text, words)
                    distinct = np.unique(every).view(np.int64)
                    p, cold, own = similar_texts.prefix(distinct, common, counts, similarity)
                    told.append((majority(every.astype(">u8").view(np.uint8).reshape(-1, 8)), len(distinct), own, cold, p))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[i] for x in told], k) for i, k in enumerate(kinds))], names=["node", "doc", "digest", "fp", "n", "own", "cold", "p"])

        rows = work.written(mine.mapInArrow(run, "node long, doc long, digest binary, fp long, n int, own int, cold int, p array<long>"), "text-rows")
    reps = work.written(rows.groupBy("digest").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "repeated-texts")
    copies = rows.select("node", "digest").join(work.broadcast_if(reps.select("digest", "rep"), work.BROADCAST_ROWS), "digest")
    copies = work.written(copies.select("node", "digest", "rep"), "copies")
    texts = rows
    if copies.limit(1).count():
        texts = rows.join(work.broadcast_if(copies.filter("node <> rep").select("node"), work.BROADCAST_ROWS), "node", "left_anti")
        texts = work.written(texts, "text-nodes")
        slim = work.written(rows.select("node", "doc", "digest"), "row-nodes")
        work.discard(rows)
        return slim, texts, copies
    return rows.select("node", "doc", "digest"), texts, copies


def _fingerprint_pairs(texts: DataFrame, radius: int) -> DataFrame:
    """u > v: pairs that connect the nodes whose fingerprints link by the pivot tables; written."""
    firsts = work.written(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")), "distinct-fingerprints")
    same = texts.select("node", "fp").join(work.broadcast_if(firsts.filter("c > 1"), work.BROADCAST_ROWS), "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = work.written(link(firsts.select("fp"), radius), "fingerprint-links")
    ends = [work.broadcast_if(found, work.BROADCAST_ROWS)]
    for end in ("u", "v"):
        ends.append(ends[-1].join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end))
    apart = ends[-1].select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))
    return work.written(same.union(apart).distinct(), "fingerprint-pairs")


def _similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the written pairs of nodes whose texts are similar; written."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = work.written(texts.select("node", "doc", "digest", "n").join(work.broadcast_if(work.written(wanted, "paired-nodes"), work.BROADCAST_ROWS), "node"), "paired-texts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(similar_texts.shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["node", "h"])

    told = docs.select(work.id_or_least().alias("doc"), _digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    told = told.join(work.broadcast_if(wanted.drop("n"), work.BROADCAST_ROWS), ["doc", "digest"]).select("node", "text").mapInArrow(sets, "node long, h array<long>")
    both = pairs.union(pairs.select("v", "u"))
    first = work.written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("near")).withColumnRenamed("u", "v"), "first-neighbours")
    ends = both.join(work.broadcast_if(first, work.BROADCAST_ROWS), "v").groupBy("u").agg(F.min("near").alias("near")).withColumnRenamed("u", "node")
    ends = work.written(ends.join(work.broadcast_if(wanted.select("node", "n"), work.BROADCAST_ROWS), "node"), "near-nodes")  # the least node within two steps or so: texts of a group mostly share it
    sizes = ends.groupBy("near").agg(F.sum("n").alias("all"))
    met = ends.join(sizes, "near").select("node", "near", F.pmod(F.xxhash64("node"), F.ceil(F.col("all") / GROUP_SHINGLES + 1e-9).cast("long")).alias("part"))
    met = work.broadcast_if(work.written(met, "grouped-nodes"), work.BROADCAST_ROWS)
    blocks = pairs
    for end in ("u", "v"):
        blocks = blocks.join(met.select(F.col("node").alias(end), F.struct("near", "part").alias(f"{end}_at")), end)
    blocks = work.written(blocks, "pair-blocks")
    key = ["u_at", "v_at"]
    needed = blocks.select(F.col("u").alias("node"), *key).union(blocks.select(F.col("v").alias("node"), *key)).distinct()
    needed = work.broadcast_if(work.written(needed, "block-nodes"), work.BROADCAST_ROWS)
    with work.batch_rows(docs.sparkSession, work.ARROW_ROWS):
        # a set goes once to each block that pairs it; repeated rows give equal structs
        held = told.join(needed, "node").groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("node", "h"))).alias("sets"))
        met = blocks.groupBy(*key).agg(F.collect_list(F.struct("u", "v")).alias("pairs")).join(held, key)
        shared = "transform(pairs, p -> struct(p.u as u, p.v as v, size(element_at(sets, p.u)) + size(element_at(sets, p.v)) as n, size(array_intersect(element_at(sets, p.u), element_at(sets, p.v))) as both))"
        alike = F.expr(f"filter({shared}, p -> p.both >= {similarity} * (p.n - p.both) - 1e-9)")
        return work.written(met.select(F.explode(alike).alias("o")).select("o.u", "o.v"), "similar-links")


def _similar_roots(docs: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """node, root for the nodes that have links: the least node that they lead to."""
    state = {"links": None, "seen": None, "roots": None}
    hot = similar_texts.common_nodes(texts)

    def settle(*proposed: DataFrame) -> None:
        pairs = proposed[0]
        for more in proposed[1:]:
            pairs = pairs.union(more)
        pairs = pairs.distinct() if len(proposed) > 1 else pairs
        if state["seen"] is not None:
            pairs = pairs.join(state["seen"], ["u", "v"], "left_anti")
        pairs = work.written(pairs, "candidate-pairs")
        work.release(docs.sparkSession)
        state["seen"] = pairs if state["seen"] is None else state["seen"].union(pairs)
        if not pairs.limit(1).count():
            return
        new = _similar(docs, texts, pairs, words, similarity)
        work.release(docs.sparkSession)
        state["links"] = new if state["links"] is None else work.written(state["links"].union(new), "all-links")
        state["roots"] = work.written(components(state["links"]), "roots")

    def labelled(nodes: DataFrame) -> DataFrame:
        if state["roots"] is None:
            return nodes.withColumn("label", F.col("node"))
        roots = work.broadcast_if(state["roots"], work.BROADCAST_ROWS)
        return nodes.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    def led(turn: int) -> list[DataFrame]:
        keys = similar_texts.large_keys(similar_texts.open_keys(labelled(hot)))
        return [similar_texts.led_pairs(labelled(hot), keys, turn, similarity)] if len(keys) else []

    some = bool(hot.limit(1).count())
    settle(_fingerprint_pairs(texts, radius), *(led(0) if some else []))
    settle(similar_texts.cold_pairs(labelled(texts), similarity), *(led(1) if some else []))
    for turn in range(2, ROUNDS):
        if some and (more := led(turn)):
            settle(*more)
    if some and (keys := similar_texts.open_keys(labelled(hot))).limit(1).count():
        settle(similar_texts.open_pairs(labelled(hot), keys, similarity))
    if state["roots"] is None:
        return texts.select("node", F.col("node").alias("root")).limit(0)
    return state["roots"]


def similar_groups(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc, digest, keep_doc, keep_digest for every row of docs: the text's digest, and the row that stays of its group."""
    rows, texts, copies = _nodes(docs, words, similarity)
    roots = _similar_roots(docs, texts, words, similarity, radius)
    linked = copies.select("digest", F.col("rep").alias("node")).distinct().union(texts.join(work.broadcast_if(roots, work.BROADCAST_ROWS), "node", "left_semi").select("digest", "node")).distinct()
    linked = linked.join(work.broadcast_if(roots, work.BROADCAST_ROWS), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    linked = work.written(linked, "linked-texts")
    members = work.written(rows.join(work.broadcast_if(linked, work.BROADCAST_ROWS), "digest").select("root", "doc", "digest"), "group-rows")
    stays = members.groupBy("root").agg(F.min("doc").alias("doc"))
    stays = members.join(work.broadcast_if(work.written(stays, "least-ids"), work.BROADCAST_ROWS), ["root", "doc"]).groupBy("root", "doc").agg(F.min(F.hex("digest")).alias("keep_digest"))
    stays = work.written(stays.select("root", F.col("doc").alias("keep_doc"), F.unhex("keep_digest").alias("keep_digest")), "staying")
    kept = work.written(linked.join(work.broadcast_if(stays, work.BROADCAST_ROWS), "root").select("digest", "keep_doc", "keep_digest"), "kept-of-texts")
    told = rows.join(work.broadcast_if(kept, work.BROADCAST_ROWS), "digest", "left")
    return told.select("doc", "digest", F.coalesce("keep_doc", "doc").alias("keep_doc"), F.coalesce("keep_digest", "digest").alias("keep_digest"))


def keep_rows(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows of a group that don't stay, with docs' own columns."""
    told = similar_groups(docs, words, similarity, radius)
    gone = work.written(told.filter("doc <> keep_doc or digest <> keep_digest").select("doc", "digest").distinct(), "gone")
    return work.without(docs, {"doc": work.id_or_least(), "digest": _digest()}, gone)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        work.id_or_null("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        work.id_or_null("component").alias("component_id"),
    )
