"""Dictionary rules: tolerant multi-word matching by an equi-join, and user literals.

A rule's words are looked up by deletion variants: two words within k edits share a string
that at most k deletions make of either. The rule table holds, for each rule, the variants
of its longest word (the anchor); document words join on their own variants, the anchor and
then every other word, at its place beside the anchor, is verified by bounded edit distance.
Only the first ``HEAD`` letters are varied: edits behind them don't matter to their variants,
and an edit in them costs each side one deletion at most, so no match is lost. Distinct heads
are varied once each, not once for every word or place where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folding
from ..session import broadcast_if, stored
from .findings import LAYERS

#: Letters of a word that deletion variants are made of.
HEAD = 7


def validate_rules(rules: DataFrame) -> DataFrame:
    """rules(rule_ord, rule_id, find, replacement, exact) trimmed, with ``problem`` (null: good); blank rules are dropped."""
    trimmed = rules.withColumn("find", F.trim(F.coalesce("find", F.lit("")))).withColumn("replacement", F.trim(F.coalesce("replacement", F.lit(""))))
    problem = F.when(F.col("find") == "", "find is blank").when(F.col("replacement") == "", "replacement is blank").when(F.col("find") == F.col("replacement"), "replacement equals find")
    return trimmed.filter("find <> '' or replacement <> ''").withColumn("problem", problem)


def normalize_rules(rules: DataFrame) -> DataFrame:
    """Good rules, one for each comparison form: the last one's content at the first one's place."""
    good = validate_rules(rules).filter("problem is null").withColumn("comparison", folding.comparison(F.col("find"))).filter("comparison <> ''")
    content = F.struct("rule_id", "find", "replacement", "exact")
    one = good.groupBy("comparison").agg(F.max_by(content, "rule_ord").alias("r"), F.min("rule_ord").alias("rule_ord"))
    return one.select("rule_ord", "r.rule_id", "r.find", "r.replacement", F.coalesce("r.exact", F.lit(False)).alias("exact"), "comparison")


def rule_index(rules: DataFrame) -> DataFrame:
    """Normalised rules with their words, tolerances, anchor place and one row for each variant of the anchor."""
    words = folding.tokens(F.col("comparison"))
    held = rules.withColumn("words", words).filter(F.size("words") > 0)
    longest = F.expr("array_max(transform(words, w -> length(w)))")
    held = held.withColumn("anchor", (F.array_position(F.expr("transform(words, w -> length(w))"), longest) - 1).cast("int"))
    held = held.withColumn("tolerances", F.expr("transform(words, w -> CASE WHEN exact THEN 0 WHEN length(w) < 5 THEN 0 WHEN length(w) < 8 THEN 1 ELSE 2 END)"))
    head = F.substring(F.get("words", F.col("anchor")), 1, HEAD)
    return held.withColumn("variant", F.explode(folding.deletion_variants(head, F.get("tolerances", F.col("anchor")))))


def unit_words(units: DataFrame) -> DataFrame:
    """doc_id, unit_ix, word_ix, start, raw, word: every word of every unit with its place and folded form.

    A text is split at marks put around its words; the places are a running sum of the pieces' lengths.
    """
    mark = "\x01"
    clean = F.translate(F.col("text"), "\x01\x02", "  ")
    pieces = F.split(F.regexp_replace(clean, r"([\p{L}\p{N}]+)", f"{mark}$1{mark}"), mark)
    cut = units.filter("text is not null").select("doc_id", "unit_ix", F.posexplode(pieces).alias("p", "raw"))
    start = F.coalesce(F.sum(F.length("raw")).over(W.partitionBy("doc_id", "unit_ix").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = cut.withColumn("start", start).filter("p % 2 = 1")
    return placed.select("doc_id", "unit_ix", ((F.col("p") - 1) / 2).cast("int").alias("word_ix"), "start", "raw", folding.comparison(F.col("raw")).alias("word"))


def match_rules(units: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, unit_ix, rule_ord, rule_id, start, end, raw: tolerant matches of normalised rules, without overlap within a rule.

    The distinct words decide which units can match at all; only those units' words get
    their places, so a corpus with few matches isn't sorted by place.
    """
    index = broadcast_if(rule_index(rules))
    held = units.filter("text is not null").select("doc_id", "unit_ix", F.explode(F.array_distinct(folding.tokens(F.col("text")))).alias("raw"))
    # stored, so that the texts are read for it once and each distinct word is folded once, not again in every use of its folded form
    vocabulary = stored(held.select("raw").distinct().withColumn("word", folding.comparison(F.col("raw"))))
    # a word can only match an anchor of about its length, and needs no more deletions than that anchor's tolerance
    edits, size = F.get("tolerances", F.col("anchor")), F.length(F.get("words", F.col("anchor")))
    lengths = index.select(F.explode(F.sequence(F.greatest(size - edits, F.lit(1)), size + edits)).alias("length"), edits.alias("edits")).groupBy("length").agg(F.max("edits").alias("edits"))
    sized = vocabulary.select("word", F.substring("word", 1, HEAD).alias("head"), F.length("word").alias("length")).distinct().join(broadcast_if(lengths), "length")
    heads = sized.groupBy("head").agg(F.max("edits").alias("edits"))
    vary = heads.select("head", F.explode(folding.deletion_variants(F.col("head"), F.col("edits"))).alias("variant"))
    rules_of = vary.join(index, "variant").select("head", "rule_ord", "rule_id", "words", "tolerances", "anchor").distinct()
    hits = sized.select("word", "head").join(rules_of, "head").drop("head")
    near = hits.filter(F.expr("levenshtein(word, get(words, anchor), get(tolerances, anchor)) between 0 and get(tolerances, anchor)"))
    near = stored(near)  # a few of the distinct words; used twice
    spelled = stored(vocabulary.join(broadcast_if(near.select("word").distinct()), "word", "left_semi").select("raw"))
    likely = held.join(broadcast_if(spelled), "raw", "left_semi").select("doc_id", "unit_ix").distinct()
    words = unit_words(units.join(likely, ["doc_id", "unit_ix"], "left_semi"))
    anchored = words.join(broadcast_if(near), "word").select("doc_id", "unit_ix", "rule_ord", "rule_id", "words", "tolerances", (F.col("word_ix") - F.col("anchor")).alias("first")).filter("first >= 0").distinct()
    each = anchored.select("*", F.posexplode("words").alias("k", "expected")).withColumn("word_ix", F.col("first") + F.col("k"))
    checked = each.join(words, ["doc_id", "unit_ix", "word_ix"]).filter(F.expr("levenshtein(word, expected, get(tolerances, k)) between 0 and get(tolerances, k)"))
    whole = checked.groupBy("doc_id", "unit_ix", "rule_ord", "rule_id", "first", F.size("words").alias("n")).agg(
        F.count(F.lit(1)).alias("ok"), F.min("start").alias("start"), F.max(F.col("start") + F.length("raw")).alias("end")
    ).filter("ok = n")
    order = W.partitionBy("doc_id", "unit_ix", "rule_ord").orderBy("first")
    gaps = whole.withColumn("run", F.sum(F.when(F.col("first") >= F.coalesce(F.lag("first").over(order) + F.col("n"), F.lit(0)), 1).otherwise(0)).over(order))
    # within a run of overlapping places the first is taken, then the next one clear of it
    kept = gaps.groupBy("doc_id", "unit_ix", "rule_ord", "rule_id", "n", "run").agg(F.array_sort(F.collect_list(F.struct("first", "start", "end"))).alias("at"))
    fold = "aggregate(at, cast(array() as array<struct<first:int,start:int,end:int>>), (a, x) -> CASE WHEN size(a) = 0 OR x.first >= element_at(a, -1).first + n THEN concat(a, array(x)) ELSE a END)"
    placed = kept.select("doc_id", "unit_ix", "rule_ord", "rule_id", F.explode(F.expr(fold)).alias("s"))
    texts = units.select("doc_id", "unit_ix", "text")
    return placed.join(texts, ["doc_id", "unit_ix"]).select("doc_id", "unit_ix", "rule_ord", "rule_id", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("raw"))


def rule_findings(matches: DataFrame, rules: DataFrame, layer: str = "rules") -> DataFrame:
    """One finding for each matched rule (or user literal) of a document; its placeholder is the rule's replacement."""
    place = F.struct("unit_ix", "start")
    grouped = matches.groupBy("doc_id", "rule_ord", "rule_id").agg(
        F.min_by("raw", place).alias("value"), F.array_sort(F.collect_set("raw")).alias("variants"), F.count(F.lit(1)).alias("count")
    )
    joined = grouped.join(broadcast_if(rules.select("rule_ord", "replacement", "comparison")), "rule_ord")
    return joined.select(
        "doc_id", F.lit(LAYERS[layer]).alias("layer"), F.col("rule_ord").alias("ord"), F.lit("custom").alias("category"), F.col("comparison").alias("normalized"),
        "value", "variants", "count", F.lit("exact").alias("confidence"), F.lit(None).cast("double").alias("score"), "replacement",
    )


def match_literals(units: DataFrame, rules: DataFrame, limit: int = 10_000) -> DataFrame:
    """doc_id, unit_ix, rule_ord, rule_id, start, end, raw: whole-word places of users' literals, folded.

    A user's list is short; more than ``limit`` literals are refused rather than sent to every task.
    """
    rows = [(r["rule_ord"], r["rule_id"], r["comparison"]) for r in rules.select("rule_ord", "rule_id", "comparison").limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} literals; use match_rules with exact rules")
    shipped = units.sparkSession.sparkContext.broadcast(rows)
    schema = "doc_id long, unit_ix int, rule_ord int, rule_id string, start int, end int, raw string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            out = []
            for doc, unit, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded, where = folding.fold_text(text)
                for order, name, needle in shipped.value:
                    out += [(doc, unit, order, name, a, b, text[a:b]) for a, b in folding.occurrences(text, folded, where, needle)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    ids = units.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("unit_ix").cast("int").alias("unit_ix"), "text")
    return ids.mapInArrow(run, schema)
