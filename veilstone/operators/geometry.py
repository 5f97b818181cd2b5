"""Page layout: runs to text, spans to boxes, label columns by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if

#: How far left of its label a cell may begin.
SLACK = 5

def page_text(runs: DataFrame) -> DataFrame:
    """runs(doc_id, page, run_ix, str, x, right, y, height, eol) with sep, start and end in the page's text.

    Between runs stands a line break (explicit, or a vertical step of over 0.65 of the line
    height), a space (a gap of over 0.16 of it), or nothing where a side has white space.
    """
    order = W.partitionBy("doc_id", "page").orderBy("run_ix")
    prev = lambda c: F.lag(c).over(order)
    height = F.greatest(F.col("height"), prev("height"))
    spaced = prev("str").rlike(r"\s$") | F.col("str").rlike(r"^\s")
    sep = (
        F.when(prev("str").isNull(), "")
        .when(F.coalesce(prev("eol"), F.lit(False)) | (F.abs(F.col("y") - prev("y")) > height * 0.65), "\n")
        .when(spaced, "").when(F.col("x") - prev("right") > height * 0.16, " ").otherwise("")
    )
    told = runs.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("str")).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return told.withColumn("end", end).withColumn("start", (F.col("end") - F.length("str")).cast("int"))


def assemble(placed: DataFrame) -> DataFrame:
    """doc_id, page, text of ``page_text``'s runs; a page's runs meet in one row."""
    lists = placed.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("run_ix", "sep", "str"))).alias("r"))
    return lists.select("doc_id", "page", F.array_join(F.transform("r", lambda r: F.concat(r["sep"], r["str"])), "").alias("text"))


def words_to_text(words: DataFrame) -> DataFrame:
    """words(doc_id, page, word_ix, str), blank ones dropped, with start and end when joined by single spaces."""
    kept = words.withColumn("str", F.trim("str")).filter("str <> ''")
    end = (F.sum(F.length("str") + 1).over(W.partitionBy("doc_id", "page").orderBy("word_ix").rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")
    return kept.withColumn("end", end).withColumn("start", (F.col("end") - F.length("str")).cast("int"))


def span_boxes(spans: DataFrame, layout: DataFrame, margin: float = 0.5) -> DataFrame:
    """Boxes that cover spans(doc_id, page, span_ix, start, end, label) on layout(doc_id, page, run_ix, start, end, x, y, width, height, kind).

    An interval-overlap join within a page. A text run is covered in proportion to the
    characters hit, widened by a margin where it is hit in part; a recognised word is
    covered whole. Only a span's first box carries the label.
    """
    met = spans.alias("s").join(layout.alias("r"), (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.page") == F.col("r.page")) & (F.col("s.start") < F.col("r.end")) & (F.col("s.end") > F.col("r.start")))
    length = F.col("r.end") - F.col("r.start")
    first, last = F.greatest("s.start", "r.start") - F.col("r.start"), F.least("s.end", "r.end") - F.col("r.start")
    unit = F.col("r.width") / length
    whole = F.col("r.kind") == "word"
    left = F.when(whole, F.col("r.x")).otherwise(F.greatest(F.col("r.x"), F.col("r.x") + unit * first - F.when(first > 0, unit * margin).otherwise(0)))
    right = F.when(whole, F.col("r.x") + F.col("r.width")).otherwise(F.least(F.col("r.x") + F.col("r.width"), F.col("r.x") + unit * last + F.when(last < length, unit * margin).otherwise(0)))
    boxes = met.select(F.col("s.doc_id"), F.col("s.page"), F.col("s.span_ix"), F.col("r.run_ix"), left.alias("left"), F.col("r.y").alias("top"), F.greatest(right - left, F.lit(1.0)).alias("width"), F.greatest(F.col("r.height"), F.lit(1.0)).alias("height"), F.col("s.label"))
    place = F.row_number().over(W.partitionBy("doc_id", "page", "span_ix").orderBy("run_ix"))
    return boxes.withColumn("label", F.when(place == 1, F.col("label")))


def layout_cells(runs: DataFrame, gap: float = 1.2, least: float = 10.0) -> DataFrame:
    """runs(doc_id, page, line, str, x, right, size) joined to cells: a wide horizontal gap starts a new one."""
    order = W.partitionBy("doc_id", "page", "line").orderBy("x")
    wide = F.col("x") - F.lag("right").over(order) > F.greatest(F.col("size") * gap, F.lit(least))
    cut = runs.withColumn("cell", F.sum(F.when(F.coalesce(wide, F.lit(True)), 1).otherwise(0)).over(order))
    return cut.groupBy("doc_id", "page", "line", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda r: r["str"]), " ").alias("text"), F.min("x").alias("x"), F.max("right").alias("right")
    )


def assign_columns(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells under header cells by position: doc_id, page, line, category, text.

    A line with two or more labels is a header; its labels own the ranges of x from one to
    the next. The following lines map into them until an empty line, another header or a
    line with fewer than two cells in ranges.
    """
    from ..functions.folding import comparison

    told = cells.withColumn("form", F.trim(F.regexp_replace(comparison(F.col("text")), "[:：]", ""))).join(broadcast_if(labels.withColumnRenamed("label", "form")), "form", "left").drop("form")
    line = W.partitionBy("doc_id", "page", "line")
    told = told.withColumn("header", F.count("category").over(line) >= 2)
    heads = told.filter("header and category is not null")
    heads = heads.select("doc_id", "page", F.col("line").alias("head"), "category", F.col("x").alias("from"), F.coalesce(F.lead("x").over(W.partitionBy("doc_id", "page", "line").orderBy("x")), F.lit(float("inf"))).alias("to"))
    down = W.partitionBy("doc_id", "page").orderBy("line")
    lines = told.groupBy("doc_id", "page", "line").agg(F.bool_or("header").alias("is_head")).withColumn("head", F.last(F.when(F.col("is_head"), F.col("line")), ignorenulls=True).over(down))
    lines = lines.withColumn("step", F.col("line") - F.coalesce(F.lag("line").over(down), F.col("line") - 1))
    body = told.join(lines, ["doc_id", "page", "line"]).filter("not is_head and head is not null")
    met = body.alias("b").join(heads.alias("h"), (F.col("b.doc_id") == F.col("h.doc_id")) & (F.col("b.page") == F.col("h.page")) & (F.col("b.head") == F.col("h.head")) & (F.col("b.x") < F.col("h.to")) & (F.col("b.x") >= F.col("h.from") - SLACK))
    nearest = F.row_number().over(W.partitionBy("b.doc_id", "b.page", "b.line", "b.cell").orderBy(F.abs(F.col("b.x") - F.col("h.from"))))
    hit = met.withColumn("nearest", nearest).filter("nearest = 1").select("b.doc_id", "b.page", "b.line", "b.head", "b.step", "h.category", "b.text")
    aligned = hit.groupBy("doc_id", "page", "head", "line").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("step"))
    every = lines.filter("not is_head and head is not null").join(aligned.select("doc_id", "page", "line", "n"), ["doc_id", "page", "line"], "left")
    island = W.partitionBy("doc_id", "page", "head").orderBy("line")
    stopped = F.max(F.when((F.coalesce("n", F.lit(0)) < 2) | (F.col("step") > 1), 1).otherwise(0)).over(island.rowsBetween(W.unboundedPreceding, 0))
    going = every.withColumn("stopped", stopped).filter("stopped = 0").select("doc_id", "page", "line")
    return hit.join(going, ["doc_id", "page", "line"], "left_semi").select("doc_id", "page", "line", "category", "text")


def recognised_words(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, blocks array of (paragraphs of (lines of (words of (str, confidence))))) as one row a word, in reading order."""
    words = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda x: x["words"]))))))
    return pages.select("doc_id", "page", F.posexplode(words).alias("word_ix", "w")).select("doc_id", "page", "word_ix", F.trim("w.str").alias("str"), "w.confidence").filter("str <> ''")


def annotation_values(annotations: DataFrame) -> DataFrame:
    """annotations(doc_id, page, ann_ix, field_value array, button_value, alt_text, contents, title) as form units: one row for each value that isn't blank."""
    values = F.concat(F.coalesce("field_value", F.array().cast("array<string>")), F.array("button_value", "alt_text", "contents", "title"))
    held = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))
    return annotations.select("doc_id", "page", "ann_ix", F.posexplode(held).alias("value_ix", "value"))


def needs_recognition(page_text_: str = "text", images: str = "images", least: int = 8):
    """Whether a page goes to a recogniser: hardly any text, and an image."""
    return (F.length(F.regexp_replace(page_text_, r"\s", "")) < least) & (F.col(images) > 0)
