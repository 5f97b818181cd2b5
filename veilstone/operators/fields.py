"""Labelled fields: values that stand beside, after or below a known label.

Labels come as a table (label, category) in folded form, so another language is another
table. ``DEFAULT_LABELS`` holds common captions of public forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folding
from ..functions.validators import normalized
from ..session import broadcast_if
from .findings import LAYERS
from .patterns import matched_chars

# Captions of public forms, by category.
DEFAULT_LABELS = {
    "person": ("name", "first name", "last name", "surname", "full name", "adi", "soyadi", "adi soyadi", "ad soyad", "anne adi", "baba adi", "musteri adi", "yetkili"),
    "location": ("address", "home address", "city", "district", "adres", "adresi", "il", "ilce", "dogum yeri", "ikametgah"),
    "document_number": ("passport no", "document no", "contract no", "invoice no", "policy no", "belge no", "pasaport no", "seri no", "sozlesme no", "fatura no", "police no", "dosya no"),
}
LONGEST_VALUE = 160
_SEPARATORS = r"^[\s:：\-–—_.|/]*$"


def label_table(spark: SparkSession, labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(label, category) for category, names in (labels or DEFAULT_LABELS).items() for label in names]
    return spark.createDataFrame(rows, "label string, category string")


def acceptable(category: Column, value: Column, is_label: Column) -> Column:
    """Whether a text can be the value of a field of the category."""
    letters, digits = F.regexp_count(value, F.lit(r"\p{L}")), F.regexp_count(value, F.lit(r"\p{N}"))
    words = F.size(F.split(F.trim(value), r"\s+"))
    machine = value.rlike(r"(?i)^(?:https?://|www\.|[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b)")
    shaped = (
        F.when(category == "person", (letters > 0) & (digits == 0) & (words <= 5))
        .when(category == "document_number", (letters + digits >= 4) & (digits > 0))
        .otherwise(letters + digits >= 3)
    )
    return F.coalesce((F.length(value) > 0) & (F.length(value) <= LONGEST_VALUE) & ~value.rlike(_SEPARATORS) & ~is_label & ~machine & shaped, F.lit(False))


def not_covered(values: DataFrame, matches: DataFrame, share: float = 0.8) -> DataFrame:
    """values(doc_id, unit_ix, start, end, ...) of which pattern matches cover less than ``share`` of the characters."""
    overlap = F.least("v.end", "m.end") - F.greatest("v.start", "m.start")
    met = values.alias("v").join(matches.alias("m"), (F.col("v.doc_id") == F.col("m.doc_id")) & (F.col("v.unit_ix") == F.col("m.unit_ix")) & (F.col("m.start") < F.col("v.end")) & (F.col("m.end") > F.col("v.start")))
    key = ["doc_id", "unit_ix", "start", "end"]
    covered = met.groupBy(*[F.col(f"v.{k}").alias(k) for k in key]).agg(F.sum(overlap).alias("covered")).filter(F.col("covered") >= share * (F.col("end") - F.col("start")))
    return values.join(covered.select(*key), key, "left_anti")


def presentable(values: DataFrame, labels: DataFrame, share: float = 0.8) -> DataFrame:
    """values(category, value, ...) that can be field values: of the right shape, no label themselves, and less than ``share`` pattern matches.

    The shape is checked first, in the JVM; only what passes goes to Python.
    """
    form = F.trim(F.regexp_replace(folding.comparison(F.col("value")), "[:：]", ""))
    known = broadcast_if(labels.select(F.col("label").alias("form")).distinct())
    shaped = values.filter(acceptable(F.col("category"), F.col("value"), F.lit(False)))
    named = shaped.withColumn("form", form).join(known, "form", "left_anti").drop("form")
    return named.filter(matched_chars(F.col("value")) < share * F.length("value"))


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s:：,;|]+|[\s,;|]+$", "")


def same_line(units: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, unit_ix, line_ix, category, value: ``label: value`` up to the next label or the line's end.

    Every "words:" of a line is looked up among the labels (longest ending first), so the
    work is one pass over the lines and an equi-join, whatever the number of labels.
    """
    lines = units.filter(F.col("text").rlike("[:：]")).select("doc_id", "unit_ix", F.posexplode(F.split("text", r"\r?\n")).alias("line_ix", "line"))
    lines = lines.filter(F.col("line").rlike("[:：]"))
    parts = lines.select("doc_id", "unit_ix", "line_ix", F.posexplode(F.split("line", "[:：]")).alias("part", "body"))
    words = F.split(folding.comparison(F.col("body")), " ")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(4))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("label")))
    looked = parts.select("doc_id", "unit_ix", "line_ix", "part", F.explode(ends).alias("e")).select("doc_id", "unit_ix", "line_ix", "part", "e.n", "e.label")
    found = looked.join(broadcast_if(labels), "label").groupBy("doc_id", "unit_ix", "line_ix", "part").agg(F.max_by(F.struct("category", "n"), "n").alias("f"))
    order = W.partitionBy("doc_id", "unit_ix", "line_ix").orderBy("part")
    joined = parts.join(found, ["doc_id", "unit_ix", "line_ix", "part"], "left")
    ahead = joined.withColumn("next_body", F.lead("body").over(order)).withColumn("next_n", F.lead("f.n").over(order)).withColumn("last", F.lead("part").over(order).isNull())
    ahead = ahead.withColumn("after", F.lead("last").over(order))
    closed = F.coalesce(F.col("after"), F.lit(True))
    # a value that ends in a label, or in an unlisted word before a colon, loses that ending
    cut = F.when(F.col("next_n").isNotNull(), F.regexp_replace("next_body", r"(?:[\p{L}\p{N}]+[\s._-]*)$", "")).when(~closed & (F.col("f.category") != "location"), F.regexp_replace("next_body", r"\s*[\p{L}\p{N}]+\s*$", "")).otherwise(F.col("next_body"))
    many = F.when(F.col("next_n") > 1, F.expr("regexp_replace(next_body, concat('(?:[\\\\p{L}\\\\p{N}]+[\\\\s._-]*){', next_n, '}$'), '')")).otherwise(cut)
    electronic = (F.col("f.category") == "location") & F.col("body").rlike(r"(?i)(?:e-?mail|e-?posta|ip|mac|web|url)\s+\S+\s*$")
    return ahead.filter(F.col("f").isNotNull() & F.col("next_body").isNotNull() & ~electronic).select("doc_id", "unit_ix", "line_ix", F.col("f.category").alias("category"), _trimmed(many).alias("value"))


def neighbours(units: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, unit_ix, category, value: a unit that is just a label takes the next unit, or the one after separators."""
    order = W.partitionBy("doc_id").orderBy("unit_ix")
    data = F.coalesce(F.col("is_data"), F.lit(False)) if "is_data" in units.columns else F.lit(False)
    told = units.select("doc_id", "unit_ix", "text", data.alias("is_data"), F.trim(F.regexp_replace(folding.comparison(F.col("text")), "[:：]", "")).alias("label"))
    told = told.withColumn("n1", F.lead("text", 1).over(order)).withColumn("n2", F.lead("text", 2).over(order)).withColumn("i1", F.lead("unit_ix", 1).over(order)).withColumn("i2", F.lead("unit_ix", 2).over(order))
    over = F.col("n1").rlike(_SEPARATORS)
    return told.filter("not is_data").join(broadcast_if(labels), "label").select(
        "doc_id", F.when(over, F.col("i2")).otherwise(F.col("i1")).alias("unit_ix"), "category", F.trim(F.when(over, F.col("n2")).otherwise(F.col("n1"))).alias("value")
    )


def data_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """cells(doc_id, unit_ix, grid, row, column, text) with is_label, is_data.

    A cell is data in a grid wider than three columns, or where the cell below is no label.
    """
    known = broadcast_if(labels.select(F.col("label").alias("form")).distinct().withColumn("is_label", F.lit(True)))
    told = cells.withColumn("form", F.trim(F.regexp_replace(folding.comparison(F.col("text")), "[:：]", ""))).join(known, "form", "left").withColumn("is_label", F.coalesce("is_label", F.lit(False)))
    wide = F.max("column").over(W.partitionBy("doc_id", "grid")) + 1 > 3
    below = W.partitionBy("doc_id", "grid", "column").orderBy("row")
    follows = (F.lead("row").over(below) == F.col("row") + 1) & ~F.lead("is_label").over(below)
    return told.withColumn("is_data", wide | F.coalesce(follows, F.lit(False))).drop("form")


def column_headers(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, unit_ix, category, value of cells below a label, down to the first blank or gap (gaps and islands)."""
    told = cells.withColumn("label", F.trim(F.regexp_replace(folding.comparison(F.col("text")), "[:：]", ""))).join(broadcast_if(labels), "label", "left")
    down = W.partitionBy("doc_id", "grid", "column").orderBy("row")
    stop = F.col("category").isNotNull() | (F.trim(F.coalesce("text", F.lit(""))) == "") | (F.col("row") - F.lag("row").over(down) > 1)
    runs = told.withColumn("run", F.sum(F.when(F.coalesce(stop, F.lit(True)), 1).otherwise(0)).over(down))
    heads = runs.withColumn("head", F.first("category").over(W.partitionBy("doc_id", "grid", "column", "run").orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    values = heads.filter("head is not null and category is null").select("doc_id", "unit_ix", F.col("head").alias("category"), F.trim("text").alias("value"))
    return values.filter(acceptable(F.col("category"), F.col("value"), F.lit(False)))


def field_findings(values: DataFrame) -> DataFrame:
    """Findings of values(doc_id, unit_ix, category, value); here count is the number of distinct variants."""
    named = values.withColumn("normalized", normalized(F.col("category"), F.col("value")))
    grouped = named.groupBy("doc_id", "category", "normalized").agg(F.min_by("value", "unit_ix").alias("value"), F.array_sort(F.collect_set("value")).alias("variants"), F.min("unit_ix").alias("first"))
    return grouped.select(
        "doc_id", F.lit(LAYERS["fields"]).alias("layer"), F.row_number().over(W.partitionBy("doc_id").orderBy("first", "category", "normalized")).alias("ord"),
        "category", "normalized", "value", "variants", F.size("variants").cast("long").alias("count"), F.lit("probable").alias("confidence"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("replacement"),
    )
