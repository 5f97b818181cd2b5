"""A document's and a prompt's way through the engine.

units -> (rules, patterns, file name, labelled fields, entities) -> merged and numbered
findings -> decision -> masked units with their spans -> counts and audit summary.
The findings are stored once, for masking, decisions and audit; the masked text and the
counts come from one table of spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, fields, findings, governance, masking, patterns, rules
from ..session import stored


@dataclass
class Scan:
    """What a scan gives: the units that are masked (file names too), numbered findings, and warnings by document."""

    units: DataFrame
    findings: DataFrame
    warnings: DataFrame | None = None


def _with_data(units: DataFrame, cells: DataFrame | None, labels: DataFrame) -> DataFrame:
    """units whose data cells are marked, so that they aren't read as labels."""
    if cells is None:
        return units
    data = fields.data_cells(cells, labels).groupBy("doc_id", "unit_ix").agg(F.bool_or("is_data").alias("is_data"))
    return units.drop("is_data").join(data, ["doc_id", "unit_ix"], "left")


def scan(
    units: DataFrame, rule_table: DataFrame | None = None, labels: DataFrame | None = None, tokens: DataFrame | None = None, names: DataFrame | None = None,
    cells: DataFrame | None = None, literals: DataFrame | None = None,
) -> Scan:
    """Runs the layers that have their input: normalised rules, labels, a table of model tokens, file-name units, table cells, normalised user literals."""
    layers = []
    if rule_table is not None:
        layers.append(rules.rule_findings(rules.match_rules(units, rule_table), rule_table))
    layers.append(findings.aggregate_findings(patterns.detect(units)))
    if names is not None:
        layers.append(findings.aggregate_findings(patterns.detect(names), "filename"))
    if labels is not None:
        told = [fields.same_line(units, labels).select("doc_id", "unit_ix", "category", "value"), fields.neighbours(_with_data(units, cells, labels), labels).select("doc_id", "unit_ix", "category", "value")]
        if cells is not None:
            told.append(fields.column_headers(cells, labels).select("doc_id", "unit_ix", "category", "value"))
        values = told[0]
        for t in told[1:]:
            values = values.union(t)
        layers.append(fields.field_findings(fields.presentable(values, labels)))
    warnings = None
    if tokens is not None:
        good = tokens.filter("status = 'ok'") if "status" in tokens.columns else tokens
        layers.append(entities.entity_findings(entities.resolve_overlaps(entities.settle(entities.group_tokens(good), units))))
        if "status" in tokens.columns:
            warnings = tokens.filter("status <> 'ok'").groupBy("doc_id").agg(F.first("status").alias("warning"))
    if literals is not None:
        layers.append(rules.rule_findings(rules.match_literals(units, literals), literals, "literals"))
    every = units.select("doc_id", "unit_ix", "text", *(["allowed"] if "allowed" in units.columns else []))
    if names is not None:
        every = every.unionByName(names, allowMissingColumns=True)
    return Scan(every, stored(findings.number_placeholders(findings.merge_layers(*layers))), warnings)


def decide(scanned: Scan, documents: DataFrame) -> DataFrame:
    """doc_id, findings, decision for every row of documents(doc_id); a warning blocks."""
    n = scanned.findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"))
    told = documents.select("doc_id").join(n, "doc_id", "left")
    told = told.join(scanned.warnings, "doc_id", "left") if scanned.warnings is not None else told.withColumn("warning", F.lit(None).cast("string"))
    count = F.coalesce("findings", F.lit(0)).cast("long")
    return told.select("doc_id", count.alias("findings"), governance.decision(F.col("warning").isNotNull(), count).alias("decision"))


def mask(scanned: Scan, selection: DataFrame | None = None) -> DataFrame:
    """The masked units; without a selection every finding is masked."""
    chosen = scanned.findings if selection is None else findings.select_findings(scanned.findings, selection)
    return masking.mask(scanned.units, chosen)


def audit(scanned: Scan, site: str, artifact: str) -> DataFrame:
    """One audit row for each document with findings: counts by category, source and scope, and no values."""
    source = F.lit("pattern")
    for layer, name in (("rules", "rule"), ("fields", "field"), ("entities", "entity"), ("literals", "literal")):
        source = F.when(F.col("layer") == findings.LAYERS[layer], name).otherwise(source)
    scope = F.when(F.col("layer") == findings.LAYERS["filename"], "filename").otherwise("prompt" if artifact == "prompt" else "document")
    told = scanned.findings.select(F.col("doc_id").cast("string").alias("event_id"), "category", source.alias("source"), scope.alias("scope"), "count")
    return governance.summarize(told).withColumn("site", F.lit(site)).withColumn("artifact", F.lit(artifact))
