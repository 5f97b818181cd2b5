"""Decisions, audit and diagnostics: what happens to a scanned batch and what is recorded of it.

Records hold no values: schemas are allow-lists, and whatever is not on them is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.validators import CATEGORIES

SITES = {"chatgpt.com": "chatgpt", "chat.openai.com": "chatgpt", "claude.ai": "claude", "gemini.google.com": "gemini", "copilot.microsoft.com": "copilot"}
ARTIFACTS = ("file", "prompt")
SOURCES = ("pattern", "entity", "field", "rule", "literal")
SCOPES = ("document", "filename", "prompt")
FORMATS = ("txt", "docx", "xlsx", "pdf", "png", "jpg", "jpeg")
OUTCOMES = ("masked", "clean", "blocked", "failed")
DEVICES = ("gpu", "cpu", "none")
DELIVERIES = ("input", "drop", "paste", "none")
MOST_COUNT, MOST_FORMATS, MOST_EVENTS, MOST_DAYS = 1_000_000, 16, 500, 30
MOST_MS = 3_600_000
SYNC_CHARS = 50_000


def decide_files(scanned: DataFrame) -> DataFrame:
    """scanned(batch_id, findings, warning, passthrough), one row a file: any warning or passthrough blocks the batch; else mask or clean."""
    bad = F.bool_or(F.col("warning").isNotNull() | F.coalesce("passthrough", F.lit(False)))
    grouped = scanned.groupBy("batch_id").agg(bad.alias("bad"), F.sum(F.coalesce("findings", F.lit(0))).cast("long").alias("findings"))
    return grouped.select("batch_id", "findings", decision(F.col("bad"), F.col("findings")).alias("decision"))


def decision(bad: Column, findings: Column) -> Column:
    return F.when(bad, "block").when(findings > 0, "mask").otherwise("clean")


def route_prompt(text: Column, enabled: Column, approved: Column, model_required: Column) -> Column:
    """How a prompt is scanned: not at all, with the model, later without it because of its length, or at once."""
    return (
        F.when(~enabled | (F.trim(F.coalesce(text, F.lit(""))) == "") | approved, "skip")
        .when(model_required, "deferred_model").when(F.length(text) > SYNC_CHARS, "deferred").otherwise("sync")
    )


def rules_stale(server: Column, status: Column) -> Column:
    """A warning where a rule server is set and its rules are not fresh; it blocks."""
    return F.when((F.coalesce(server, F.lit("")) != "") & ~status.eqNullSafe(F.lit("ready")), "rules are not up to date")


def protection_code(codes: Column, known: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.filter(codes, lambda c: c.isin(*known)), F.lit(0)), F.lit("generic"))


def _counted(table: DataFrame, key: str, allowed: tuple[str, ...], fallback: str | None) -> DataFrame:
    value = F.when(F.col(key).isin(*allowed), F.col(key))
    value = F.coalesce(value, F.lit(fallback)) if fallback else value
    per = table.withColumn("k", value).filter("k is not null").groupBy("event_id", "k").agg(F.sum("n").alias("n"))
    return per.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"by_{key}"))


def summarize(selected: DataFrame) -> DataFrame:
    """selected(event_id, category, source, scope, count): findings, masked occurrences, and maps by category, source and scope.

    A bad count is one; unknown categories and sources are left out of their map, an unknown scope is the document.
    """
    told = selected.withColumn("n", F.when(F.col("count") > 0, F.col("count")).otherwise(1).cast("long"))
    total = told.groupBy("event_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("n").alias("occurrences"))
    for key, allowed, fallback in (("category", tuple(CATEGORIES), None), ("source", SOURCES, None), ("scope", SCOPES, "document")):
        total = total.join(_counted(told, key, allowed, fallback), "event_id", "left")
    return total


def normalize_audit(events: DataFrame) -> DataFrame:
    """Strict form of audit events(event_id, created_at, site, artifact, formats, findings, occurrences, by_category) with ``problem``."""
    bad_map = F.exists(F.map_entries(F.coalesce("by_category", F.create_map().cast("map<string,bigint>"))), lambda e: ~e["key"].isin(*CATEGORIES) | (e["value"] < 0) | (e["value"] > MOST_COUNT))
    out_of_range = lambda c: F.col(c).isNull() | ~F.col(c).between(0, MOST_COUNT)
    formats = F.array_sort(F.array_distinct(F.filter(F.coalesce("formats", F.array().cast("array<string>")), lambda f: f.isin(*FORMATS))))
    problem = (
        F.when(~F.coalesce(F.col("site").isin(*set(SITES.values())), F.lit(False)), "site")
        .when(~F.coalesce(F.col("artifact").isin(*ARTIFACTS), F.lit(False)), "artifact")
        .when(out_of_range("findings") | out_of_range("occurrences"), "count")
        .when(bad_map, "category").when(F.size("formats") > MOST_FORMATS, "formats").when(F.col("findings") == 0, "empty")
    )
    return events.select("event_id", "created_at", "site", "artifact", formats.alias("formats"), "findings", "occurrences", "by_category", problem.alias("problem"))


def ring(events: DataFrame, now: Column, key: str, time: str, most: int = MOST_EVENTS, days: int = MOST_DAYS, by: str | None = None) -> DataFrame:
    """The last ``most`` events of ``days`` days (per ``by``). Without ``by`` it is a distributed top-k, never one sorted table."""
    fresh = events.filter(F.col(time) > now - F.make_dt_interval(F.lit(days)))
    if by is None:
        return fresh.orderBy(F.desc(time), F.desc(key)).limit(most)
    return fresh.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.desc(time), F.desc(key)))).filter(F.col("place") <= most).drop("place")


def clean_diagnostics(events: DataFrame) -> DataFrame:
    """Diagnostic rows on the allow-lists: an out-of-range number is 0, an unknown word 'unknown', success has no error code."""
    listed = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise("unknown").alias(c)
    number = lambda c, most: F.coalesce(F.when(F.expr(f"try_cast({c} as bigint)").between(0, most), F.expr(f"try_cast({c} as bigint)")), F.lit(0)).alias(c)
    code = F.when(F.col("outcome").isin("masked", "clean"), None).when(F.col("error_code").rlike("^[a-z][a-z0-9_-]{0,39}$"), F.col("error_code")).otherwise("unknown")
    return events.select(
        "operation_id", listed("site", tuple(set(SITES.values()))), listed("artifact", ARTIFACTS), listed("outcome", OUTCOMES), listed("device", DEVICES), listed("delivery", DELIVERIES),
        number("file_count", 1000), number("finding_count", MOST_COUNT), number("scan_ms", MOST_MS), number("mask_ms", MOST_MS), number("total_ms", MOST_MS), code.alias("error_code"),
    )


def report(clean: DataFrame, key: str = "operation_id", most: int = 30) -> DataFrame:
    """One row: the last operations as an array, with the constant privacy flags."""
    last = clean.orderBy(F.desc(key)).limit(most)
    return last.agg(F.array_sort(F.collect_list(F.struct(*clean.columns))).alias("operations")).select(
        F.lit(1).alias("schema"), "operations", F.lit(False).alias("contains_text"), F.lit(False).alias("contains_file_names")
    )


def silence_sessions(events: DataFrame, by: str, time: str, seconds: int = 45) -> DataFrame:
    """Runs of activity without a silence longer than ``seconds``: by, session_start, session_end, n."""
    return events.groupBy(by, F.session_window(time, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("session_end")).select(by, F.col("w.start").alias("session_start"), "session_end", "n")


def upload_decision(uploads: DataFrame, approvals: DataFrame, policy: Column, minutes: int = 10) -> DataFrame:
    """uploads(upload_id, at, name, size, mime, head) with ``verdict`` allow, block or ignore.

    A named file needs its approved name and size; an unnamed body needs an approval of the
    last minutes that is at least as large (an interval semi-join), else documents and large bodies are blocked.
    """
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    named = uploads.filter("name is not null").join(approvals.select("name", "size").distinct().withColumn("ok", F.lit(True)), ["name", "size"], "left")
    verdict = F.when(F.col("ok"), "allow").when(extension.isin(*FORMATS), "block").when(policy, "block").otherwise("allow")
    first = named.select("upload_id", verdict.alias("verdict"))
    # an equi-join on ten-minute bins of time, then the exact interval: no all-pairs comparison
    width = minutes * 60
    body = uploads.filter("name is null").withColumn("bin", F.explode(F.array(*[(F.unix_timestamp("at") / width).cast("long") - k for k in (0, 1)])))
    granted = approvals.select(F.col("size").alias("granted"), F.col("approved_at"), (F.unix_timestamp("approved_at") / width).cast("long").alias("bin"))
    fitting = body.join(granted, "bin").filter((F.col("granted") >= F.col("size")) & (F.col("approved_at") <= F.col("at")) & (F.col("approved_at") > F.col("at") - F.make_dt_interval(mins=F.lit(minutes))))
    fitting = fitting.select("upload_id").distinct().withColumn("ok", F.lit(True))
    head = F.hex(F.substring("head", 1, 4))
    document = F.coalesce(F.col("mime").rlike(r"pdf|msword|officedocument|rtf|excel"), F.lit(False)) | F.coalesce(head.isin("25504446", "504B0304", "D0CF11E0", "7B5C7274"), F.lit(False))
    second = uploads.filter("name is null").join(fitting, "upload_id", "left").select(
        "upload_id", F.when((F.col("size") < 4096) | ~policy, "ignore").when(F.col("ok"), "allow").when(document | (F.col("size") >= 262_144), "block").otherwise("allow").alias("verdict")
    )
    return first.union(second)


def merge_summaries(summaries: DataFrame, by: str) -> DataFrame:
    """One event of several summaries: counts add up, maps add up key by key, formats that are known are listed once; without findings there is no event."""
    maps = [c for c in summaries.columns if c.startswith("by_")]
    total = summaries.groupBy(by).agg(
        F.sum("findings").alias("findings"), F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce("formats", F.array().cast("array<string>")))), lambda f: f.isin(*FORMATS)))).alias("formats"),
    )
    for name in maps:
        each = summaries.select(by, F.explode(name).alias("k", "n")).groupBy(by, "k").agg(F.sum("n").alias("n"))
        total = total.join(each.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)), by, "left")
    return total.filter("findings > 0")
