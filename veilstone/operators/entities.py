"""Named entities: inference once per distinct text, then grouping, cleaning and overlap.

The model is a provider: any callable from a list of texts to lists of (word, tag, score,
start, end) tokens. None is shipped. A provider that fails gives a warning, never a clean
result. Everything after the model works on a table of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.validators import normalized
from . import spans
from .findings import LAYERS

THRESHOLD = 0.84
KINDS = {"PER": "person", "ORG": "organization", "LOC": "location"}
# Model input per profile (longest chunk, overlap, image resolution).
PROFILES = {"fast": (900, 96, 150), "balanced": (800, 80, 200), "thorough": (700, 180, 300)}
DEFAULT_PROFILE = "balanced"
# Words of software and data that a model takes for names.
TECHNICAL = (
    "sql", "select", "insert", "update", "delete", "from", "where", "join", "table", "index", "view", "null", "varchar", "int", "bigint", "primary", "key",
    "json", "xml", "html", "http", "https", "api", "rest", "url", "uri", "server", "client", "database", "schema", "query", "class", "function", "string",
    "boolean", "true", "false", "java", "python", "javascript", "docker", "linux", "windows", "oracle", "postgres", "mysql", "spark", "kafka", "redis",
)


def chunk_bounds(text: str, longest: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of at most ``longest`` characters, cut after the last stop or space beyond 58 % of that, each starting ``overlap`` before the last one's end."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + longest)
        if stop < len(text):
            cut = max(text.rfind(c, at, stop) for c in ".!?; ")
            if cut >= at + int(longest * 0.58):
                stop = cut + 1
        out.append((at, stop))
        if stop >= len(text):
            break
        following = max(stop - overlap, at + 1)
        while following < stop and text[following].isspace():
            following += 1
        at = following
    return out


def chunks(texts: DataFrame, profile: str = DEFAULT_PROFILE) -> DataFrame:
    """Adds chunk_ix, start, chunk to texts(text)."""
    longest, overlap, _ = PROFILES.get(profile, PROFILES[DEFAULT_PROFILE])

    @F.arrow_udf("array<struct<start:int,chunk:string>>")
    def cut(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("chunk", pa.string())]))
        return pa.array([[{"start": a, "chunk": t[a:b]} for a, b in chunk_bounds(t or "", longest, overlap)] for t in x.to_pylist()], kind)

    cuts = texts.withColumn("cuts", cut("text"))
    return cuts.select(*texts.columns, F.posexplode("cuts").alias("chunk_ix", "c")).select(*texts.columns, "chunk_ix", "c.start", "c.chunk")


def name_bearing(text: Column) -> Column:
    return text.rlike(r"\p{L}{2,}")


def infer_distinct(units: DataFrame, provider: Callable[[list[str]], list[list[tuple]]], profile: str = DEFAULT_PROFILE) -> DataFrame:
    """Tokens of every unit: the model sees each distinct name-bearing text once, in batches of 32 short or 8 long chunks.

    Columns: doc_id, unit_ix, chunk_ix, tok_ix, word, tag, score, start, end, status ('ok' or the error, fail closed).
    """
    told = units.filter("text is not null").withColumn("same", F.sha2("text", 256))
    distinct = told.filter(name_bearing(F.col("text"))).dropDuplicates(["same"]).select("same", "text")
    pieces = chunks(distinct, profile).select("same", "chunk_ix", F.col("start").alias("at"), "chunk")
    schema = "same string, chunk_ix int, tok_ix int, word string, tag string, score double, start int, end int, status string"

    def answered(part: list[tuple]) -> list[tuple]:
        """Rows of a batch; where it fails its texts are asked about one by one, and the error stays with those that fail again."""
        try:
            answers = provider([h[3] for h in part])
        except Exception as e:  # noqa: BLE001  a failed model is a warning on its text, which blocks it later
            if len(part) > 1:
                return [row for h in part for row in answered([h])]
            return [(part[0][0], part[0][1], 0, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
        return [
            (same, chunk, i, w, tag, float(score), at + a, at + b, "ok")
            for (same, chunk, at, _), tokens in zip(part, answers, strict=True) for i, (w, tag, score, a, b) in enumerate(tokens)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            rows, held = [], list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            size = 32 if all(len(h[3]) <= 160 for h in held) else 8
            for k in range(0, len(held), size):
                rows += answered(held[k : k + size])
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    tokens = pieces.mapInArrow(run, schema)
    return told.select("doc_id", "unit_ix", "same").join(tokens, "same").drop("same")


def group_tokens(tokens: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Entities from tokens(doc_id, chunk_ix, tok_ix, word, tag, score, start, end): islands of equal type.

    A new entity starts at another type, at a beginning tag that isn't a word piece, after an
    outside tag and after a line break. Its score is the best of its tokens.
    """
    order = W.partitionBy("doc_id", "unit_ix", "chunk_ix").orderBy("tok_ix") if "unit_ix" in tokens.columns else W.partitionBy("doc_id", "chunk_ix").orderBy("tok_ix")
    keys = [c for c in ("doc_id", "unit_ix", "chunk_ix") if c in tokens.columns]
    typed = tokens.withColumn("kind", F.when(F.col("tag") == "O", None).otherwise(F.regexp_extract("tag", r"^[BI]-([A-Z]+)$", 1)))
    typed = typed.filter("tag is not null")
    breaks = (
        ~F.coalesce(F.col("kind") == F.lag("kind").over(order), F.lit(False))
        | (F.col("tag").startswith("B-") & ~F.col("word").startswith("##"))
        | F.coalesce(F.contains(F.lag("word").over(order), F.lit("\n")), F.lit(False))
    )
    runs = typed.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(order)).filter("kind is not null and kind <> ''")
    grouped = runs.groupBy(*keys, "run", "kind").agg(
        F.max("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("tok_ix", "word"))).alias("words")
    )
    joined = F.aggregate("words", F.lit(""), lambda s, w: F.when(s == "", F.regexp_replace(w["word"], "^##", "")).when(w["word"].startswith("##"), F.concat(s, F.substring(w["word"], F.lit(3), F.length(w["word"])))).otherwise(F.concat(s, F.lit(" "), w["word"])))
    kind = F.lit(None).cast("string")
    for tag, name in KINDS.items():
        kind = F.when(F.col("kind") == tag, name).otherwise(kind)
    return grouped.filter(F.col("score") >= threshold).select(*keys, kind.alias("category"), "score", "start", "end", F.trim(joined).alias("value")).filter("category is not null and " + "length(regexp_replace(value, '[^\\\\p{L}\\\\p{N}]', '')) >= 2")


def resolve_overlaps(entities: DataFrame, keys: tuple[str, ...] = ("doc_id", "unit_ix")) -> DataFrame:
    """Of entities that overlap in a text the longer stays, then the surer, then the earlier; equal spans keep the best score."""
    best = entities.groupBy(*keys, "category", "start", "end").agg(F.max_by("value", "score").alias("value"), F.max("score").alias("score"))
    entry = F.struct((F.col("start") - F.col("end")).alias("o1"), (-F.col("score")).alias("o2"), F.col("start").alias("start"), F.col("end").alias("end"), "category", "score", "value")
    lists = best.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kept = F.expr("aggregate(all, slice(all, 1, 0), (a, x) -> CASE WHEN exists(a, y -> y.start < x.end AND x.start < y.end) THEN a ELSE concat(a, array(x)) END)")
    return lists.select(*keys, F.explode(kept).alias("e")).select(*keys, "e.category", "e.start", "e.end", "e.score", "e.value")


def is_technical(value: Column, line: Column | None = None, offset: Column | None = None) -> Column:
    """Whether an entity is a term, an identifier, or a single word of a line of code outside its strings and comments."""
    words = F.split(F.lower(F.trim(value)), r"[\s._-]+")
    term = F.forall(words, lambda w: w.isin(*TECHNICAL))
    identifier = ~value.rlike(r"\s") & value.rlike(r"\p{L}[0-9]|[0-9]\p{L}|[=<>{}()\[\];$#@\\/*+|&^%]")
    noise = term | identifier
    if line is None:
        return noise
    bare = F.regexp_replace(line, r"\S+@\S+|https?://\S+", " ")
    code = bare.rlike(r"(?i)\b(?:select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from|create\s+(?:table|view|index)|alter\s+table)\b") | bare.rlike(
        r"\[[A-Za-z_]\w*\]\.\[|\b[A-Za-z_]\w*\.[A-Za-z_]\w*\.[A-Za-z_]\w*\b|(?i)\b\w+\s+(?:n?varchar|bigint|int|datetime|decimal)\b|^\s*(?:--|//|/\*|#)|[{};]\s*$|(?i)\b(?:not\s+null|primary\s+key|foreign\s+key)\b"
    )
    ahead = F.substring(line, F.lit(1), offset) if offset is not None else F.lit("")
    quotes = F.regexp_count(ahead, F.lit("'")) % 2 + F.regexp_count(ahead, F.lit('"')) % 2
    data = (quotes > 0) | ahead.rlike(r"--|//") | (F.regexp_count(ahead, F.lit(r"/\*")) > F.regexp_count(ahead, F.lit(r"\*/")))
    return noise | (code & ~data & ~value.rlike(r"\S\s+\S"))


def address_like(category: Column, value: Column, line: Column, following: Column) -> Column:
    """A single-line non-location entity on, or among other words just before, a line with a postal shape."""
    postal = r"\b[0-9]{5}\b"
    return (category != "location") & ~F.contains(value, F.lit("\n")) & (
        line.rlike(postal) | line.rlike(r"\b[0-9]+\s*/\s*[0-9]+\b") | (F.coalesce(following.rlike(postal), F.lit(False)) & (F.size(F.split(F.trim(F.replace(line, value, F.lit(" "))), r"\s+")) >= 2))
    )


def settle(found: DataFrame, units: DataFrame) -> DataFrame:
    """found(doc_id, unit_ix, category, start, end, score) with clean spans, without technical terms, code and parts of addresses.

    A span loses brackets and punctuation at its ends and grows to the edges of its words,
    as ``spans.clean_span`` and ``spans.expand_span`` have it. The text joins once; only
    short columns leave this step.
    """
    word, text = r"[\p{L}\p{N}\p{M}]*", F.col("text")
    trim = "[" + "".join(f"\\{c}" if c.isascii() else c for c in spans.TRIM) + "]+"
    told = found.select("doc_id", "unit_ix", "category", "start", "end", "score").join(units.select("doc_id", "unit_ix", "text"), ["doc_id", "unit_ix"])
    raw = F.substring(text, F.col("start") + 1, F.col("end") - F.col("start"))
    clean = told.withColumn("a", F.col("start") + F.length(raw) - F.length(F.regexp_replace(raw, f"^{trim}", ""))).withColumn("b", F.col("end") - F.length(raw) + F.length(F.regexp_replace(raw, f"{trim}$", "")))
    reach = spans.MOST_REACH
    first = F.greatest(F.col("a") - reach - 1, F.lit(0))
    left = F.length(F.regexp_extract(F.substring(text, first + 1, F.col("a") - first), f"{word}$", 0))
    right = F.length(F.regexp_extract(F.substring(text, F.col("b") + 1, F.lit(reach + 1)), f"^{word}", 0))
    grown = clean.filter("b > a").withColumns({"a": F.col("a") - F.when(left <= reach, left).otherwise(0), "b": F.col("b") + F.when(right <= reach, right).otherwise(0)})
    value = F.substring(text, F.col("a") + 1, F.col("b") - F.col("a"))
    head = F.substring_index(F.substring(text, F.lit(1), F.col("a")), "\n", -1)
    rest = F.substring(text, F.col("a") + 1, F.length(text))
    following = F.when(F.contains(rest, F.lit("\n")), F.substring_index(F.substring_index(rest, "\n", 2), "\n", -1))
    line = F.concat(head, F.substring_index(rest, "\n", 1))
    noise = is_technical(value, line, F.length(head)) | address_like(F.col("category"), value, line, following)
    kept = grown.filter((F.length(value) >= 2) & ~F.coalesce(noise, F.lit(False)))
    return kept.select("doc_id", "unit_ix", "category", F.col("a").alias("start"), F.col("b").alias("end"), "score", value.alias("value"))


def entity_findings(entities: DataFrame) -> DataFrame:
    """Findings by (category, normalized): hits, best score, variants."""
    named = entities.withColumn("normalized", normalized(F.col("category"), F.col("value")))
    place = F.struct("unit_ix", "start") if "unit_ix" in entities.columns else F.struct("start")
    grouped = named.groupBy("doc_id", "category", "normalized").agg(
        F.min_by("value", place).alias("value"), F.array_sort(F.collect_set("value")).alias("variants"), F.count(F.lit(1)).alias("count"), F.max("score").alias("score"), F.min(place).alias("first")
    )
    return grouped.select(
        "doc_id", F.lit(LAYERS["entities"]).alias("layer"), F.row_number().over(W.partitionBy("doc_id").orderBy("first", "category", "normalized")).alias("ord"),
        "category", "normalized", "value", "variants", "count", F.lit("probable").alias("confidence"), "score", F.lit(None).cast("string").alias("replacement"),
    )
