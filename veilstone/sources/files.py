"""Files as units: signatures, validation, text files, adapter dispatch, chunked transport, rule tables.

Files are read with ``binaryFile``; what a file may be is decided by column expressions on
its name and bytes, so a bad file is a row in a reject table and never an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import EXTENSIONS, LARGEST_BYTES, extension
from ..session import bound_batches

#: What a reader gives: one row for each unit of a file.
UNIT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("unit_ix", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("part", T.StringType()), T.StructField("address", T.StringType()), T.StructField("allowed", T.ArrayType(T.StringType())),
    T.StructField("cell", T.StructType([T.StructField("grid", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType())])),
    T.StructField("problem", T.StringType()),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("unit_ix", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("address", pa.string()), ("allowed", pa.list_(pa.string())),
    ("cell", pa.struct([("grid", pa.string()), ("row", pa.int32()), ("column", pa.int32())])), ("problem", pa.string()),
])


def is_pdf(content: Column) -> Column:
    head, tail = F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.decode(F.substring(content, -4096, 4096), "ISO-8859-1")
    return head.rlike(r"%PDF-1\.[0-9]") & tail.rlike(r"%%EOF[\s\x00]*$")


def is_png(content: Column) -> Column:
    return (F.octet_length(content) >= 20) & (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(content, 13, 4)) == "49484452") & F.contains(F.hex(F.substring(content, -16, 16)), F.lit("49454E44"))


def is_jpeg(content: Column) -> Column:
    return (F.hex(F.substring(content, 1, 3)) == "FFD8FF") & (F.hex(F.substring(content, -2, 2)) == "FFD9")


def is_text(content: Column) -> Column:
    """Strict UTF-8 without NUL, with fewer than one control character in a hundred; an empty text passes."""
    text = F.try_validate_utf8(content.cast("string"))
    controls = F.regexp_count(text, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]"))
    return F.coalesce((F.instr(text, "\x00") == 0) & ((F.length(text) == 0) | (controls < F.length(text) * 0.01)), F.lit(False))


def validate(files: DataFrame) -> DataFrame:
    """files(doc_id, name, content) with ``problem`` (null: good)."""
    kind, size = extension(F.col("name")), F.octet_length("content")
    content = F.col("content")
    agrees = (
        F.when(kind == "pdf", is_pdf(content)).when(kind == "png", is_png(content)).when(kind.isin("jpg", "jpeg"), is_jpeg(content))
        .when(kind == "txt", is_text(content)).otherwise(F.hex(F.substring(content, 1, 4)) == "504B0304")
    )
    problem = (
        F.when(~kind.isin(*EXTENSIONS), F.concat(F.lit("unsupported type; supported: "), F.lit(", ".join(EXTENSIONS))))
        .when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(size > LARGEST_BYTES, "larger than 50 MB").when(~agrees, "content does not match the extension")
    )
    return files.withColumn("problem", problem)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, name, content of the files under path; doc_id is a hash of the path, so it doesn't depend on partitioning."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


@dataclass(frozen=True)
class Adapter:
    """How files of some extensions become units, and bytes again. ``read`` yields dicts of UNIT's fields; ``write`` takes (bytes, masked text by unit_ix)."""

    extensions: tuple[str, ...]
    read: Callable[[bytes], Iterator[dict]]
    write: Callable[[bytes, dict[int, str]], bytes] | None = None


def read_text(data: bytes) -> Iterator[dict]:
    """One unit: the whole file without its byte order mark."""
    yield {"unit_ix": 0, "text": data.removeprefix(b"\xef\xbb\xbf").decode("utf-8"), "kind": "txt"}


def write_text(data: bytes, masked: dict[int, str]) -> bytes:
    mark = b"\xef\xbb\xbf" if data.startswith(b"\xef\xbb\xbf") else b""
    return mark + masked[0].encode("utf-8") if 0 in masked else data


def line_break(text: Column) -> Column:
    """The file's prevailing line break."""
    both = F.regexp_count(text, F.lit("\r\n"))
    return F.when(both > F.regexp_count(text, F.lit("\n")) - both, "crlf").otherwise("lf")


def text_adapter() -> Adapter:
    return Adapter(("txt",), read_text, write_text)


#: Units and characters at which a batch of ``extract`` is handed on, so that a task's memory doesn't grow with the number of files.
BATCH_UNITS, BATCH_CHARS = 4_096, 1_000_000


def extract(files: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Units of files(doc_id, name, content): the first adapter that takes the extension reads it.

    A file that fails, or that no adapter takes, gives one row with ``problem`` set and no text.
    """
    checked = validate(files)
    bound_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        units: list[dict] = []
        chars = 0

        def put() -> pa.RecordBatch:
            columns = [pa.array([u.get(name) for u in units], kind) for name, kind in zip(_ARROW.names[1:], _ARROW.types[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *columns], schema=_ARROW)

        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: neither the contents nor the units of a whole batch are held as objects
                doc, name, content, problem = (c[i].as_py() for c in batch.columns)
                kind = name.rsplit(".", 1)[-1].lower()
                adapter = next((a for a in adapters if kind in a.extensions), None)
                own: list[dict] = []
                if not problem and adapter is None:
                    problem = f"no adapter reads .{kind}"
                if not problem:
                    try:
                        own = list(adapter.read(content))
                    except Exception as e:  # noqa: BLE001  a broken file is a rejected row
                        problem = f"{type(e).__name__}: {e}"[:200]
                for unit in [{"problem": problem}] if problem else own:
                    docs.append(doc)
                    units.append(unit)
                    chars += len(unit.get("text") or "")
                    if len(units) >= BATCH_UNITS or chars >= BATCH_CHARS:
                        yield put()
                        docs, units, chars = [], [], 0
        if units:
            yield put()

    return checked.select("doc_id", "name", "content", "problem").mapInArrow(run, UNIT)


def apply(files: DataFrame, masked: DataFrame, adapters: list[Adapter], suffix: str = "-masked") -> DataFrame:
    """doc_id, name, content of rewritten files; masked(doc_id, unit_ix, masked) holds the units that changed.

    A file none of whose units changed isn't written.
    """
    per = masked.groupBy("doc_id").agg(F.collect_list(F.struct("unit_ix", "masked")).alias("units"))
    joined = files.select("doc_id", "name", "content").join(per, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, names, contents = [], [], []
            for doc, name, content, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stem, _, kind = name.rpartition(".")
                adapter = next(a for a in adapters if kind.lower() in a.extensions and a.write)
                docs.append(doc)
                names.append(f"{stem}{suffix}.{kind}")
                contents.append(adapter.write(content, {u["unit_ix"]: u["masked"] for u in units}))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["doc_id", "name", "content"])

    return joined.mapInArrow(run, "doc_id long, name string, content binary")


def name_units(files: DataFrame) -> DataFrame:
    """The stems of file names as units of their own (unit_ix -1)."""
    return files.select("doc_id", F.lit(-1).alias("unit_ix"), F.regexp_replace("name", r"\.[^.]*$", "").alias("text"))


CHUNK_BYTES = 512 * 1024


def to_chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, seq, n, data (base64): an empty file is one chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    cut = files.select("doc_id", "content", n.alias("n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cut.select("doc_id", "seq", "n", F.octet_length("content").cast("long").alias("total"), F.base64(F.substring("content", F.col("seq") * size + 1, F.lit(size))).alias("data"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, content, problem: chunks in any order; a missing one or a wrong total is a problem."""
    lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("c"), F.max("n").alias("n"), F.max("total").alias("total"), F.count_distinct("seq").alias("got"))
    content = F.unhex(F.array_join(F.transform("c", lambda c: F.hex(F.unbase64(c["data"]))), ""))
    joined = lists.withColumn("content", content)
    problem = F.when(F.col("got") != F.col("n"), "missing chunks").when(F.octet_length("content") != F.col("total"), "size differs")
    return joined.select("doc_id", "content", problem.alias("problem"))


def rule_table(raw: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """Rules from rows(body string) of fetched JSON ({"rules": [...]} or a bare list): trimmed, incomplete ones dropped, with status."""
    item = "array<struct<id:string,find:string,replacement:string,exact:boolean>>"
    told = raw.select(F.coalesce(F.from_json("body", f"struct<rules:{item}>")["rules"], F.from_json("body", item)).alias("rules"))
    each = told.select(F.posexplode_outer("rules").alias("rule_ord", "r"))
    good = each.select("rule_ord", F.col("r.id").alias("rule_id"), F.trim("r.find").alias("find"), F.trim("r.replacement").alias("replacement"), F.coalesce("r.exact", F.lit(False)).alias("exact"))
    return good.filter("find <> '' and replacement <> ''")


def rule_status(configured: Column, fetched: Column, cached: Column) -> Column:
    """ready, stale (an older table is used) or unavailable; null where no source is set."""
    return F.when(~configured, None).when(fetched, "ready").when(cached, "stale").otherwise("unavailable")
