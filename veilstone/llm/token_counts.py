"""Token counts of a byte-level BPE vocabulary, without token ids.

A text is cut into pre-tokens; a document's token count is the sum over its distinct
pre-tokens of frequency times pieces. Pieces are counted once for each distinct
pre-token that a task meets: they stand in a table that is joined to the documents'
frequencies and is kept across the task's batches, up to ``TABLE_ROWS`` rows (it is
emptied then, and counts stay exact). Nothing is shuffled: frequencies of all
documents are about as large as the corpus, so a shuffle of them would cost more than
counting a pre-token once in each task.

Special strings that the vocabulary file adds count as one token each, as the library
does by default. Texts in which a regular expression engine could disagree with the
library's about a character class go through the library's own pre-tokenizer.

Defined results: a null text counts as empty: 0 bytes, 0 tokens; a null doc_id stays
null; repeated rows are counted one by one; an empty table gives no rows; only doc_id
and text are read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

LIMIT = 512
TABLE_ROWS = 500_000
#: The published pre-token pattern of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters about whose classes all engines agree: ASCII without the rare separators, Latin letters and common marks.
PLAIN = r"[\t\n\r\x20-\x7E\u00A1-\u00A9\u00AB-\u00B1\u00B4\u00B6-\u00B8\u00BB\u00BF-\u024F\u2010-\u2027\u2030-\u205E\u20AC]*"


class PieceTable:
    """Pieces by pre-token, for one vocabulary file's text."""

    def __init__(self, vocabulary: str, rows: int = TABLE_ROWS):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        told = json.loads(vocabulary)
        form = told.get("pre_tokenizer") or {}
        if form.get("type") != "ByteLevel" or form.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError("the vocabulary's pre-tokenizer isn't plain byte-level BPE")
        added = [a["content"] for a in told["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.starts = tuple(added)
        self.cut = regex.compile(PRE_TOKEN).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.pieces: dict[str, int] = {}
        self.rows = rows

    def frequencies(self, text: str) -> Counter:
        if self.plain(text):
            return Counter(self.cut(text))
        return Counter(text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def document(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the text's pre-tokens, and how many added tokens it holds."""
        if not any(s in text for s in self.starts):
            return self.frequencies(text), 0
        total, found = Counter(), 0
        rest = self.added.split(text)
        for part in rest:
            total.update(self.frequencies(part))
        return total, len(rest) - 1

    def count(self, texts: list[str]) -> list[int]:
        documents = [self.document(t) for t in texts]
        new = set().union(*(f.keys() for f, _ in documents)) - self.pieces.keys() if documents else set()
        if len(self.pieces) + len(new) > self.rows:
            self.pieces.clear()
            new = set().union(*(f.keys() for f, _ in documents))
        if new:
            new = list(new)
            self.pieces.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        get = self.pieces.__getitem__
        return [sum(map(mul, map(get, f.keys()), f.values())) + extra for f, extra in documents]


def vocabulary_text(path: str, most: int = 64 << 20) -> str:
    """The vocabulary file, read on the driver; its size is bounded, since every task gets it."""
    with open(path, encoding="utf-8") as f:
        text = f.read(most + 1)
    if len(text) > most:
        raise ValueError(f"{path} holds more than {most} characters")
    return text


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    spark = docs.sparkSession
    work.small_batches(spark)
    shipped = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        table = PieceTable(shipped.value)
        for batch in batches:
            counts = table.count([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    told = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    ).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return told.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")))
