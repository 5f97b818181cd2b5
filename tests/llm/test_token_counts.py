import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilstone.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLE = token_counts.PieceTable(token_counts.vocabulary_text(PATH), rows=200)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_table(docs_of):
    rows = [(1, "Hello world's  end\n\n x"), (2, None), (3, ""), (4, "a<|endoftext|>b"), (None, "é日本 😀"), (5, "word " * 600), (5, "word " * 600)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs_of(rows), token_counts.vocabulary_text(PATH)).collect())
    want = sorted(((d or 0), len((t or "").encode()), library(t or ""), library(t or "") > 512) for d, t in rows)
    assert got == want
    assert token_counts.count_tokens(docs_of([]), token_counts.vocabulary_text(PATH)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdm<|>  \x85​é9")), max_size=60))
def test_any_text(text):
    assert TABLE.count([text]) == [library(text)]


def test_whole_corpus(spark, sf_dir):
    from veilstone.llm.queries import QUERIES

    got = {r.doc_id: r.n_tokens for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        assert got[r.doc_id] == library(r.text)
