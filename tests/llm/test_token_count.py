import public_tokenizers
from helpers import ALL, empty_documents, hard_documents, ids
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from siteweave.llm.token_count import Counter, by_bytes, count_tokens, op6_token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHOLE = SentencePieceProcessor(model_file=MODEL)
OWN = Counter(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  c\n\t.▁é１ﬁ<s>日本 　")), max_size=40))
def test_pieces_count_as_the_whole(text):
    assert OWN.counts([text]) == [len(WHOLE.encode(text))]


def test_query_counts_as_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in op6_token_count(spark, "/root/testdata/sf0.01").collect():
        n = len(WHOLE.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_batches_are_even():
    assert list(by_bytes(["a" * 5, "b" * 5, "c" * 20, "d"], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(by_bytes([], 10)) == []


def test_hard_rows(spark):
    got = count_tokens(hard_documents(spark), MODEL)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by[4].n_tokens == by[5].n_tokens == 0 and by[7].over_limit and by[4].n_bytes == 0
    assert by[6].n_tokens == len(WHOLE.encode(" \n\t "))
    assert count_tokens(empty_documents(spark), MODEL).count() == 0
