import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import tokens as T

ENC = T.TrieEncoder()
REF = tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab  \n\t\r\xa0　'stlle1²漢😂​\x1c\x85é—.,!=", max_size=80)), max_size=5))
def test_against_a_reference_encoder(texts):
    assert ENC.encode_batch(texts) == [REF.encode_ordinary(t) for t in texts]


def test_long_words_and_round_trip():
    for t in ("a" * 20_000, "=" * 5000, " " * 3000, "😂" * 2000, "<|endoftext|> x", "don't  DON'T", "Straße 東京 мир"):
        ids = ENC.encode_batch([t])[0]
        assert ids == REF.encode_ordinary(t) and b"".join(ENC.tokens[i] for i in ids).decode() == t


def test_prefixes_are_shared_and_memory_is_bounded():
    e = T.TrieEncoder(keep=2)
    one = e.encode_batch(["token tokens tokenized tokenizer"])
    assert one == e.encode_batch(["token tokens tokenized tokenizer"]) == [REF.encode_ordinary("token tokens tokenized tokenizer")]


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "two words"), (4, "two words"), (None, "x")]
    df = spark.createDataFrame([(i, t, [9], "k") for i, t in rows], "doc_id bigint, text string, ids array<int>, k string")
    got = sorted(((r.doc_id, r.ids) for r in T.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, REF.encode_ordinary("  ")), (4, REF.encode_ordinary("two words")), (4, REF.encode_ordinary("two words")), (None, REF.encode_ordinary("x"))], key=str)
    assert dict(T.encode_corpus(df, empty=(7,)).filter("doc_id < 3").collect()) == {1: [7], 2: [7]}
    assert {r.doc_id: r.n_tokens for r in T.token_counts(df).filter("doc_id < 4").collect()} == {1: 0, 2: 0, 3: len(REF.encode_ordinary("  "))}
    assert T.encode_corpus(df.limit(0)).count() == 0
