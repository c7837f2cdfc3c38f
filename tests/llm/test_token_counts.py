import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orebody.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "it's we'll I'D 'd", "x\n\n  y \t z  ", "3.14159 12345678", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>",
        "naïve Ünïcode Œuvre ßx", "日本語 text", "a b c", "²³¼ x", "\x1c\x1d a", "é", "🙂🙂", "!!! ??? ---", "\r\n a\r b"]


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_counter_equals_the_library():
    count = Counter(PATH)
    assert count.by_word
    assert count(HARD) == plain(HARD)
    assert count(HARD) == plain(HARD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(" '\n\tsdlv<|>"))), max_size=4))
def test_counter_equals_the_library_on_random_texts(texts):
    assert Counter(PATH)(texts) == plain(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_through_their_library(name):
    count = Counter(public_tokenizers.path(name))
    assert not count.by_word
    assert count(["", "hello world"])[1] > 0


def test_counts_nulls_repeats_and_limit(spark):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "word " * 3000), (5, "é" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := plain([t or ""])[0], n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)


def test_cache_is_used_and_appended_to(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "doc_id long, text string")
    count_tokens(docs, PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = spark.createDataFrame([(1, "one two"), (4, "four five six")], "doc_id long, text string")
    got = {r.id: r.n_tokens for r in count_tokens(more, PATH, cache).collect()}
    assert spark.read.parquet(cache).count() == 3
    assert got == {1: plain(["one two"])[0], 4: plain(["four five six"])[0]}
    other = count_tokens(more, public_tokenizers.path("piece_bpe_32k.model"), cache)
    assert other.count() == 2
    assert spark.read.parquet(cache).count() == 5


def test_stored_counts_are_believed(spark, tmp_path):
    from orebody.llm.token_counts import CACHE_SCHEMA, file_digest
    import hashlib

    cache = str(tmp_path / "cache")
    spark.createDataFrame([(hashlib.sha256(b"one").digest(), file_digest(PATH), 77)], CACHE_SCHEMA).write.parquet(cache)
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert count_tokens(docs, PATH, cache).first().n_tokens == 77


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_tokens int, content int")
    assert count_tokens(docs, PATH).count() == 0


def test_the_query_keeps_a_cache_of_a_fixed_name(spark):
    from orebody.llm.queries import op2_token_counts
    from orebody.llm.storage import shared_dir

    cache = f"{shared_dir(spark)}/orebody-cache/token_counts"
    first = sorted(map(tuple, op2_token_counts(spark, "/root/testdata/sf0.001").collect()), key=str)
    held = spark.read.parquet(cache).count()
    assert sorted(map(tuple, op2_token_counts(spark, "/root/testdata/sf0.001").collect()), key=str) == first
    assert spark.read.parquet(cache).count() == held > 0


def test_the_memo_is_bounded_by_characters(monkeypatch):
    from orebody.llm import token_counts

    monkeypatch.setattr(token_counts, "MEMO_CHARS", 100)
    count = Counter(PATH)
    texts = ["x" * 50_000 + " ab", "y" * 500 + " " + "x" * 50_000] + [f"word{i} other{i}" for i in range(200)]
    for t in texts * 2:
        assert count([t]) == plain([t])
    assert sum(map(len, count._memo)) < 300
