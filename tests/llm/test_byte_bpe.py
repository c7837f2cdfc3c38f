import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from orebody.llm import byte_bpe
from orebody.llm.byte_bpe import Ranks, decode, encode, lexicon, pieces, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TABLE = Ranks(PATH)
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n a", " \n a\n", "it's we'll I'D 'd 's", "x\n\n  y \t z  ", "3.14159 12345678", "<|endoftext|> x",
        "naïve Ünïcode Œuvre ßx", "日本語 text 中文字符", "²³¼ x Ⅷ一", "\x1c\x1d a \x1e", "é 🙂🙂", "!!! ??? --- a_b __ _1", "\r\n a\r b", "\x85\xa0  x",
        "\U00010ee7a \U0002cea7a \U000323e7\U000323e7a", "a" * 500, "ab" * 300 + " " + "z" * 90, "x" * 70 + "!" * 80 + " " + "1" * 100, "\0 \0a"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_many_words_at_once_equal_the_library(library):
    rng = random.Random(9)
    some = {"".join(rng.choice(["ka", "tion", "er", "é", "日", "9", "--", "aa", "x"]) for _ in range(rng.randint(1, 12))) for _ in range(20_000)}
    assert {w: ids(x) for w, x in TABLE.encode_words(some).items()} == {w: library.encode_ordinary(" " + w) for w in some}


def test_hard_texts_equal_the_library_and_come_back(library):
    got = TABLE.encode(HARD, {})
    assert [ids(x) for x in got] == [library.encode_ordinary(t) for t in HARD]
    assert [byte_bpe.decoded(x, byte_bpe._bytes_of(PATH)).decode() for x in got] == HARD
    assert ["".join(pieces(t)) for t in HARD] == HARD
    assert [" ".join(words(t)) for t in HARD] == HARD


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinorst '\n\t 1!é"))), max_size=4))
def test_random_texts_equal_the_library(texts):
    with open(PATH, "rb") as f:
        lib = test_random_texts_equal_the_library.__dict__.setdefault("lib", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={}))
    assert [ids(x) for x in TABLE.encode(texts, {})] == [lib.encode_ordinary(t) for t in texts]


def one_by_one(ranks, piece):
    """The least rank, leftmost, again and again."""
    if piece in ranks:
        return [ranks[piece]]
    now = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        able = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(now, now[1:])) if a + b in ranks]
        if not able:
            return [ranks[x] for x in now]
        i = min(able)[1]
        now[i : i + 2] = [now[i] + now[i + 1]]


@pytest.mark.parametrize("bulk", [1, 4, byte_bpe.BULK])
def test_merges_that_make_lower_ranks_possible(tmp_path, monkeypatch, bulk):
    """Ranks in any order, as no trained file has them: a merge may open one that ranks before it."""
    monkeypatch.setattr(byte_bpe, "BULK", bulk)
    rng = random.Random(3)
    for trial in range(40):
        parts = {bytes([i]) for i in range(256)}
        pool = [b"a", b"b", b"c"]
        for _ in range(25):
            new = rng.choice(pool) + rng.choice(pool)
            if len(new) < 8:
                pool.append(new)
        extra = sorted(set(pool) - parts)
        rng.shuffle(extra)
        order = sorted(parts) + extra
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % i for i, b in enumerate(order)))
        table = Ranks(str(path))
        some = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(60)})
        some = [s for s in some if s not in table.ranks]
        assert [ids(x) for x in table.replay(some)] == [one_by_one(table.ranks, s) for s in some]


def test_table_nulls_repeats_long_words_and_other_columns(spark, library):
    texts = [*HARD, None, "word " * 4000, "x" * 30_000, "same text", "same text"]
    rows = [(None if i == 3 else i, t, "x", 7, "w") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id int, word string").repartition(3)
    want = sorted((str(r[0]), library.encode_ordinary(r[1] or "")) for r in rows)
    for head in (0, 5, byte_bpe.HEAD):
        coded = encode(docs, PATH, head=head)
        assert sorted((str(r.id), ids(r.ids)) for r in coded.collect()) == want
    back = decode(coded, PATH)
    assert sorted(bytes(r.bytes).decode() for r in back.collect()) == sorted(t or "" for t in texts)


def test_bytes_that_are_no_text(spark, library):
    docs = spark.sql("select 1L as doc_id, cast(X'6120ff20626320' as string) as text")
    assert ids(encode(docs, PATH).first().ids) == library.encode_ordinary("a � bc ")


def test_lexicon_has_each_word_once(spark, library):
    docs = spark.createDataFrame([(i, f"start common word{i} tail. {'y' * 100}") for i in range(50)], "doc_id long, text string").repartition(4)
    found = {r.word: r for r in lexicon(docs, PATH, least=1).collect()}
    assert set(found) == {"common", "tail."} | {f"word{i}" for i in range(50)}
    assert found["common"].parts == 4
    assert ids(found["tail."].ids) == library.encode_ordinary(" tail.")
    again = encode(docs, PATH, words_of=lexicon(docs.limit(1), PATH, least=1))
    assert {r.id: ids(r.ids) for r in again.collect()} == {r.doc_id: library.encode_ordinary(r.text) for r in docs.collect()}


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert encode(docs, PATH).count() == 0
    coded = spark.createDataFrame([(1, None), (2, b"")], "id long, ids binary")
    assert [(r.id, r.bytes) for r in decode(coded, PATH).collect()] == [(1, None), (2, b"")]


def test_query_on_whole_texts(spark, library):
    from orebody.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_bpe"](spark, folder).collect()}
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        a = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(a), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in a)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
