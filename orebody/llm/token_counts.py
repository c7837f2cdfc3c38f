"""Token counts behind a digest cache.

The cache is a Parquet table of ``content`` (SHA-256 of the normalised text),
``tokenizer`` (SHA-256 of the tokenizer's file) and ``n_tokens``.  A run joins the
documents' digests to it, encodes only distinct texts that it lacks, appends
these counts, and reads every document's count from the table.  A changed
tokenizer file has another digest, so old counts never answer for it.

Normalising only turns null into the empty text: anything more could change a count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path, stored

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
#: Characters of words whose counts a worker keeps, and of the longest such word; beyond the first it starts anew.
MEMO_CHARS, MEMO_WORD = 4_000_000, 100

#: Characters of text that are encoded at once.
SLICE_CHARS = 1_000_000

#: What byte-level BPE splits a text into first, for texts of these characters only;
#: on any other character the whole text goes through the library.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_OTHER = re.compile(rf"[^\n\t -~{_LETTERS}]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class Counter:
    """Counts tokens as the library of a tokenizer file does, without added special tokens.

    ``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``.
    Special strings inside a text are handled as the library does by default;
    nothing is truncated or padded.

    Byte-level BPE without a normaliser encodes each word of its pre-split alone, so
    a text's count is the sum over its words.  There each word is encoded once and
    its count kept; the sum equals the library's count of the whole text.
    """

    def __init__(self, path: str) -> None:
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self._whole = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("ignore_merges")
            and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        )
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._memo: dict[str, int] = {}
        self._held = 0

    def __call__(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for part in _slices(texts):
            out += self._some(part)
        return out

    def _some(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._whole(texts)
        odd = [i for i, t in enumerate(texts) if _OTHER.search(t) or (self._added and self._added.search(t))]
        out = dict(zip(odd, self._whole([texts[i] for i in odd]), strict=True)) if odd else {}
        words = {i: _WORDS.findall(t) for i, t in enumerate(texts) if i not in out}
        memo = self._memo
        if self._held > MEMO_CHARS:
            memo.clear()
            self._held = 0
        new = list(set().union(*words.values()).difference(memo)) if words else []
        long = {}
        for w, n in zip(new, self._whole(new), strict=True):
            if len(w) > MEMO_WORD:
                long[w] = n
            else:
                memo[w] = n
                self._held += len(w)
        count = (lambda w: long[w] if w in long else memo[w]) if long else memo.__getitem__
        return [out[i] if i in out else sum(map(count, words[i])) for i in range(len(texts))]


def _slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """``texts`` in order, in lists of about ``chars`` characters."""
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def file_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer`` is a file that every executor has; ``cache`` a Parquet table to
    use and append to, made where missing (None: a fresh one in the shared folder).

    A null text counts as empty: no bytes, and the tokens that the library gives an
    empty text.  Repeated texts are encoded once and repeated rows stay.  Null ids
    stay null.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token_counts")
    version = file_digest(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = F.unhex(F.sha2(text.cast("binary"), 256))
    need = docs.select(content.alias("content"), text.alias("text")).dropDuplicates(["content"])

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version))
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    if _exists(spark, cache):
        need = need.join(known(), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(tokenizer)
        for batch in batches:
            n = count(batch.column(1).to_pylist())
            digests = pa.array([version] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    need.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    rows = docs.select(F.col(id_col).alias("id"), content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    # Written first, so that the join stands on its own and a text with very many copies can be split.
    return rows.join(stored(known(), "counts"), "content").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
