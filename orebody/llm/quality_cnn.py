"""Document quality by a byte-level convolutional network in numpy.

A text is read as UTF-8 bytes, each of which has a learned embedding of its own.
Filters of ``WIDTH`` bytes are applied every ``STRIDE`` bytes, so their chunks
overlap and cover the whole document.  Each filter's ReLU output is averaged over
spans of ``SPAN`` chunks, the largest average in the document is kept (max-pooling),
and a logistic layer turns the pooled vector into one probability.

A long text is read in blocks that overlap by a span, with a running maximum, so
memory does not grow with its length.

Training takes at most ``MOST_LABELLED`` labelled documents of each class, chosen by a
hash of their id, leaving out those of over ``MOST_BYTES``.  That bound is the only
sample: scores come from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED, WIDTH, STRIDE, FILTERS, SPAN = 8, 8, 4, 40, 40
MOST_LABELLED, MOST_BYTES = 600, 1 << 16
#: Bytes of a text that are convolved at once; a multiple of STRIDE.
BLOCK = 1 << 16
#: Bytes before a block that its first spans look back on.
_SPAN_BYTES = -(-(STRIDE * (SPAN - 1) + WIDTH) // STRIDE) * STRIDE


def kinds() -> np.ndarray:
    """A kind for each byte; bytes of one kind begin with nearly the same embedding and learn to differ."""
    tests = (str.islower, str.isupper, str.isdigit, str.isspace, str.isprintable)
    of = lambda c: next((k for k, test in enumerate(tests) if test(c)), len(tests))
    # Punctuation marks are kinds of their own.
    return np.array([6 if b > 127 else b if 32 < b < 127 and not chr(b).isalnum() else 128 + of(chr(b)) for b in range(256)])


def chunks(data: np.ndarray) -> np.ndarray:
    """The bytes of each chunk, (n, WIDTH), n at least SPAN; the end is padded with zero bytes."""
    least = STRIDE * (SPAN - 1) + WIDTH
    pad = least - len(data) if len(data) < least else -(len(data) - WIDTH) % STRIDE
    if pad:
        data = np.concatenate((data, np.zeros(pad, dtype=np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(data, WIDTH)[::STRIDE]


class Network:
    """Weights and the forward pass."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = (rng.normal(0, 0.5, (256, EMBED))[kinds()] + rng.normal(0, 0.05, (256, EMBED))).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)

    def weights(self) -> dict[str, np.ndarray]:
        return {k: v for k, v in vars(self).items() if isinstance(v, np.ndarray)}

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The largest span average of each filter, where its span begins, and what it came from."""
        read = chunks(data)
        x = self.embed[read].reshape(len(read), WIDTH * EMBED)
        h = np.maximum(x @ self.filters + self.bias, 0)
        total = np.cumsum(h, axis=0, dtype=np.float64)
        spans = total[SPAN - 1 :].copy()
        spans[1:] -= total[:-SPAN]
        at = spans.argmax(axis=0)
        return (spans[at, np.arange(FILTERS)] / SPAN).astype(np.float32), at, (read, x, h)

    def score(self, text: bytes) -> float:
        """The probability of label 1; for the empty text that of nothing but padding."""
        data = np.frombuffer(text, dtype=np.uint8)
        best = None
        for at in range(0, max(len(data), 1), BLOCK):
            part = self.pooled(data[max(0, at - _SPAN_BYTES) : at + BLOCK])[0]
            best = part if best is None else np.maximum(best, part)
        return float(1 / (1 + np.exp(-np.clip(best @ self.out + self.shift[0], -30, 30))))


def train(texts: list[bytes], labels: list[int], epochs: int = 20, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on the mean log loss; only the winning spans carry a gradient."""
    net, rng = Network(seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    y = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.shift[:] = 0 if not labels else (4 if labels[0] else -4)
        return net
    weights = net.weights()
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step, batch = 0, 32
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), -(-len(data) // batch)):
            grad = {k: np.zeros_like(v) for k, v in weights.items()}
            for i in part:
                pool, at, (read, x, h) = net.pooled(data[i])
                p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.shift[0], -30, 30)))
                d = (p - y[i]) / len(part)
                grad["out"] += d * pool
                grad["shift"] += d
                rows = at[None, :] + np.arange(SPAN)[:, None]
                cols = np.broadcast_to(np.arange(FILTERS), rows.shape)
                g = np.where(h[rows, cols] > 0, d * net.out / SPAN, 0).astype(np.float32)
                taken, where = np.unique(rows, return_inverse=True)
                dh = np.zeros((len(taken), FILTERS), dtype=np.float32)
                np.add.at(dh, (where.reshape(rows.shape), cols), g)
                grad["filters"] += x[taken].T @ dh
                grad["bias"] += dh.sum(axis=0)
                np.add.at(grad["embed"], read[taken], (dh @ net.filters.T).reshape(-1, WIDTH, EMBED))
            step += 1
            slow = rate * (1 - epoch / epochs)
            for k, w in weights.items():
                g = grad[k] + (1e-4 * w if k in ("filters", "out") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Column: whether crc32 of the id as text leaves 0 modulo ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> pd.DataFrame:
    """At most ``most`` documents of each label, in order of a hash of their id: a bounded sample.

    Held-out ids, null labels and ids with both labels are left out.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(
        F.min(label_col).alias("y"), F.max(label_col).alias("__z")
    ).where("y = __z").select("__id", "y", F.xxhash64("__id").alias("__h"))
    ids = one.where("y = 0").orderBy("__h", "__id").limit(most).unionByName(one.where("y = 1").orderBy("__h", "__id").limit(most))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__d"), text.alias("text")).where(F.octet_length("text") <= MOST_BYTES)
    rows = rows.join(F.broadcast(ids), F.col("__d") == F.col("__id"))
    # One row an id before anything is collected: of differing texts the least.
    rows = rows.groupBy("__id", "y", "__h").agg(F.min("text").alias("text"))
    return rows.toPandas().sort_values(["__h", "__id"]).reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Network:
    """The network that ``train`` makes of ``training_rows``: at most ``most`` documents of each label.

    Null labels, labels other than 0 and 1, ids with both labels and held-out ids teach
    nothing, repeated rows teach once.  Without labels of both kinds every text gets the
    same score: 0.5 without any, else one near the only label.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    return train([t.encode() for t in rows["text"]], [int(y) for y in rows["y"]])


def score(docs: DataFrame, net: Network, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each text in column ``into``; null texts count as empty.

    Every row and column stays; an empty table gives an empty result.
    """
    import pyspark.sql.types as T

    kept = [f for f in docs.schema.fields if f.name != into]
    names = [f.name for f in kept]
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).cast(pa.binary())
            scores = [model.value.score(t.as_py() or b"") for t in texts]
            yield batch.append_column(into, pa.array(scores, pa.float64()))

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField(into, T.DoubleType())]))
