"""Quality classifier: random-indexing word vectors and a two-layer network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.llm.common import chunks, fold, texts

#: Rows of the word table, dimensions of a vector, entries of an index vector.
BUCKETS, DIMENSIONS, ENTRIES = 4096, 24, 3
#: Labelled rows that may train the network.
LABELLED = 20_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Word hashes a worker remembers.
WORDS_KEPT = 300_000


def _bucket(token: str) -> int:
    """Letters keep their case pattern, digits their count, signs themselves."""
    import xxhash

    if token.isdigit():
        token = "d" + "0" * min(len(token), 8)
    elif len(token) > 1 and token.isupper():
        token = "U" + token.lower()
    else:
        token = "l" + token.lower()
    return xxhash.xxh3_64_intdigest(token) % (BUCKETS - 2) + 2


class _Tokens(dict):
    """Buckets of the tokens in a piece of text without blanks, as bytes."""

    def __missing__(self, piece: str) -> bytes:
        # Most pieces are letters and a sign, which the pattern would split alike.
        core = piece.rstrip(".,;:!?")
        tokens = filter(None, (core, piece[len(core) :])) if core.isalpha() else _TOKEN.findall(piece)
        value = b"".join(_bucket(token).to_bytes(8, "little") for token in tokens)
        if len(self) < WORDS_KEPT and len(piece) < 64:
            self[piece] = value
        return value


def token_buckets(text: str, known: _Tokens) -> np.ndarray:
    """Buckets of the tokens of a text; bucket 1 follows a token that repeats one of the last two."""
    buckets = np.frombuffer(b"".join(map(known.__getitem__, text.split())), np.int64)
    if len(buckets) < 2:
        return buckets
    again = np.zeros(len(buckets), bool)
    again[1:] = buckets[1:] == buckets[:-1]
    again[2:] |= buckets[2:] == buckets[:-2]
    return np.insert(buckets, np.flatnonzero(again) + 1, 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector; the rule is fixed, so every task makes the same."""
    rng = np.random.default_rng(7)
    places = rng.random((BUCKETS, DIMENSIONS)).argsort(axis=1)[:, :ENTRIES]
    return places, rng.choice((-1.0, 1.0), (BUCKETS, ENTRIES))


def _add_contexts(total: np.ndarray, buckets: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each word the index vectors of the words beside it (two on either side)."""
    flat = np.concatenate([np.concatenate((b, (-1, -1))) for b in buckets])
    for gap in (1, 2):
        left, right = flat[:-gap], flat[gap:]
        inside = (left >= 0) & (right >= 0)
        left, right = left[inside], right[inside]
        for word, beside in ((left, right), (right, left)):
            for e in range(ENTRIES):
                total += np.bincount(word * DIMENSIONS + places[beside, e], signs[beside, e], BUCKETS * DIMENSIONS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets, summed over every word of every document.

    A task adds up its own documents and returns the table once; tasks are added in keyed sums.
    The table has BUCKETS rows whatever the corpus, and whole numbers, so the order of sums
    does not matter.
    """
    names = [f"c{d}" for d in range(DIMENSIONS)]

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, (places, signs), total = _Tokens(), index_vectors(), np.zeros(BUCKETS * DIMENSIONS)
        for _, batch in chunks(batches):
            _add_contexts(total, [token_buckets(t, known) for t in batch], places, signs)
        total = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(total.any(axis=1))
        whole = total[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(whole[:, d]) for d in range(DIMENSIONS))], names=["bucket", *names])

    schema = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(c, T.LongType()) for c in names)])
    rows = docs.mapInArrow(count, schema).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).collect()
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    for row in rows:
        vectors[row[0]] = row[1:]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1)


def pooled(buckets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a document, its length and the share of repeats; zeros if it is empty."""
    if not len(buckets):
        return np.zeros(2 * DIMENSIONS + 2)
    counts = np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    weights, rows = counts[used] / len(buckets), vectors[used]
    mean = weights @ rows
    spread = np.sqrt(np.maximum(weights @ rows**2 - mean**2, 0))
    return np.concatenate((mean, spread, (np.log1p(len(buckets)) / 10, counts[1] / len(buckets))))


@dataclass
class Network:
    """One hidden layer of tanh units, a logistic output and a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> Network:
    """Fit by Adam on classes of equal weight in all, then set the temperature on a fifth kept apart.

    The temperature minimises the log loss at the classes' true shares, which an added bias
    restores; it only softens. With one class only, every score is that class.
    """
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    share = np.clip(y.mean(), 0.01, 0.99)
    net = Network(centre, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0)
    if y.min() == y.max():
        net.w2[:] = 0
        net.b2 = 20.0 if y[0] else -20.0
        return net
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    if not len(held) or y[fit].min() == y[fit].max():
        held = fit = order
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    z = (x - centre) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 128):
            rows = fit[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
            error = (p - y[rows]) * weight[rows] / len(rows)
            back = np.outer(error, params[2]) * (1 - h**2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                params[i] -= 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2 = params[:3]
    net.b2 = float(params[3][0] + np.log(share / (1 - share)))
    raw = net.logits(x[held])

    def loss(t: float) -> float:
        s = np.clip(raw / t, -30, 30)
        return float(np.mean(np.logaddexp(0, s) - y[held] * s))

    net.temperature = float(min(np.exp(np.linspace(0, 2.5, 51)), key=loss))
    return net


def labelled_sample(labels: DataFrame, target: str, modulus: int, held: int, limit: int) -> DataFrame:
    """(doc_id, y) of at most ``limit`` labelled rows outside the held-out fold.

    They come in the order of a hash of the id, so the choice is the same on every run.
    """
    rows = labels.select("doc_id", F.col(target).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    rows = rows.filter(fold(F.col("doc_id"), modulus) != held).dropDuplicates(["doc_id"])
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


@dataclass
class QualityModel:
    """Word vectors and network; a few hundred kilobytes whatever the corpus."""

    vectors: np.ndarray
    network: Network

    def scores(self, batch: list[str], known: _Tokens) -> np.ndarray:
        return self.network.scores(np.array([pooled(token_buckets(t, known), self.vectors) for t in batch]))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> QualityModel:
    """Word vectors of all of ``docs`` (doc_id, text), network of at most ``limit`` labelled rows.

    The driver holds the sample's pooled vectors and the word table, both of fixed size.
    """
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _Tokens()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = [pooled(token_buckets(t, known), shared.value) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64())), part.column("y")], names=["doc_id", "x", "y"])

    # At most ``limit`` short rows; repeated ids are cut to twice that.
    sample = F.broadcast(labelled_sample(labels, "quality", 4, 2, limit).withColumnRenamed("doc_id", "label_id"))
    rows = docs.join(sample, docs["doc_id"] == sample["label_id"]).select("doc_id", "text", "y")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.DoubleType())])
    found = rows.mapInArrow(features, schema).orderBy("doc_id", "x").limit(2 * limit).collect()
    if found:
        return QualityModel(vectors, train_network(np.array([r["x"] for r in found]), np.array([r["y"] for r in found])))
    width = 2 * DIMENSIONS + 2
    return QualityModel(vectors, Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text for quality.

    Word vectors come from all documents (random indexing over hashed tokens), a document is
    the mean and spread of its vectors, and the network learns from labelled rows outside the
    held-out fold.

    Null and empty texts get the score of an empty document, repeated rows the same score each,
    null ids are scored too, no labels give 0.5 for all, an empty table no rows; other columns
    are not read.

    Returns doc_id, held_out, score, predicted.
    """
    docs = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, limit))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _Tokens()
        for ids, batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(model.value.scores(batch, known))], names=["doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    scored = docs.mapInArrow(score, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole rows whose text scores at least ``threshold``; empty and null texts are judged as empty."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(texts(docs, id_col, text_col), labels, limit))

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _Tokens()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.value.scores([t or "" for t in part.column(text_col).to_pylist()], known)
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)
