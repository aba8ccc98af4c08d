"""Quality classifier on supervised subword embeddings.

Every whitespace-separated word gives hashed features: itself and its character n-grams with word boundaries; every two neighbouring words give one more (a word next to itself the same one for all words, as no list of words could teach repetition). Every document has ``PRIOR`` times
an end mark, which draws very short texts to the common score. A feature has a learned vector; a document is the mean of its features' vectors, followed by a softmax over two classes. Vectors and output layer are trained together by plain stochastic gradient
descent in numpy, on at most ``MAX_TRAIN_ROWS`` labelled rows (those with the smallest hashes) whose features take at most ``MAX_TRAIN_BYTES``.
Executors count the features and one task of theirs trains, so that the driver sees no more than one number a feature. Scoring reads every whole text: because the output is linear in
the mean, a word's contribution is one number, kept in a bounded cache.

Only texts enter a score. Defined cases: a null or blank text has the end mark alone; rows without a label or a known
id are not trained on; with labels of one class only, or none, the untrained layer gives 0.5, which counts as class 1;
repeated rows get equal scores.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, BUCKETS, NGRAMS, PRIOR = 8, 1 << 17, (3, 4), 32
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES, STEPS, RATE, SEED = 4000, 256 << 20, 12_000, 0.5, 7
CACHED_WORDS = 50_000
#: Texts whose new words are hashed together.
TOGETHER = 128
FACTOR, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _buckets(hashed: np.ndarray) -> np.ndarray:
    hashed = (hashed ^ (hashed >> np.uint64(29))) * MIXER
    return ((hashed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of its word) of every feature of some words, the words and their character n-grams, and the words' hashes; all in numpy."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), sizes)
    place = np.arange(len(codes)) - (ends - sizes)[of]
    powers = np.multiply.accumulate(np.full(sizes.max(initial=1), FACTOR, np.uint64))
    whole = np.add.reduceat(codes * powers[place], ends - sizes) if len(words) else codes
    found, owners = [whole], [np.arange(len(marked))]
    for n in NGRAMS:
        starts = np.flatnonzero(place + n <= sizes[of])
        gram = codes[starts] + np.uint64(n << 32)
        for k in range(1, n):
            gram = gram * FACTOR + codes[starts + k]
        found.append(gram)
        owners.append(of[starts])
    return _buckets(np.concatenate(found)), np.concatenate(owners), whole


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbours in a text, from the hashes of its words in order. A word and itself are one feature, whatever the word."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * FACTOR
    return np.where(mixed[:-1] == mixed[1:], SAME, _buckets(mixed[:-1] * MIXER + mixed[1:]))


#: The buckets of the end mark and of a word next to itself.
END, SAME = (xxhash.xxh32_intdigest(name, 3) % BUCKETS for name in ("end", "same"))


@dataclass
class Model:
    """Feature vectors, output layer and bias."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> Weights:
        """What each feature adds to the logit of class 1 against class 0, and the bias of that."""
        return Weights(self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0]))


@dataclass
class Weights:
    """All that scoring needs of a model."""

    features: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over (buckets, shares, label) rows, with a falling learning rate."""
    rng = np.random.default_rng(SEED)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    if len({label for _, _, label in rows}) < 2:
        return model
    epochs = max(3, min(60, -(-steps // len(rows))))
    done, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, shares, label = rows[i]
            vectors = model.vectors.take(buckets, axis=0)
            mean = shares @ vectors
            logits = mean @ model.output + model.bias
            slope = np.exp(logits - logits.max())
            slope /= slope.sum()
            slope[label] -= 1
            now = rate * (1 - done / total)
            back = model.output @ slope
            model.output -= now * np.outer(mean, slope)
            model.bias -= now * slope
            vectors -= np.multiply.outer(now * shares, back)
            model.vectors[buckets] = vectors
            done += 1
    return model


def feature_counts(text: Column) -> Column:
    """Distinct buckets of a text and how often each occurs."""

    @F.arrow_udf("struct<buckets: binary, counts: binary>")
    def counted(texts: pa.Array) -> pa.Array:
        found = []
        for x in texts:
            words, at = np.unique(np.array(x.as_buffer().to_pybytes().split() if x.is_valid else [], object), return_inverse=True)
            features, owner, hashes = word_features(list(words))
            total = np.bincount(features, np.bincount(at, minlength=len(words))[owner], minlength=BUCKETS).astype(np.int32)
            total += np.bincount(bigrams(hashes[at]), minlength=BUCKETS).astype(np.int32)
            total[END] += PRIOR
            buckets = np.flatnonzero(total).astype(np.int32)
            found.append((buckets.tobytes(), total[buckets].tobytes()))
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in range(2)], ["buckets", "counts"])

    return counted(text)


class _Words(dict):
    """Number of each word seen; ``settle`` gives new ones what they add to a document (``sums``) and their features (``sizes``) and ``hashes``."""

    def __init__(self):
        self.new: list[bytes] = []
        self.sums, self.sizes, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def settle(self, weights: np.ndarray) -> None:
        if self.new:
            features, owner, hashes = word_features(self.new)
            self.sums = np.concatenate((self.sums, np.bincount(owner, weights[features], len(self.new))))
            self.sizes = np.concatenate((self.sizes, np.bincount(owner, minlength=len(self.new))))
            self.hashes = np.concatenate((self.hashes, hashes))
            self.new.clear()


class Scorer:
    """Scores texts; keeps the words it has seen, as far as ``CACHED_WORDS`` goes."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.words = weights, bias, _Words()

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of some texts (UTF-8)."""
        numbered = []
        for text in texts:
            tokens = (text or b"").split()
            numbered.append(np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens)))
        words = self.words
        words.settle(self.weights)
        out = np.empty(len(texts))
        for i, at in enumerate(numbered):
            pairs = bigrams(words.hashes[at])
            total = words.sums[at].sum() + self.weights[pairs].sum() + PRIOR * self.weights[END]
            out[i] = total / (words.sizes[at].sum() + len(pairs) + PRIOR)
        if len(words) > CACHED_WORDS:
            self.words = _Words()
        return 1 / (1 + np.exp(-(out + self.bias)))


#: The scorer of a worker's latest model, which tasks of one worker share.
_scorer: dict[str, Scorer] = {}


def score_column(model: Weights, text: Column) -> Column:
    """Scores of whole texts."""
    weights, bias = model.features, model.bias
    name = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if name not in _scorer:
            _scorer.clear()
            _scorer[name] = Scorer(weights, bias)
        out = []
        for at in range(0, len(texts), TOGETHER):
            out.append(_scorer[name].scores([x.as_buffer().to_pybytes() if x.is_valid else None for x in texts[at : at + TOGETHER]]))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return scored(text)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks held-out rows. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def _trained(batches):
    """One row of the weights trained on rows (quality, buckets, counts), which come in order, as far as MAX_TRAIN_BYTES goes."""
    rows, size = [], 0
    for batch in batches:
        for quality, buckets, counts in zip(*(batch.column(c) for c in ("quality", "buckets", "counts"))):
            taken = np.frombuffer(counts.as_py(), np.int32)
            size += 12 * taken.size
            if size <= MAX_TRAIN_BYTES:
                rows.append((np.frombuffer(buckets.as_py(), np.int32), taken / taken.sum(), quality.as_py()))
    found = train(rows).weights()
    yield pa.RecordBatch.from_arrays([pa.array([found.features.tobytes()]), pa.array([found.bias])], names=["features", "bias"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Weights:
    """A model from the labelled rows that are not held out. docs: doc_id, text; labels: doc_id, quality."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # of contradicting labels the stricter
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", F.xxhash64("doc_id", "text").alias("h"), feature_counts(F.col("text")).alias("f"))
    # One id may have any number of rows, so they are bounded once more.
    rows = rows.select("quality", "h", "f.buckets", "f.counts").orderBy("h", "buckets", "counts").limit(max_rows).select("quality", "buckets", "counts")
    found = rows.mapInArrow(_trained, "features binary, bias double").collect()
    if not found:  # no partition, no rows
        return train([]).weights()
    return Weights(np.frombuffer(found[0]["features"], np.float64), found[0]["bias"])


def mark(docs: DataFrame, labels: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """docs with held_out, score and predicted. The model is fitted on docs, or on another table of documents."""
    model = fit(docs if trained_on is None else trained_on, labels)
    scored = docs.withColumns({"held_out": remainder(F.col("doc_id")) == 1, "score": score_column(model, F.col("text"))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier predicts to be of class 1."""
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    marked = mark(docs.select("doc_id", "text", *own), labels, docs).where("predicted = 1")
    return marked.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
