"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of its distinct words' character n-grams (of three to five bytes, with the word's ends marked, and the
word whole); each n-gram has an embedding (hashed into buckets), the text is their average, and a linear softmax over it gives
the class. Averaged over all words instead, long texts drown what a few words say (1.0 % of clean texts were called toxic
where 96 % of the toxic ones were found, against 0.6 % where 97 % were). Toxic texts weigh TOXIC times in the loss.
Embeddings and softmax are trained together in numpy, so that misspellings never seen share the vectors of the n-grams they
keep. Training is on a bounded sample of labelled rows, those with the least hash of the id, so that each run learns the
same; labels are never inputs of a score. Words are runs of letters, A-Z and the capitals of Latin-1 lowered.

Since both maps are linear, an n-gram adds one number to the logit; a batch of texts sums these by word, then by text.

Cases: null and empty texts score the model's prior; texts are scored whole; a document without label is only scored; of
repeated labels of one id the highest counts; repeated rows of a labelled id are learnt each; null labels and labels of null
ids aren't learnt; without labels of both classes the score is the share of toxic ones (0.5 without any), and ``clean`` keeps
all rows, as nothing was learnt; a labelled text that exceeds what the sample still may hold isn't learnt, others are; an
empty table gives an empty result; other columns are ignored (``clean`` keeps those of the documents).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, hash_words, id_bucket, mix, pieces, raw_bytes, small_batches, trim, word_bounds

SAMPLE_ROWS = 6_000  # labelled rows that the training may read
SAMPLE_BYTES = 40_000_000  # and bytes of their texts
TOXIC = 6.0
CHUNK = 40_000  # words whose n-grams are made at once
BUCKETS = 1 << 17
DIMENSIONS = 8
SIZES = (3, 4, 5)
UNITS = 20.0  # averages are small: it only changes the units of the embeddings
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_LETTER[0x80:0xC0] = True  # a later byte of a letter
_BASE = np.uint64(0x100000001B3)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals of Latin-1 lowered."""
    low = _LOWER[data]
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1
    accent = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
    low[accent] += 0x20
    return low


def no_letters(data: np.ndarray) -> np.ndarray:
    """The bytes with those of general punctuation, and of the symbols of Latin-1, replaced by spaces."""
    two, three = np.flatnonzero(data[:-1] == 0xC2), np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
    three = three[data[three + 1] == 0x80]
    if not len(two) and not len(three):
        return data
    out = data.copy()
    for at in (two, two + 1, three, three + 1, three + 2):
        out[at] = 0x20
    return out


@dataclass
class Bags:
    """The words of a run of texts: each text's first word, each word's number among the distinct ones, and these: hash, bytes
    and first byte (one more than words)."""

    of: np.ndarray
    number: np.ndarray
    hash: np.ndarray
    letters: np.ndarray
    at: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's place and the numbers of its words, each once."""
        most = max(1, len(self.hash))
        return np.divmod(np.unique(np.repeat(np.arange(len(self.of) - 1) * most, np.diff(self.of)) + self.number), most)


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    low = lowered(no_letters(data))
    starts, ends, of = word_bounds(low, offsets, _LETTER)
    h, first, number = np.unique(hash_words(low, starts, ends), return_index=True, return_inverse=True)
    return Bags(of, number, h, *_cut(low, starts[first], ends[first]))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these stretches one after another, and where each begins (one more than stretches)."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], np.diff(at))], at


def subwords(letters: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct words (as in ``Bags``) the word and the bucket of each n-gram, and of each word whole."""
    n = len(at) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(at) + 2
    first = np.cumsum(size) - size
    marked = np.empty(int(size.sum()), np.uint64)
    marked[np.arange(len(letters)) + np.repeat(first + 1 - at[:-1], size - 2)] = letters
    marked[first], marked[first + size - 1] = 60, 62
    word = np.repeat(np.arange(n, dtype=np.int32), size)
    left = np.repeat(first + size, size) - np.arange(len(marked))  # bytes from here to the word's end
    words, keys = [np.arange(n, dtype=np.int32)], [mix(hash_words(letters, at[:-1], at[1:], np.arange(256, dtype=np.uint8)))]
    for k in SIZES:
        if len(marked) < k:
            break
        h = np.zeros(len(marked) - k + 1, np.uint64)
        for i in range(k):
            h = h * _BASE + marked[i : len(marked) - k + 1 + i]
        here = np.flatnonzero((left[: len(h)] >= k) & (size[word[: len(h)]] > k))
        words.append(word[here])
        keys.append(mix(h[here] + np.uint64(k)))
    return np.concatenate(words), (np.concatenate(keys) & np.uint64(buckets - 1)).astype(np.int32)


@dataclass
class Model:
    """What a bucket adds to the logit of the toxic class, the logit's constant, and whether labels of both classes were
    learnt."""

    weight: np.ndarray
    bias: float
    learnt: bool = True

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text."""
        data, offsets = raw_bytes(column)
        out = np.zeros(len(offsets) - 1)
        for first, end, raw, at in pieces(data, offsets):
            b = bags(raw, at)
            word, bucket = subwords(b.letters, b.at, len(self.weight))
            total, n = np.bincount(word, self.weight[bucket], len(b.hash)), np.bincount(word, minlength=len(b.hash))
            text, number = b.pairs()
            sums, grams = np.bincount(text, total[number], end - first), np.bincount(text, n[number], end - first)
            out[first:end] = sums / np.maximum(grams, 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + out, -500, 500)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def train(texts: pa.Array | list[str], toxic: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Model:
    """Embeddings and softmax, trained together by full-batch Adam on the log loss."""
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    n = len(texts)
    share = float(toxic.mean()) if n else 0.5
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    zero = Model(np.zeros(BUCKETS, np.float32), prior if n else 0.0, False)
    if not n or share in (0.0, 1.0):
        return zero
    # Texts and their distinct words.
    data, offsets = raw_bytes(texts)
    rows_, hashes_, known_, letters_, sizes_ = [], [], [], [], []
    for first, end, raw, at in pieces(data, offsets):
        b = bags(raw, at)
        text, number = b.pairs()
        rows_.append((first + text).astype(np.int32))
        hashes_.append(b.hash[number])
        known_.append(b.hash), letters_.append(b.letters), sizes_.append(np.diff(b.at))
    sizes = np.concatenate(sizes_)
    begin = np.cumsum(sizes) - sizes
    hashes, one = np.unique(np.concatenate(known_), return_index=True)
    if not len(hashes):
        return zero
    letters = np.concatenate(letters_)
    del known_, letters_, sizes_
    # N-grams of the words by word, some words at a time.
    n_words, by_word, grams = len(hashes), [], []
    for k in range(0, n_words, CHUNK):
        which = one[k : k + CHUNK]
        word, feature = subwords(*_cut(letters, begin[which], begin[which] + sizes[which]))
        by_word.append(feature[np.argsort(word, kind="stable")])
        grams.append(np.bincount(word, minlength=len(which)).astype(np.int32))
    by_word, grams = np.concatenate(by_word), np.concatenate(grams)
    del letters, begin, sizes, one, word, feature
    rows, cols = np.concatenate(rows_), np.empty(sum(map(len, hashes_)), np.int32)
    at = 0
    for x in hashes_:
        cols[at : at + len(x)] = np.searchsorted(hashes, x)
        at += len(x)
    del rows_, hashes_, hashes
    vals = (1 / np.bincount(rows, grams[cols], n)[rows]).astype(np.float32)  # an n-gram's share of the average
    cost = np.where(toxic > 0, TOXIC, 1.0) / n
    word_at = np.cumsum(grams) - grams
    # And the words of each bucket.
    size = np.bincount(by_word, minlength=BUCKETS)
    used = np.flatnonzero(size)
    bucket_at = (np.cumsum(size) - size)[used]
    by_bucket = np.empty(len(by_word), np.int32)
    fill = np.cumsum(size) - size
    owner = np.repeat(np.arange(n_words, dtype=np.int32), grams)
    for k in range(0, len(by_word), 1 << 20):
        part = by_word[k : k + (1 << 20)]
        order = np.argsort(part, kind="stable")
        b, first, n_b = np.unique(part[order], return_index=True, return_counts=True)
        by_bucket[np.repeat(fill[b] - first, n_b) + np.arange(len(part))] = owner[k : k + (1 << 20)][order]
        fill[b] += n_b
    del owner, fill, size
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    by_word = place[by_word]
    trim()
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (len(used), DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIMENSIONS, 2))
    b = np.array([0.0, prior])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for t in range(1, steps + 1):
        # With two classes the softmax needs only the difference of their logits, one number a bucket.
        per_word = np.add.reduceat((UNITS * (e @ (w[:, 1] - w[:, 0]))).astype(np.float32)[by_word], word_at)
        z = np.bincount(rows, vals * per_word[cols], n) + b[1] - b[0]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * cost
        per_word = np.bincount(cols, vals * g[rows].astype(np.float32), n_words).astype(np.float32)
        s = UNITS * np.add.reduceat(per_word[by_bucket], bucket_at)
        pull = e.T @ s
        grads = (np.outer(s, w[:, 1] - w[:, 0]).astype(np.float32) + np.float32(decay) * e, np.stack([-pull, pull], 1), np.array([-g.sum(), g.sum()]))
        for x, grad, (m, v) in zip((e, w, b), grads, state):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            x -= (rate * (1 - 0.9 * t / steps) / (1 - 0.9**t)) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = UNITS * (e @ (w[:, 1] - w[:, 0]))
    return Model(weight, float(b[1] - b[0]))


def _fitting(sizes: list[int], room: int) -> np.ndarray:
    """Which texts of these sizes fit one after another; one that exceeds what is left takes nothing from the next."""
    kept = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes):
        if n <= room:
            kept[i], room = True, room - n
    return kept


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled documents whose id isn't held out: at most ``sample_rows`` of them, by hash of the id, with at
    most ``sample_bytes`` of text together. Texts are whole; one that doesn't fit into what is left is passed over, and never
    sent to the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(id_bucket(folds) != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text"))
    sized = rows.select("doc_id", "h", "t", F.octet_length("text").alias("bytes")).orderBy("h", "doc_id", "t").limit(sample_rows).toPandas()
    sized = sized[_fitting(sized["bytes"].tolist(), sample_bytes)]
    times = sized.groupby(["doc_id", "t"]).size().reset_index(name="times")
    if not len(times):
        return train([], np.zeros(0))
    keys = docs.sparkSession.createDataFrame(times.values.tolist(), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, times long")
    table = rows.join(F.broadcast(keys), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("h", "doc_id", "t", "text", "toxic", "times").toArrow()  # at most sample_rows rows
    table = table.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("t", "ascending")])
    at = np.repeat(np.arange(len(table)), table.column("times").to_numpy())
    toxic = (table.column("toxic").to_numpy()[at] > 0).astype(float)
    model = train(table.column("text").combine_chunks().take(pa.array(at)), toxic)
    del table
    trim()  # the driver's process goes on
    return model


def _scorer(docs: DataFrame, model: Model):
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    sent = _scorer(docs, model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    rows = docs.select("doc_id", (id_bucket(folds) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``most`` or more; all of them, if nothing was learnt."""
    if not model.learnt:
        return docs
    sent, at = _scorer(docs, model), docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column(at)) < most))
        trim()

    return docs.mapInArrow(f, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
