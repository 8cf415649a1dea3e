"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(bias + w.x + sum over pairs i < j of <v_i, v_j> x_i x_j). The pairs cost time linear in the features
by the sum-of-squares identity: half the sum over factors of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzgrid.llm.common import WordTable, returning_memory, text_of
from quartzgrid.storage import numbered, picked, place_of

#: Buckets of hashed words, factors of a feature, and rows of the bounded training sample.
BUCKETS, FACTORS, SAMPLE_ROWS = 1 << 13, 8, 8000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.03, 1e-4
FOLDS, HELD_OUT = 5, 0
#: Rows that keep_good takes at once.
KEPT_ROWS = 512

_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"
_FLAGS = ("upper", "shout", "symbol", "pipe", "digit", "title", "tagged")
STATISTICS = ("words", "length", "distinct", "top", "upper", "punctuation", "symbols", "digits", "wide", "lines", "ends", "long", *(f"word_{f}" for f in _FLAGS), "declared", "undeclared")
_UPPER, _PUNCTUATION, _SYMBOL, _DIGIT, _WIDE = (
    np.isin(np.arange(256), list(x)) for x in (range(65, 91), b".,;:!?'\"()-|/", _SYMBOLS, range(48, 58), range(128, 256))
)
FEATURES = BUCKETS + len(STATISTICS)


def _coded(word: bytes) -> int:
    """The bucket of a word and, in the low bits, what it looks like."""
    letters = word.isalpha() and word.isascii()
    flags = (
        word.isupper() and len(word) > 1,
        word.endswith(b"!!"),
        word[-1:] in _SYMBOLS or any(c in _SYMBOLS for c in word),
        word == b"|",
        any(48 <= c <= 57 for c in word),
        word[:1].isupper() and not word.isupper(),
        not letters and word.count(b"<") + word.count(b"/") > 0,
    )
    return (zlib.crc32(word.lower()) % BUCKETS) << 8 | sum(1 << k for k, x in enumerate(flags) if x)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: Rows) -> np.ndarray:
        return _sigmoid(self.bias + _forward(rows, self.weights, self.factors)[0])


@dataclass
class Rows:
    """Sparse feature vectors, one after another; each has at least its statistics."""

    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def pick(self, which: np.ndarray) -> Rows:
        ends = np.append(self.starts[1:], len(self.index))
        parts = [np.arange(self.starts[i], ends[i]) for i in which]
        at = np.concatenate(parts)
        return Rows(np.cumsum([0, *map(len, parts[:-1])]), self.index[at], self.value[at])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _forward(rows: Rows, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms = factors[rows.index] * rows.value[:, None]
    sums = np.add.reduceat(terms, rows.starts, axis=0)
    squares = np.add.reduceat(terms * terms, rows.starts, axis=0)
    linear = np.add.reduceat(weights[rows.index] * rows.value, rows.starts)
    return linear + 0.5 * (sums * sums - squares).sum(axis=1), terms, sums


class Features:
    """Turns texts into sparse vectors; keeps the codes of the words it has met."""

    def __init__(self) -> None:
        self.codes = WordTable(_coded)

    def of(self, text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        n, size = max(1, len(words)), max(1, len(data))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        buckets, counts = np.unique(codes >> 8, return_counts=True)
        chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        flags = [np.count_nonzero(codes & (1 << k)) / n for k in range(len(_FLAGS))]
        lines = data.count(b"\n") + 1
        statistics = [
            np.log1p(len(words)) / 10, min(1.5, size / n / 10), len(buckets) / n, counts.max(initial=0) / n,
            *(chars[kind].sum() / size for kind in (_UPPER, _PUNCTUATION, _SYMBOL, _DIGIT, _WIDE)),
            min(1.0, 10 * lines / n), min(1.0, 5 * chars[46] / n), min(1.0, size / lines / 2000), *flags,
            np.log1p(max(0, declared or 0)) / 15, float(declared is None),
        ]
        value = np.log1p(counts)
        value = value / max(1e-9, np.sqrt((value * value).sum()))
        index = np.concatenate([buckets, np.arange(BUCKETS, FEATURES)]).astype(np.int32)
        return index, np.concatenate([value, statistics]).astype(np.float32)


def _stacked(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    return Rows(np.cumsum([0, *(len(x[0]) for x in pairs[:-1])]), np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]).astype(np.float64))


def held_out(id_column: str = "doc_id"):
    """Whether a row belongs to the fold that no model learns from; a null id does."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _described(documents: DataFrame, id_column: str, text_column: str, chars_column: str) -> DataFrame:
    names = {"id": id_column, "text": text_column} | ({"declared": chars_column} if chars_column in documents.columns else {})
    read = picked(documents, names)
    declared = F.col("declared").try_cast("long") if "declared" in read.columns else F.lit(None).cast("long")
    return read.select(F.col("id").cast("long").alias("id"), text_of(F.col("text")).alias("text"), declared.alias("declared"))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Machine:
    """Learns from at most `sample_rows` labelled documents outside the held-out fold, the same ones on each run.

    The sample is the rows of smallest hash of (id, seed), so it doesn't depend on order. Rows with a null id or label are
    left out; of several labels for a document the smallest counts; of repeated documents, or of others with an equal id,
    one is learned from. Null and empty texts are learned from by their statistics, very long ones whole. Without
    labelled documents, with empty tables, or with labels of one kind only, the scores are that kind's smoothed share for
    all. Columns other than the named ones are not read, whatever their names.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(F.col(label)).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows)
    # The sample is bounded by its parameter, so it is safe to broadcast and, as features, to collect.
    rows = _described(documents, id_column, text_column, chars_column).join(F.broadcast(sample), "id").dropDuplicates(["id"])
    found = rows.mapInArrow(_feature_rows, "id long, label int, at binary, value binary").toPandas().sort_values("id")
    y = found["label"].to_numpy(dtype=np.float64)
    weights, factors = np.zeros(FEATURES), np.random.default_rng(seed).normal(0, 0.02, (FEATURES, FACTORS))
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(share / (1 - share))), weights, factors * 0)
    data = _stacked([(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(found["at"], found["value"])])
    return _fitted(data, y, weights, factors, seed)


def _fitted(data: Rows, y: np.ndarray, weights: np.ndarray, factors: np.ndarray, seed: int) -> Machine:
    """Adagrad on the log loss, in mini-batches; both kinds of label weigh the same in all."""
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    past_w, past_v, past_b, bias = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6), 1e-6, 0.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            which = order[k : k + BATCH]
            rows = data.pick(which)
            raw, terms, sums = _forward(rows, weights, factors)
            error = weight[which] * (_sigmoid(bias + raw) - y[which]) / len(which)
            each = np.repeat(np.arange(len(which)), np.diff(np.append(rows.starts, len(rows.index))))
            slope = error[each] * rows.value
            touched, at = np.unique(rows.index, return_inverse=True)
            grad_w = np.bincount(at, slope) + DECAY * weights[touched]
            pull = slope[:, None] * (sums[each] - terms)
            grad_v = np.stack([np.bincount(at, pull[:, f]) for f in range(FACTORS)], axis=1) + DECAY * factors[touched]
            past_w[touched] += grad_w**2
            past_v[touched] += grad_v**2
            past_b += error.sum() ** 2
            weights[touched] -= 4 * RATE * grad_w / np.sqrt(past_w[touched])
            factors[touched] -= RATE * grad_v / np.sqrt(past_v[touched])
            bias -= RATE * error.sum() / np.sqrt(past_b)
    return Machine(float(bias), weights, factors)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        pairs = [features.of(t, d) for t, d in zip(batch["text"].to_pylist(), batch["declared"].to_pylist())]
        columns = [batch["id"], batch["label"], pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([b.tobytes() for _, b in pairs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "at", "value"])


def score(documents: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """One row per row of `documents`: id, held_out and score (0 to 1, higher: label 1 likelier).

    Whole texts are scored; null and empty ones by their statistics. A null id counts as held out. Columns other than
    id, text and the declared length (which may be missing) are not read.
    """
    rows = _described(documents, id_column, text_column, chars_column).withColumn("held_out", held_out("id"))
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))  # their size is fixed by BUCKETS and FACTORS

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            if batch.num_rows:
                values = _scores(batch["text"].to_pylist(), batch["declared"].to_pylist(), features, Machine(*shared.value))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(values)], names=["id", "held_out", "score"])

    return rows.mapInArrow(scored, "id long, held_out boolean, score double").withColumnRenamed("id", id_column)


def _scores(texts: list[str | None], declared: list[int | None], features: Features, machine: Machine) -> np.ndarray:
    parts = []
    for k in range(0, len(texts), 256):
        parts.append(machine.score(_stacked([features.of(t, d) for t, d in zip(texts[k : k + 256], declared[k : k + 256])])))
    return np.concatenate(parts)


def keep_good(documents: DataFrame, machine: Machine, threshold: float = 0.3, text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """The rows, whole and with all their columns, that score at least `threshold`. Needs no join and no shuffle.

    Rows with null ids are judged like others; null and empty texts by their statistics; repeated rows stay or go alike,
    each by itself. Very long texts are scored whole. An empty table stays empty. Other columns may have any name.
    """
    shared = documents.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))
    rows, text = numbered(documents), place_of(documents, text_column)
    chars = place_of(documents, chars_column) if chars_column in documents.columns else None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in (whole.slice(k, KEPT_ROWS) for whole in batches for k in range(0, whole.num_rows, KEPT_ROWS)):
            if batch.num_rows:
                declared = [x if isinstance(x, int) else None for x in batch[chars].to_pylist()] if chars else [None] * batch.num_rows
                yield batch.filter(pa.array(_scores(batch[text].to_pylist(), declared, features, Machine(*shared.value)) >= threshold))

    return rows.mapInArrow(returning_memory(kept), rows.schema).toDF(*documents.columns)
