"""Nearest neighbours from randomly rotated one-bit codes.

A unit vector is rotated by a fixed random rotation and stored as its signs, one bit a dimension, with one correction
scalar, its inner product with its own code. From the bits and the scalar the cosine with a query is estimated, with an
error bound that holds with high probability; the vectors whose upper bound reaches the k-th best exact score found so
far are reranked on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzgrid.storage import BROADCAST_BYTES

#: Half width of the error bound, in standard deviations of the estimate.
EPSILON = 4.0
#: Rows in a packed block, queries in a slot, candidates scored first to get a k-th best score.
BLOCK_ROWS, SLOT_QUERIES, FIRST = 4096, 512, 32
#: Rows of a group, where the queries are too many to be broadcast: a group and a slot meet in one place.
GROUP_ROWS = 1 << 18
SEED = 97


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` holds for, its k rows of largest cosine but its own.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. Vectors that are null, empty or
    zero or hold null or non-finite components take no part, nor do rows with a null id; vectors of other dimensions
    than a query's are no candidates of it. Of rows with equal ids and vectors one counts. An empty table gives no rows.
    Columns other than those that the arguments name are not read, whatever their names.

    Rows stay where they are read, packed in blocks of BLOCK_ROWS; queries come to them in slots of about SLOT_QUERIES:
    broadcast, if all of them take at most `broadcast_bytes`; else each slot is sent once to each group of about
    GROUP_ROWS rows, and each group once to each slot. Only k rows of each query leave a task. The work grows with rows
    times queries, as all rows are to be searched.
    """
    doubles = F.transform(F.col("vector"), lambda x: x.cast("double")).alias("vector")
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    queries = rows.where("asks").select("id", "vector").distinct().select("id", doubles)
    total = queries.agg(F.count("*").alias("n"), F.sum(F.size("vector") * 8 + 16).alias("bytes")).first()
    slots = max(1, -(-total.n // SLOT_QUERIES))
    packed = rows.select("id", doubles).mapInArrow(_encoded, "dim int, ids binary, vectors binary, codes binary, own binary")
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot")
    asked = queries.select(F.size("vector").alias("dim"), slot, "id", "vector").groupBy("slot", "dim").agg(F.collect_list("id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("queries"))
    if (total.bytes or 0) <= broadcast_bytes:
        met = packed.join(F.broadcast(asked), "dim")
    else:
        groups = max(1, -(-rows.count() // GROUP_ROWS))
        dealt = packed.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        met = dealt.join(asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), ["slot", "dim", "group"]).select("dim", "ids", "vectors", "codes", "own", "slot", "query_ids", "queries")
    best = met.mapInArrow(_reranked(k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and each one's inner product with its code."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    unit = scaled / lengths(scaled)[:, None]
    turned = unit @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(batch["vector"].offsets.to_numpy())
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            ids = part["id"].to_numpy(zero_copy_only=False)
            vectors = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out = []
            for k in range(0, len(ids), BLOCK_ROWS):
                codes, own = encode(vectors[k : k + BLOCK_ROWS])
                out.append((int(dim), ids[k : k + BLOCK_ROWS].tobytes(), vectors[k : k + BLOCK_ROWS].tobytes(), codes.tobytes(), own.tobytes()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["dim", "ids", "vectors", "codes", "own"])


def squares(vectors: np.ndarray) -> np.ndarray:
    return np.cumsum(vectors * vectors, axis=1)[:, -1]


def cosines(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Of rows with rows, given their sums of squares: sums run from the first component to the last, so a row's value depends on its numbers alone."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = np.cumsum(a * b, axis=1)[:, -1] / np.sqrt(aa * bb)
    far = ~np.isfinite(aa * bb) | (aa * bb == 0)  # beyond what squares of doubles hold: scaled first
    if far.any():
        x, y = (v[far] / np.abs(v[far]).max(axis=1, keepdims=True) for v in (a, b))
        out[far] = np.cumsum(x * y, axis=1)[:, -1] / np.sqrt(squares(x) * squares(y))
    return np.clip(out, -1.0, 1.0)


def _reranked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple[int, int], _Slot] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch["dim"][row].as_py()
                binary = lambda name, kind: np.frombuffer(batch[name][row].as_buffer(), kind)
                ids, own = binary("ids", np.int64), binary("own", np.float64)
                vectors, codes = binary("vectors", np.float64).reshape(-1, dim), binary("codes", np.uint8).reshape(len(ids), -1)
                key = (batch["slot"][row].as_py(), dim)
                if key not in slots:
                    asked = batch["query_ids"][row].values.to_numpy(zero_copy_only=False).copy()
                    slots[key] = _Slot(asked, batch["queries"][row].values.to_numpy(zero_copy_only=False).reshape(-1, dim).copy(), k)
                slots[key].search(*_distinct(ids, vectors, codes, own))
        for slot in slots.values():
            yield slot.found()

    return run


def _distinct(ids, vectors, codes, own):
    """Repeated rows would take places from others: one of each stays."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors, codes, own
    rows = np.concatenate([ids[:, None].view(np.uint8).reshape(len(ids), 8), np.ascontiguousarray(vectors).view(np.uint8).reshape(len(ids), -1)], axis=1)
    first = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True)[1]
    return ids[first], vectors[first], codes[first], own[first]


class _Slot:
    """Queries and the best k rows of each among the blocks seen so far; their k-th scores are what a bound has to reach."""

    def __init__(self, asked: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.asked, self.queries, self.k = asked, queries, k
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        self.turned = ((scaled / lengths(scaled)[:, None]) @ rotation(queries.shape[1]).T).astype(np.float32)
        self.q, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.reach = np.full(len(asked), -np.inf)

    def search(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, own: np.ndarray) -> None:
        dim, n = vectors.shape[1], len(ids)
        signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
        estimate = self.turned @ signs.T
        estimate /= (np.sqrt(dim) * own).astype(np.float32)[None, :]
        bound = (EPSILON * np.sqrt(np.maximum(0, 1 - own**2)) / own / np.sqrt(max(1, dim - 1))).astype(np.float32)
        estimate[self.asked[:, None] == ids[None, :]] = -np.inf
        if not np.isfinite(self.reach).all():
            first = np.argpartition(-estimate, min(FIRST, n) - 1, axis=1)[:, : min(FIRST, n)]
            q = np.repeat(np.arange(len(self.asked)), first.shape[1])
            self._merge(q, first.ravel(), ids, vectors)
        estimate += bound[None, :]
        q, c = np.nonzero(estimate >= (self.reach - 1e-6).astype(np.float32)[:, None])
        self._merge(q, c, ids, vectors)

    def _merge(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = self.asked[q] != ids[c]
        q, c = q[other], c[other]
        score = _exact(self.queries, vectors, q, c)
        q, named, score = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids[c]), (self.scores, score)))
        if not len(q):
            return
        order = np.lexsort((named, -score, q))
        q, named, score = q[order], named[order], score[order]
        again = np.append(False, (q[1:] == q[:-1]) & (named[1:] == named[:-1]) & (score[1:] == score[:-1]))
        q, named, score = q[~again], named[~again], score[~again]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.ids, self.scores = q[top], named[top], score[top]
        last = np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1
        self.reach[self.q[last]] = self.scores[last]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.asked[self.q]), pa.array(self.ids), pa.array(self.scores)], names=["query_id", "vec_id", "score"])


def _exact(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, 2_000_000 // queries.shape[1])
    qq, cc = squares(queries), squares(vectors)
    parts = [cosines(queries[q[k : k + step]], vectors[c[k : k + step]], qq[q[k : k + step]], cc[c[k : k + step]]) for k in range(0, len(q), step)]
    return np.concatenate(parts) if parts else np.zeros(0)
