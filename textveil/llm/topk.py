"""Exact top-k search by inner product over integer vectors, pruned by norms.

Vectors are taken in descending length. For each query the best k scores so far give a threshold. By
Cauchy-Schwarz a vector whose length times the query's is below it cannot enter, and neither can any
shorter one, which ends the query's walk. Vectors and queries are also rotated by the singular vectors
of a sample, which gathers most of each product in the first coordinates: the partial sum over these,
plus the product of the lengths of what remains, bounds the score, and only vectors whose bound
reaches the threshold are multiplied out, in integers held exactly by doubles.

Queries are a stated set and go in blocks of ``query_block`` rows, each broadcast (its size is that
constant times the width). The longest ``seeds`` vectors of the table set each query's threshold, and
from the thresholds follows the least length that a block's scan needs at all. With several blocks the
vectors are written once, in descending length over the whole table, to the shared folder, so that
files and row groups of shorter vectors are skipped; a block's answers are then stored and its
broadcast is released before the next. A task walks chunks of its vectors in descending length and
returns k rows a query at most; the answers of all tasks are merged by query, in two steps of bounded
lists.

The rotation only has to be orthogonal, so a bounded sample of ``rotation_sample`` vectors serves it;
the results do not depend on it.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as
queries or candidates. Equal scores go to the smaller id; repeated rows with one id are one candidate
each and a query is never its own candidate, by id. Fewer than k candidates give fewer rows. A table
without queries or candidates gives an empty table. Other columns are not read. Vectors of another
width than most of the table's have (the least of the commonest) take no part, either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import checkpointed, shared_folder, stored_at


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)``: components as floor(scale * x), of vectors that are whole and finite."""
    whole = F.size(vector_col) > 0
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).where(F.col("id").isNotNull() & F.col(vector_col).isNotNull()).where(whole & finite)
    return source.select("id", F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    lengths = np.diff(np.asarray(column.offsets)) if n else np.zeros(0)
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in width")
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(lengths[0]) if n else 0)
    if n and np.square(out).sum(axis=1).max() >= 2.0**52:
        raise ValueError("components are too large for exact products")
    return out


class Search:
    """A block of queries with their best candidates so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, head: int, k: int):
        self.ids, self.queries, self.rotation, self.head, self.k = ids, queries, rotation, head, k
        self.length = np.sqrt(np.square(queries).sum(axis=1))
        rotated = queries @ rotation
        self.first = rotated[:, :head]
        self.rest = np.sqrt(np.maximum(np.square(queries).sum(axis=1) - np.square(self.first).sum(axis=1), 0))
        self.floor = np.full(len(ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (score, id), best first
        self.products = 0

    def seeded(self, floors: np.ndarray) -> Search:
        """From now on only scores of at least these matter."""
        self.floor = np.maximum(self.floor, floors)
        return self

    def least_square(self) -> int:
        """The least squared length of a vector that can matter to any query."""
        positive = self.floor > 0
        ratio = np.where(positive, self.floor / np.where(positive, np.maximum(self.length, 1e-300), 1.0), 0.0)
        return int(np.square(ratio.min()) * (1 - 1e-9)) if len(ratio) else 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Walk a chunk of candidates in descending length."""
        if not len(ids) or not len(self.ids):
            return
        square = np.square(vectors).sum(axis=1)
        order = np.argsort(-square, kind="stable")
        ids, vectors, length = ids[order], vectors[order], np.sqrt(square[order])
        first = vectors @ self.rotation[:, : self.head]
        rest = np.sqrt(np.maximum(np.square(length) - np.square(first).sum(axis=1), 0))
        begin, step = 0, 256
        live = np.arange(len(self.ids))
        while begin < len(ids) and len(live):
            # All that follow are shorter: a query whose bound fails here is done with this chunk.
            live = live[self.length[live] * length[begin] * (1 + 1e-9) + 1e-6 >= self.floor[live]]
            part = slice(begin, min(begin + step, len(ids)))
            bound = self.first[live] @ first[part].T + np.outer(self.rest[live], rest[part])
            hit = bound + 1e-9 * np.outer(self.length[live], length[part]) + 1e-6 >= self.floor[live][:, None]
            q, c = np.nonzero(hit)
            if len(q):
                self._score(live[q], begin + c, ids, vectors)
            begin, step = part.stop, min(step * 2, 4096)

    def _score(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(q), 1 << 17):
            qa, ca = q[a : a + (1 << 17)], c[a : a + (1 << 17)]
            score = np.einsum("ij,ij->i", self.queries[qa], vectors[ca])
            self.products += len(qa)
            fit = (score >= self.floor[qa]) & (ids[ca] != self.ids[qa])
            qa, found, score = qa[fit], ids[ca[fit]], score[fit].astype(np.int64)
            order = np.lexsort((found, -score, qa))
            qa, found, score = qa[order], found[order], score[order]
            if not len(qa):
                continue
            begin = np.flatnonzero(np.concatenate([[True], qa[1:] != qa[:-1]]))
            for b, e in zip(begin, [*begin[1:], len(qa)], strict=True):
                e = min(e, b + self.k)
                i = int(qa[b])
                merged = sorted([*self.best[i], *zip(score[b:e].tolist(), found[b:e].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[: self.k]
                self.best[i] = merged
                if len(merged) == self.k:
                    self.floor[i] = max(self.floor[i], merged[-1][0])


def rotation_of(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of a sample as columns, the largest first."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, ::-1]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    head: int = 16, query_block: int = 16384, seeds: int = 4096, rotation_sample: int = 4096, chunk: int = 16384,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates of ``vectors`` of largest inner product with each row of ``queries``."""
    spark = vectors.sparkSession
    base, asked = quantised(vectors, id_col, vector_col, scale), quantised(queries, id_col, vector_col, scale)
    width = base.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    base, asked = (x.where(F.size("v") == width.width).withColumn("square", square) for x in (base, asked))
    longest = base.orderBy(F.desc("square"), "id").limit(seeds).select("id", "v").toArrow()
    sample = _matrix(base.limit(rotation_sample).toArrow().column("v"))
    schema = "query_id long, vec_id long, score long"
    rotation = rotation_of(sample)
    head = min(head, rotation.shape[1])
    seed_ids, seed_vectors = longest.column("id").to_numpy(), _matrix(longest.column("v"))

    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    several = n > query_block
    if several:  # each block scans the table, so it pays to write it in order once
        ordered = base.repartitionByRange(F.desc("square")).sortWithinPartitions(F.desc("square"))
        base = stored_at(ordered, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")

    def answers(block: pa.Table) -> DataFrame:
        ids, matrix = block.column("id").to_numpy(), _matrix(block.column("v"))
        seeded = Search(ids, matrix, rotation, head, k)
        seeded.add(seed_ids, seed_vectors)
        shared = spark.sparkContext.broadcast((ids, matrix, rotation, seeded.floor))
        reached = base.where(F.col("square") >= seeded.least_square()).select("id", "v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, rotation, floors = shared.value
            search = Search(ids, matrix, rotation, head, k).seeded(floors)
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(len(b) for b in held) >= chunk:
                    _add(search, held)
                    held = []
            _add(search, held)
            rows = [(int(q), i, s) for q, best in zip(ids, search.best, strict=True) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        out = reached.mapInArrow(run, schema)
        if several:
            out = checkpointed(out)
            shared.unpersist()
        return out

    found = None
    for block in _query_blocks(asked.select("id", "v"), n, query_block):
        more = answers(block)
        found = more if found is None else found.union(more)

    def first(hits):
        return F.slice(F.array_sort(hits), 1, k)

    # Each task sends k rows a query at most; tasks are merged by number first, so that no list grows with all of them.
    hit = F.struct((-F.col("score")).alias("minus"), "vec_id")
    part = found.groupBy("query_id", (F.spark_partition_id() % 64).alias("part")).agg(first(F.collect_list(hit)).alias("best"))
    best = part.groupBy("query_id").agg(first(F.flatten(F.collect_list("best"))).alias("best"))
    best = best.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def _add(search: Search, held: list[pa.RecordBatch]) -> None:
    if held:
        rows = pa.Table.from_batches(held)
        search.add(rows.column("id").to_numpy(), _matrix(rows.column("v")))


def _query_blocks(asked: DataFrame, n: int, most: int) -> Iterator[pa.Table]:
    """The n queries in blocks of at most ``most`` rows, by ranges of their ids; one block is on the driver at a time."""
    parts = -(-n // (most // 2))
    edges = asked.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = sorted({int(e) for e in edges})
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        block = asked if low is None else asked.where(F.col("id") > low)
        block = (block if high is None else block.where(F.col("id") <= high)).distinct().toArrow()
        for a in range(0, len(block), most):
            yield block.slice(a, most)
