"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vector components are terms.  For each term the query rows that hold it scatter their weight
times the term's postings (the candidates that hold it) into a dense score array; each chunk of
candidates is cut to its best by partition selection and merged into what its cell has so far,
and a last merge over the cells ranks them.

Queries and candidates are dealt to a grid: a cell has a block of at most about ``QUERY_BLOCK``
queries and one of about ``CANDIDATE_BLOCK`` candidates, and each block is sent to the cells of its
row or column by one shuffle.  Nothing is collected or broadcast, and a task holds one block of
queries and one chunk of candidates.

Scores are exact whole numbers.  Rows whose components are small enough for 64-bit sums are
multiplied in numpy, all others by unbounded integers, so that one odd row neither stops the search
nor rounds it.

Defined results: vectors that are null, or hold a null, NaN or infinite component take no part;
a vector shorter than another counts as zero beyond its end; a query's candidates are the rows of
any other ``vec_id`` (a null ``vec_id`` is no candidate); repeated rows are candidates each; equal
scores rank by the smaller ``vec_id``; rows of one query id that repeat are searched each; a score
that does not fit a long ranks by its exact value and is returned as the nearest long; an empty
table gives an empty result.  Vectors of any length are read whole.  Of the table only ``vec_id``
and ``embedding`` are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.common import SharedTables, tune

QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 16_384
CANDIDATE_CHUNK = 512
LEAST_BLOCK = 1_024  # candidates for which a further cell is worth its task
SCALE = 256
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)

_PART = "query_no long, query_id long, vec_id long, score long, beyond string"
_DIGITS = str.maketrans("0123456789", "9876543210")


def sound(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` of the rows that take part."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    return chosen.where(F.coalesce(good, F.lit(False)))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)


class Rows:
    """A run of vectors: those whose sums fit 64 bits as a matrix, and the others as lists of integers."""

    def __init__(self, part: pa.RecordBatch, scale: int):
        column = part.column("embedding")
        lengths = np.diff(column.offsets.to_numpy())
        self.number, self.ids = (part.column(c).to_numpy() for c in ("no", "vec_id"))
        values = np.zeros((len(column), int(lengths.max(initial=0))))
        values[np.arange(values.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            terms = np.floor(values * scale)
        limit = math.isqrt(LONG_MAX // max(values.shape[1], 1))  # then no sum of products leaves 64 bits
        small = np.abs(terms).max(axis=1, initial=0) <= min(limit, 1 << 52)
        self.plain, self.wide = np.flatnonzero(small), np.flatnonzero(~small)
        self.terms = terms[self.plain].astype(np.int64)
        self.lists = [[whole(x, scale) for x in values[i, : lengths[i]].tolist()] for i in self.wide]


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores of all queries against a chunk of rows, one term after another."""
    width = min(queries.shape[1], rows.shape[1])
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(width, 1)
    kind = np.int32 if bound < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(rows)), kind)
    part = np.empty_like(scores)
    for term in range(width):
        weight, posting = queries[:, term].astype(kind), rows[:, term].astype(kind)
        holds, posted = np.flatnonzero(weight), np.flatnonzero(posting)
        if 4 * len(holds) * len(posted) > scores.size:  # most pairs: the zeros add nothing
            np.multiply(weight[:, None], posting[None, :], out=part)
            scores += part
        elif len(holds) and len(posted):
            scores[np.ix_(holds, posted)] += weight[holds, None] * posting[None, posted]
    return scores


def best_of(scores: np.ndarray, own: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best columns: scores, ids, and whether the column may count at all.

    Columns come by rising id, so a key of score and falling position makes every key of a row
    distinct and partition selection exact under ties.
    """
    n = len(own)
    k = min(k, n)
    if int(np.abs(scores).max(initial=0)) < (1 << 62) // max(n, 1):
        keys = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        keys[barred] = np.iinfo(np.int64).min
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    else:
        at = np.lexsort((np.broadcast_to(own, scores.shape), ~scores, barred), axis=1)[:, :k]
    return np.take_along_axis(scores, at, 1).astype(np.int64), own[at], ~np.take_along_axis(barred, at, 1)


def exact(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))


class Cell:
    """The queries of a cell and the best of the candidates that it has seen."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, scale: int):
        rows = Rows(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], scale)
        self.k, self.scale = k, scale
        self.number, self.ids, self.plain, self.queries = rows.number, rows.ids, rows.plain, rows.terms
        self.wide = dict(zip(rows.wide.tolist(), rows.lists))
        n = len(rows.plain)
        self.best = (np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), bool))
        self.heaps: dict[int, list[tuple[int, int]]] = {}  # by query: (score, -vec_id) of pairs beyond 64 bits

    def add(self, part: pa.RecordBatch) -> None:
        for at in range(0, part.num_rows, CANDIDATE_CHUNK):
            rows = Rows(part.slice(at, CANDIDATE_CHUNK), self.scale)
            own = rows.ids[rows.plain]
            order = np.argsort(own, kind="stable")
            own, terms = own[order], rows.terms[order]
            if len(own) and len(self.plain):
                found = best_of(accumulate(self.queries, terms), own, self.ids[self.plain][:, None] == own[None, :], self.k)
                best = tuple(np.concatenate(x, axis=1) for x in zip(self.best, found))
                kept = np.lexsort((best[1], ~best[0], ~best[2]), axis=1)[:, : self.k]
                self.best = tuple(np.take_along_axis(x, kept, axis=1) for x in best)
            for i, query in self.wide.items():
                for vec, row in zip(own.tolist(), terms.tolist()):
                    self.push(i, exact(query, row), vec)
            for j, row in zip(rows.wide.tolist(), rows.lists):
                for i, query in zip(self.plain.tolist(), self.queries):
                    self.push(i, exact(query.tolist(), row), int(rows.ids[j]))
                for i, query in self.wide.items():
                    self.push(i, exact(query, row), int(rows.ids[j]))

    def push(self, query: int, score: int, vec: int) -> None:
        if vec == self.ids[query]:
            return
        heap = self.heaps.setdefault(query, [])
        (heapq.heappush if len(heap) < self.k else heapq.heappushpop)(heap, (score, -vec))

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, j = np.nonzero(self.best[2])
        for at in range(0, len(q), 65_536):
            a, b = q[at : at + 65_536], j[at : at + 65_536]
            own = self.plain[a]
            yield _found(self.number[own], self.ids[own], self.best[1][a, b], self.best[0][a, b], [""] * len(a))
        found = [(int(self.number[i]), int(self.ids[i]), -vec, max(LONG_MIN, min(LONG_MAX, s)), beyond(s)) for i, heap in self.heaps.items() for s, vec in heap]
        if found:
            yield _found(*zip(*found))


def _found(*columns) -> pa.RecordBatch:
    types = (pa.int64(),) * 4 + (pa.string(),)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _PART.split(", ")])


def beyond(score: int) -> str:
    """Text that sorts like the scores outside a long, on their side; empty for all others."""
    if LONG_MIN <= score <= LONG_MAX:
        return ""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return text if score > 0 else text.translate(_DIGITS)


def searcher(k: int, scale: int):
    """Arrow map over rows sorted by (q, c, side): a cell's queries come before its candidates."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked, cell = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("q", "c", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (keys[0, a], keys[1, a]) != place:
                    if cell:
                        yield from cell.rows()
                    place, asked, cell = (keys[0, a], keys[1, a]), [], None
                if keys[2, a] == 0:
                    asked.append(batch.slice(a, b - a))
                elif asked or cell:
                    if cell is None:
                        cell, asked = Cell(asked, k, scale), []
                    cell.add(batch.slice(a, b - a))
        if cell:
            yield from cell.rows()

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """The ``k`` best candidates of each row whose ``vec_id`` is divisible by ``every``."""
    spark = tune(vectors.sparkSession)
    shared = SharedTables(spark, "topk")
    # the numbers of rows come from the written table, so a task that runs again sees the same ones
    rows = shared.write(sound(vectors).withColumn("no", F.monotonically_increasing_id()), "vectors")
    asked = F.col("vec_id") % every == 0
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries")).first()
    across = max(1, -(-sizes["queries"] // QUERY_BLOCK))
    cores = spark.sparkContext.defaultParallelism
    down = max(1, -(-sizes["rows"] // CANDIDATE_BLOCK), min(-(-cores // across), sizes["rows"] // LEAST_BLOCK))
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "no"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["no", "vec_id", "embedding"]
    queries = rows.where(asked).select(block(1, across).alias("q"), every_block(down).alias("c"), F.lit(0).alias("side"), *own)
    candidates = rows.select(every_block(across).alias("q"), block(2, down).alias("c"), F.lit(1).alias("side"), *own)
    cells = queries.unionByName(candidates).repartition(max(across * down, 1), "q", "c").sortWithinPartitions("q", "c", "side")
    found = cells.mapInArrow(searcher(k, scale), _PART)
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
