"""Exact top-k search over integer vectors by MaxScore.

The terms of a query are the dimensions, and the postings of a term are the candidates' values in that dimension,
stored one term after the other in shards of bounded size. Within a shard, a term can add at most the larger of
weight * least value and weight * greatest value. Terms in ascending order of the width of that range are
non-essential as long as all of them together cannot lift a candidate to the k-th best score so far. The postings of
the essential terms are traversed for all candidates; those that could still reach the k-th score are probed in the
other terms, widest first, and dropped as soon as they cannot.

Search starts with a level: the k-th best score of a query among the other queries of its block, which are candidates,
too. Queries with similar numbers of essential terms are scored together, in the terms essential for any of them.

The stated query set against all rows is a grid: a cell has a group of queries and a part of the rows. Its task holds
the group in blocks of bounded size and reads the part shard by shard, so levels rise from shard to shard and a query
leaves at most k rows a part; these are merged by a top-k over all parts. Each vector is a row of its own on the way to
its cells, in the narrowest type that holds all numbers. Nothing is broadcast.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as continued with
zeros. Rows with the same id are candidates each for itself, but none is a candidate of a query with its id; a query
row that occurs twice is answered twice. Fewer than k candidates: all of them. Sums must fit 64 bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.plans.session import materialize

_PROBED_AT_ONCE = 4
_SCORED_TOGETHER = 64
_NUMBERS_HELD = 2 ** 21
_CELL_PAIRS = 2 ** 31
_FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vector_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component of the vectors that are whole."""
    whole = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(whole).select(
        F.col(vector_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("terms"))


def _matrix(rows, width: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def first_levels(queries: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the others of its block, -inf where there are fewer."""
    level = np.full(len(queries), -np.inf)
    if len(queries) > k:
        for i in range(0, len(queries), _SCORED_TOGETHER):
            scores = (queries[i:i + _SCORED_TOGETHER] @ queries.T).astype(float)
            scores[query_ids[i:i + _SCORED_TOGETHER, None] == query_ids] = -np.inf
            level[i:i + _SCORED_TOGETHER] = np.partition(scores, len(queries) - k, axis=1)[:, len(queries) - k]
    return level


def _traverse(queries: np.ndarray, essential: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Scores of all candidates in the essential terms of each query."""
    partial = np.empty((len(queries), part.shape[1]), queries.dtype)
    by_terms = np.argsort(essential.sum(axis=1), kind="stable")
    for at in range(0, len(queries), _SCORED_TOGETHER):
        some = by_terms[at:at + _SCORED_TOGETHER]
        terms = essential[some].any(axis=0)
        weights = np.where(essential[some], queries[some], 0)
        partial[some] = weights @ part if terms.all() else weights[:, terms] @ part[terms]
    return partial


def _probe(queries: np.ndarray, partial: np.ndarray, part: np.ndarray, order: np.ndarray, adds: np.ndarray, waiting: np.ndarray, level: np.ndarray):
    """Query, candidate and score of the pairs that reach the query's level: the terms that wait are looked up, the widest
    first, for pairs that could still reach it. ``partial`` is the score in the others, ``adds`` the most of the first terms
    of ``order``. Ordered by query."""
    level = level.astype(partial.dtype) if partial.dtype.kind == "f" else level
    row = np.arange(len(queries))
    who, near = np.divmod(np.flatnonzero(partial + adds[row, waiting][:, None] >= level[:, None]), partial.shape[1])
    score = partial[who, near]
    left = waiting.copy()
    while len(who) and left.any():
        for _ in range(_PROBED_AT_ONCE):
            if not left.any():
                break
            term = order[row, left - 1]
            weight = np.where(left > 0, queries[row, term], 0)
            score = score + weight[who] * part[term[who], near]
            left = np.maximum(left - 1, 0)
        keep = score + adds[row, left][who] >= level[who]
        who, near, score = who[keep], near[keep], score[keep]
    return who, near, score


def search_shard(queries: np.ndarray, query_ids: np.ndarray, postings: np.ndarray, ids: np.ndarray, k: int, strip: int = 4096, room: float = 0.1,
                 level: np.ndarray | None = None, found_ids: list | None = None, found: list | None = None):
    """For each query row the ids and scores of the candidates of one shard that can be among its best k, at most k.
    ``postings`` has a row for each term; ``strip`` candidates are searched at a time, then the levels rise. Non-essential
    terms fill the part ``room`` of what they could without reaching the level: less leaves fewer candidates to probe.
    ``level``, ``found_ids`` and ``found`` of the shards before are carried on in place."""
    low, high = postings.min(axis=1), postings.max(axis=1)
    least, most = np.minimum(queries * low, queries * high), np.maximum(queries * low, queries * high)
    order = np.argsort(most - least, axis=1, kind="stable")
    # what the narrowest j terms can add to what they give at least, and to nothing
    spread = np.cumsum(np.take_along_axis(most - least, order, 1), axis=1)
    adds = np.zeros((len(queries), queries.shape[1] + 1), queries.dtype)
    np.cumsum(np.take_along_axis(most, order, 1), axis=1, out=adds[:, 1:])
    found_ids = [np.zeros(0, ids.dtype)] * len(queries) if found_ids is None else found_ids
    found = [np.zeros(0, np.int64)] * len(queries) if found is None else found
    level = first_levels(queries, query_ids, k) if level is None else level
    for start in range(0, postings.shape[1], strip):
        part, part_ids = postings[:, start:start + strip], ids[start:start + strip]
        can_wait = spread < room * (level - least.sum(axis=1))[:, None]
        essential = np.ones(queries.shape, bool)
        np.put_along_axis(essential, order, ~can_wait, 1)
        partial, waiting = _traverse(queries, essential, part), can_wait.sum(axis=1)
        for at in range(0, len(queries), _SCORED_TOGETHER):
            some = slice(at, at + _SCORED_TOGETHER)
            who, near, score = _probe(queries[some], partial[some], part, order[some], adds[some], waiting[some], level[some])
            other = part_ids[near] != query_ids[some][who]
            who, near, score = who[other], near[other], score[other].astype(np.int64)
            cuts = np.searchsorted(who, np.arange(len(queries[some]) + 1))
            for i in np.flatnonzero(np.diff(cuts)):
                new, q = slice(cuts[i], cuts[i + 1]), at + i
                both = np.concatenate([found[q], score[new]])
                both_ids = np.concatenate([found_ids[q], part_ids[near[new]]])
                best = _best(both, both_ids, k)
                found[q], found_ids[q] = both[best], both_ids[best]
                if len(best) == k:
                    level[q] = max(level[q], found[q][-1])
    return found_ids, found


def _widest(postings: np.ndarray) -> np.ndarray:
    """The greatest amount in each term."""
    return np.maximum(postings.max(axis=1).astype(float), -postings.min(axis=1).astype(float))


class _Block:
    """Queries that are searched together, and the best rows so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, terms: list, k: int):
        self.rows, self.ids, self.k = rows, ids, k
        self.queries = _matrix(terms, max(map(len, terms)), terms[0].dtype)
        self.widest = _widest(self.queries.T)
        self.level, self.found_ids, self.found = None, [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)

    def _kind(self, widest: np.ndarray):
        # floats count exactly below 2^24 and 2^53; beyond, integers do
        width = min(len(self.widest), len(widest))
        reach = float((self.widest[:width] * widest[:width]).sum()) * 2
        return np.float32 if reach < 2 ** 24 else np.float64 if reach < 2 ** 53 else np.int64

    def search(self, postings: np.ndarray, widest: np.ndarray, ids: np.ndarray, strip: int) -> None:
        if self.level is None:
            self.level = first_levels(self.queries.astype(self._kind(self.widest)), self.ids, self.k)
        # what one side lacks counts as zeros
        kind, width = self._kind(widest), min(self.queries.shape[1], len(postings))
        search_shard(self.queries[:, :width].astype(kind), self.ids, postings[:width].astype(kind), ids, self.k, strip,
                     level=self.level, found_ids=self.found_ids, found=self.found)

    def best(self) -> pd.DataFrame:
        sizes = [len(g) for g in self.found]
        return pd.DataFrame({
            "query_row": np.repeat(self.rows, sizes), "query_id": np.repeat(self.ids, sizes),
            "vec_id": np.concatenate(self.found_ids), "score": np.concatenate(self.found)})


def _search_cells(k: int, strip: int, shard_rows: int, block_rows: int):
    def cut(pieces, size: int):
        """Row numbers, ids and vectors of ``size`` rows at a time."""
        rows, ids, terms = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for _, piece in pieces:
            rows, ids = np.concatenate([rows, piece["row"]]), np.concatenate([ids, piece["vec_id"]])
            terms.extend(piece["terms"])
            while len(ids) >= size:
                yield rows[:size], ids[:size], terms[:size]
                rows, ids, terms = rows[size:], ids[size:], terms[size:]
        if len(ids):
            yield rows, ids, terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # sorted: a cell's queries come before its candidates
        pieces = (piece for batch in batches for piece in batch.groupby(["cell", "candidate"], sort=False))
        asked: tuple[int | None, list[_Block]] = None, []
        for (cell, candidate), run_of in itertools.groupby(pieces, key=lambda piece: piece[0]):
            if not candidate:
                asked = cell, [_Block(*block, k) for block in cut(run_of, block_rows)]
            elif asked[0] == cell:
                for _, ids, terms in cut(run_of, shard_rows):
                    postings = np.ascontiguousarray(_matrix(terms, max(map(len, terms)), terms[0].dtype).T)
                    widest = _widest(postings)
                    for block in asked[1]:
                        block.search(postings, widest, ids, strip)
                yield from (block.best() for block in asked[1])
    return run


def grid(queries: int, rows: int, width: int, cores: int, k: int, shard_rows: int, block_rows: int) -> tuple[int, int]:
    """Groups of queries and parts of rows: some cells for each core, none of too many pairs, and little that travels.
    A query travels once for each part, with k rows found there; a row travels once for each group. A task can hold the
    numbers of a group."""
    most_groups, most_parts = max(1, -(-queries // block_rows)), max(1, -(-rows // shard_rows))
    cells = max(queries * rows / _CELL_PAIRS, 3 * cores)
    held = max(1, _NUMBERS_HELD // max(1, block_rows * width)) * block_rows
    groups = round(math.sqrt(cells * queries * (1 + k / 4) / max(1, rows)))
    groups = min(max(groups, -(-queries // held), 1), most_groups)
    parts = min(max(1, math.ceil(cells / groups)), most_parts)
    return min(max(groups, math.ceil(cells / parts)), most_groups), parts


def _extent(rows: DataFrame) -> tuple[int, int, str]:
    """Number of rows, length of the longest, and the narrowest type that holds their numbers."""
    n, width, low, high = rows.agg(F.count("*"), F.max(F.size("terms")), F.min(F.array_min("terms")), F.max(F.array_max("terms"))).first()
    bits = max((x if x >= 0 else -x - 1).bit_length() + 1 for x in (low or 0, high or 0))
    return n, width or 0, next(kind for most, kind in ((8, "tinyint"), (16, "smallint"), (32, "int"), (64, "bigint")) if bits <= most)


def top_k(table: DataFrame, is_query: Column, k: int = 20, vector_id: str = "vec_id", vector: str = "embedding",
          scale: int = 64, shard_rows: int = 8192, block_rows: int = 1024, strip: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row, over all other rows.
    ``is_query`` is a condition on vec_id. Rows without id are no queries, and candidates under the id -1."""
    rows = materialize(integer_vectors(table, vector_id, vector, scale), "vectors")
    asked = materialize(rows.where(is_query & F.col("vec_id").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "queries")
    count, width, kind = _extent(rows)
    cores = table.sparkSession.sparkContext.defaultParallelism
    groups, parts = grid(asked.count(), count, width, cores, k, shard_rows, block_rows)
    terms = F.col("terms").cast(f"array<{kind}>").alias("terms")
    group, part = F.pmod("row", F.lit(groups)), F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    queries = asked.select((group * parts).alias("at"), F.lit(False).alias("candidate"), "row", "vec_id", terms)
    candidates = rows.select(part.alias("at"), F.lit(True).alias("candidate"), F.lit(-1).cast("long").alias("row"),
                             F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), terms)
    dealt = [
        side.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
            (F.col("at") + F.col("step") * apart).cast("int").alias("cell"), "candidate", "row", "vec_id", "terms")
        for side, copies, apart in ((queries, parts, 1), (candidates, groups, parts))]
    cells = dealt[0].unionByName(dealt[1]).repartitionById(groups * parts, "cell").sortWithinPartitions("cell", "candidate")
    found = cells.mapInPandas(_search_cells(k, strip, shard_rows, block_rows), _FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
