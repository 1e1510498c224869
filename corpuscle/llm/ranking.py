"""One ranking per query from several differently-scaled scores, by a rank-walk Markov chain.

The walk: from an item pick one score uniformly, then jump uniformly to one of the
items that score ranks strictly higher (stay, if there is none); with probability
``1 - damping`` jump to any item. Only ranks matter, so no score decides by its
range. The stationary mass is found by power iteration, where each score's step is
one suffix sum over its sorted order: an item of rank r hands mass/r to each item
above it. Items are ordered by stationary mass; ties go to the smaller chunk_id.

The walk is repeated where it is contradicted: the items that beat its first item in a
majority of the scores go ahead of all others, in the order of a walk among them alone,
and so on while there are any (each round has fewer items). An item that beats every
other one is in each of these rounds, so it comes first; ``beats_all`` checks the first
item against all others.

Queries of up to ``block`` items are solved whole, many per task. A larger query is
never gathered: its ranks and sums are taken by distributed prefix sums
(``corpuscle.llm.prefix``), with the same result; so are its further rounds.

Defined cases: null or NaN scores and ranks below 1 are missing, missing is worse
than any value and equal to missing; infinite scores compare as they are; repeated
rows of a chunk count once (best values); rows with a null query_id or chunk_id are
left out; a query of one chunk has rank 1 and no winner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.prefix import ranked, walk_large
from corpuscle.session import store

#: The share of the walk that follows the scores, and the steps of the power iteration.
DAMPING, STEPS = 0.85, 60

SCORES = ("rrf_score", "bm25_rank", "dense_rank")
ORDER_SCHEMA = "query_id string, chunk_id string, mass double, final_rank long, beats_all boolean"


def usable(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id, s0, s1, s2): each score with higher better and missing as null, one row per chunk."""
    rank = lambda c: F.when(F.col(c) >= 1, -F.col(c).cast("double"))
    score = F.when(~F.isnan("rrf_score"), F.col("rrf_score").cast("double"))
    own = results.select("query_id", "chunk_id", score.alias("s0"), rank("bm25_rank").alias("s1"), rank("dense_rank").alias("s2"))
    return own.filter(F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()).groupBy("query_id", "chunk_id").agg(*(F.max(c).alias(c) for c in ("s0", "s1", "s2")))


def walk(codes: np.ndarray, there: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """The stationary mass of many queries at once: ``codes`` (scores x queries x places, higher better), ``there`` marks the places in use.

    Sums run along each query's own row, so a query's mass doesn't depend on its neighbours.
    """
    queries, m = there.shape
    size = there.sum(axis=1, keepdims=True)
    place = np.broadcast_to(np.arange(m), (queries, m))
    plans = []
    for code in codes:
        order = np.argsort(-code, axis=1, kind="stable")
        ranked = np.take_along_axis(code, order, axis=1)
        new = np.ones((queries, m + 1), bool)
        new[:, 1:-1] = ranked[:, 1:] != ranked[:, :-1]
        # above: how many items are strictly better; after: where the strictly worse ones begin.
        above = np.maximum.accumulate(np.where(new[:, :-1], place, 0), axis=1)
        after = np.minimum.accumulate(np.where(new[:, 1:], place + 1, m)[:, ::-1], axis=1)[:, ::-1]
        plans.append((order, np.argsort(order, axis=1, kind="stable"), above == 0, 1.0 / np.maximum(above, 1), after))
    mass = there / np.maximum(size, 1)
    for _ in range(steps):
        gain = np.zeros((queries, m))
        for order, back, stays, share, after in plans:
            own = np.take_along_axis(mass, order, axis=1)
            below = np.zeros((queries, m + 1))
            below[:, :-1] = np.cumsum(np.where(stays, 0.0, own * share)[:, ::-1], axis=1)[:, ::-1]
            gain += np.take_along_axis(np.take_along_axis(below, after, axis=1) + np.where(stays, own, 0.0), back, axis=1)
        mass = there * ((1 - damping) / np.maximum(size, 1) + damping * gain / len(plans))
    return mass


def stationary(scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """The stationary mass of one query's ``scores`` (items x scores, higher better)."""
    return walk(np.ascontiguousarray(scores.T)[:, None, :], np.ones((1, len(scores)), bool), damping, steps)[0]


def rounds(codes: np.ndarray, there: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mass of the first walk, order of the places, whether the first one beats all others) of many queries at once."""
    need = len(codes) // 2 + 1
    row = np.arange(len(there))
    beaten_by = lambda top: (codes > codes[:, row, top][:, :, None]).sum(axis=0) >= need
    depth = np.where(there, 0, -1)
    first = mass = np.where(there, np.round(walk(codes, there, damping, steps), 12), -1.0)
    inside, open_ = there, np.ones(len(there), bool)
    while True:
        top = np.argmax(np.where(inside, mass, -2.0), axis=1)
        inside = inside & beaten_by(top) & open_[:, None]
        open_ = inside.any(axis=1)
        if not open_.any():
            break
        depth += inside
        own = np.flatnonzero(open_)
        again = np.full(mass.shape, -1.0)
        # Only the items of the round count: the others stand below all and hold no mass.
        again[own] = np.round(walk(np.where(inside[own], codes[:, own], -3.0), inside[own], damping, steps), 12)
        mass = np.where(inside, again, mass)
    order = np.lexsort((np.broadcast_to(np.arange(there.shape[1]), there.shape), -mass, -depth), axis=1)
    top = order[:, 0]
    beaten = ((codes[:, row, top][:, :, None] > codes).sum(axis=0) >= need) & there
    size = there.sum(axis=1)
    return first, order, (size > 1) & (beaten.sum(axis=1) == size - 1)


def _solver(damping: float, steps: int, most: int = 500_000):
    """Whole queries, those of like size side by side; ``most`` places at once."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            items, begin = lists.flatten(), np.cumsum(sizes) - sizes
            by_size = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(by_size):
                # As many queries as fit beside the largest of them.
                widths = sizes[by_size[at:]] * np.arange(1, len(by_size) - at + 1)
                take = max(1, int(np.searchsorted(widths, most, side="right")))
                yield _block(batch.column(0), items, by_size[at : at + take], sizes, begin, damping, steps)
                at += take

    return solve


def _block(names: pa.Array, items: pa.StructArray, own: np.ndarray, sizes: np.ndarray, begin: np.ndarray, damping: float, steps: int) -> pa.RecordBatch:
    size = sizes[own]
    query = np.repeat(np.arange(len(own)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows = items.take(pa.array(np.repeat(begin[own], size) + inner))
    # In each query by id, so that ties by place are ties by id.
    order = pc.sort_indices(pa.table({"q": pa.array(query), "id": rows.field("chunk_id")}), sort_keys=[("q", "ascending"), ("id", "ascending")])
    rows = rows.take(order)
    m = int(size.max())
    there = np.zeros((len(own), m), bool)
    there[query, inner] = True
    codes = np.full((len(SCORES), len(own), m), -2.0)
    for j in range(len(SCORES)):
        value = rows.field(f"s{j}")
        known = pc.is_valid(value).to_numpy(zero_copy_only=False)
        code = np.full(len(known), -1.0)
        code[known] = np.unique(value.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        codes[j, query, inner] = code
    mass, order, wins = rounds(codes, there, damping, steps)
    final = np.empty_like(order)
    np.put_along_axis(final, order, np.broadcast_to(np.arange(1, m + 1), order.shape), axis=1)
    flat = lambda x: pa.array(x[query, inner])
    return pa.RecordBatch.from_arrays([names.take(pa.array(own[query])), rows.field("chunk_id"), flat(mass), flat(final), flat((final == 1) & wins[:, None])], ["query_id", "chunk_id", "mass", "final_rank", "beats_all"])


def rank_walk(results: DataFrame, block: int = 50_000, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """The order of every query: (query_id, chunk_id, mass, final_rank, beats_all)."""
    return _ordered(usable(results), block, damping, steps)


def _ordered(own: DataFrame, block: int, damping: float, steps: int) -> DataFrame:
    large = own.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("query_id")
    any_large = bool(large.limit(1).collect())
    small = own.join(large, "query_id", "left_anti") if any_large else own
    packed = small.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "s0", "s1", "s2")).alias("items"))
    solved = packed.mapInArrow(_solver(damping, steps), ORDER_SCHEMA)
    return solved.unionByName(_large(own.join(large, "query_id", "left_semi"), block, damping, steps)) if any_large else solved


def _beats(a: str, b: str) -> Column:
    """The item of struct ``a`` is strictly better than that of ``b`` in a majority of the scores."""
    better = lambda k: F.when(F.col(f"{a}.{k}").isNull(), 0).when(F.col(f"{b}.{k}").isNull(), 1).otherwise((F.col(f"{a}.{k}") > F.col(f"{b}.{k}")).cast("int"))
    return better("s0") + better("s1") + better("s2") >= len(SCORES) // 2 + 1


def _large(own: DataFrame, block: int, damping: float, steps: int) -> DataFrame:
    """As ``_block`` for large queries; a further round among few items is solved whole again."""
    item = F.struct("chunk_id", "s0", "s1", "s2")
    walked = store(own.join(walk_large(own, damping, steps), ["query_id", "chunk_id"]).withColumn("mass", F.round("mass", 12)), "walk-order")
    top = lambda df, *order: df.groupBy("query_id").agg(F.min_by(item, F.struct(*order)).alias("top"))
    leads = top(walked, -F.col("mass"), F.col("chunk_id"))
    # One leader a query: a hot query's items meet it by a broadcast or by AQE's split of the other side.
    ahead = walked.withColumn("own", item).join(leads, "query_id").withColumn("ahead", _beats("own", "top"))
    ahead = store(ahead.select("query_id", "chunk_id", "s0", "s1", "s2", "mass", "ahead"), "walk-ahead")
    again = ahead.filter("ahead").select("query_id", "chunk_id", "s0", "s1", "s2")
    some = bool(again.limit(1).collect())
    before = ahead.groupBy("query_id").agg(F.sum(F.col("ahead").cast("long")).alias("_before"))
    rest = ranked(ahead.filter(~F.col("ahead")).select("query_id", "chunk_id", "mass")).join(before, "query_id").select("query_id", "chunk_id", "mass", (F.col("rank") + F.col("_before")).alias("final_rank"))
    if some:
        first = _ordered(again, block, damping, steps).select("query_id", "chunk_id", "final_rank").join(ahead.select("query_id", "chunk_id", "mass"), ["query_id", "chunk_id"])
        rest = rest.unionByName(first.select("query_id", "chunk_id", "mass", "final_rank"))
    final = store(rest, "walk-final")
    winner = own.join(final.filter("final_rank = 1").select("query_id", "chunk_id"), ["query_id", "chunk_id"]).select("query_id", item.alias("top"))
    met = own.withColumn("own", item).join(winner, "query_id").filter(F.col("own.chunk_id") != F.col("top.chunk_id"))
    wins = met.groupBy("query_id").agg(F.min(_beats("top", "own").cast("int")).alias("_wins"))
    return final.join(wins, "query_id", "left").select("query_id", "chunk_id", "mass", "final_rank", ((F.col("final_rank") == 1) & (F.coalesce("_wins", F.lit(0)) == 1)).alias("beats_all"))


def first_by_majority(results: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the items that rank first and beat every other item in a majority of scores."""
    return rank_walk(results).filter((F.col("final_rank") == 1) & F.col("beats_all")).select("query_id", "chunk_id")
