"""Most similar vectors for every vector, by multi-index hashing.

Each vector gets a binary code: the signs of learned rotations (iterative
quantization, fitted on a bounded sample; every vector is indexed). Part of the code
is cut into substrings, each the key of one index. By the pigeonhole principle two
codes at a Hamming distance of at most ``tables * (radius + 1) - 1`` agree in some
substring up to ``radius`` bits, so probing all keys within ``radius`` of a query's
substrings meets every such code. What meets in a bucket is tested by the Hamming
distance of the rest of the code; the floats of the survivors are reranked, in
double precision, where they lie; only the best of a bucket leave it.

``plan`` chooses tables, substring length and radius by the number of vectors: of all
settings under which a pair at the least cosine meets with a probability of
``RECALL`` or more, the one of least cost, a shuffled row being dearer than a test of
two codes. So recall doesn't fall as the collection grows. (In a join each probe is a
row that is shuffled, so more tables are mostly cheaper than a larger radius.) A
bucket of more than ``block`` vectors is a grid of blocks of queries and blocks of
indexed rows, spread over tasks; nothing is cut off.
Equal vectors are one class and expanded at the end, so a vector that a third of
the chunks share is compared once.

Defined cases: null embeddings, embeddings of another length, with null, NaN or
infinite numbers or all zero take no part; repeated rows count once, and of
different vectors under one chunk_id the one of the smallest hash counts; rows with
a null chunk_id are left out; cosines are rounded to six decimals, ties go to the
smaller id; a chunk without a partner has no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import store

#: Numbers of an embedding, neighbours, least cosine.
DIMENSIONS, K, LEAST = 64, 5, 0.85
#: The probability that a pair at the least cosine meets, cost of a shuffled row and of a test of two codes, largest radius and substring length.
RECALL, ROW, TEST, MOST_RADIUS, LONGEST = 0.96, 20.0, 0.004, 2, 30
#: Bits of the code that are tested inside buckets, and the standard deviations above the distance expected at the least cosine that are allowed.
TESTED, DEVIATIONS = 128, 3.0
#: The largest block of a bucket compared at once, and the survivors reranked at once.
BLOCK, PAIRS = 4096, 100_000
#: Vectors that the rotations are fitted on, and the rounds of the fit.
SAMPLE, ROUNDS = 20_000, 30


def matrix(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a usable vector, their vectors as float32)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    kept = column.take(pa.array(rows))
    flat = kept.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dimensions)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return rows[good], values[good]


def bit_error(cosine: float) -> float:
    """The probability that a bit differs between two vectors of this cosine."""
    return float(np.arccos(cosine) / np.pi)


def plan(count: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int, int]:
    """(tables, width, radius) for ``count`` vectors."""
    p, best = bit_error(least), None
    for radius in range(MOST_RADIUS + 1):
        for width in range(max(4, radius + 1), LONGEST + 1):
            meets = sum(comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(radius + 1))
            tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meets))))
            probes = sum(comb(width, i) for i in range(radius + 1))
            cost = tables * probes * (ROW + TEST * count / 2**width)
            if best is None or cost < best[0]:
                best = (cost, tables, width, radius)
    return best[1:]


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The signs of the rotated vectors, packed into 64-bit words (vectors x words)."""
    return np.packbits(vectors @ rotations >= 0, axis=1).view(np.uint64)


def fit_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Directions (dimensions x bits): iterative quantization from as many random starts as the bits need."""
    random = np.random.default_rng(seed)
    d = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else np.eye(d)
    out = []
    for _ in range(-(-bits // d)):
        rotation = np.linalg.qr(random.normal(size=(d, d)))[0]
        for _ in range(rounds):
            signs = np.where(unit @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(unit.T @ signs)
            rotation = u @ v
        out.append(rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def substrings(vectors: np.ndarray, rotations: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The keys (vectors x tables) of the vectors' codes."""
    bits = (vectors.astype(np.float64) @ rotations >= 0).reshape(len(vectors), tables, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = matrix(batch.column(1))
        data = np.ascontiguousarray(values + np.float32(0))  # -0 becomes 0
        raw = [r.tobytes() for r in data]
        h1 = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw)).view(np.int64)
        h2 = np.fromiter((xxhash.xxh64_intdigest(r, 1) for r in raw), np.uint64, len(raw)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(h1), pa.array(h2), pa.array(raw, pa.binary())], ["chunk_id", "h1", "h2", "v"])


def _best(groups: list[tuple[np.ndarray, ...]], k: int, least: float, allowed: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each query of one bucket block: (rid, unit vectors, codes, is query, is indexed)."""
    for rid, unit, code, asks, held in groups:
        query, index = np.flatnonzero(asks), np.flatnonzero(held)
        if not len(query) or not len(index):
            continue
        index = index[np.argsort(rid[index], kind="stable")]
        words = np.ascontiguousarray(code[index].T)
        for at in range(0, len(query), 64):
            own = query[at : at + 64]
            distance = np.bitwise_count(code[own, :1] ^ words[0])
            for word in range(1, len(words)):
                distance += np.bitwise_count(code[own, word : word + 1] ^ words[word])
            # Floats of the survivors only; columns lie in the order of ids.
            q, c = np.divmod(np.flatnonzero(distance.ravel() <= allowed), len(index))
            differ = rid[own[q]] != rid[index[c]]
            q, c = q[differ], c[differ]
            value = np.concatenate([np.einsum("ij,ij->i", unit[own[q[i : i + PAIRS]]], unit[index[c[i : i + PAIRS]]]) for i in range(0, len(q), PAIRS)]) if len(q) else np.zeros(0)
            value = np.round(value, 6)
            near = value >= least
            q, c, value = q[near], c[near], value[near]
            rank = np.lexsort((c, -value, q))
            q, c, value = q[rank], c[rank], value[rank]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([pa.array(rid[own][q[keep]]), pa.array(rid[index][c[keep]]), pa.array(value[keep])], ["q", "c", "cosine"])


def _buckets(k: int, least: float, dimensions: int, tested: np.ndarray, allowed: int):
    """Buckets lie one after another; one may go over the border of batches."""

    def run(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        label, rid, unit, code, asks, held = (np.concatenate(x) for x in zip(*parts))
        cuts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        ends = np.append(cuts[1:], len(label))
        yield from _best([(rid[a:b], unit[a:b], code[a:b], asks[a:b], held[a:b]) for a, b in zip(cuts, ends) if b - a > 1], k, least, allowed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dimensions).astype(np.float64)
            unit = values / np.linalg.norm(values, axis=1, keepdims=True)
            row = (label, batch.column(1).to_numpy(zero_copy_only=False), unit, codes(unit, tested), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False))
            last = int(np.searchsorted(np.cumsum(label[::-1] != label[-1]) > 0, True))
            cut = len(label) - last
            if cut:
                yield from run([*waiting, tuple(c[:cut] for c in row)])
                waiting = [tuple(c[cut:] for c in row)]
            elif waiting and waiting[-1][0][-1] != label[0]:
                yield from run(waiting)
                waiting = [row]
            else:
                waiting.append(row)
        if waiting:
            yield from run(waiting)

    return work


def nearest_classes(classes: DataFrame, count: int, k: int = K, least: float = LEAST, tables: int | None = None, width: int | None = None, radius: int | None = None, block: int = BLOCK, dimensions: int = DIMENSIONS) -> DataFrame:
    """(q, c, cosine): up to ``k`` neighbours of every different vector of ``classes`` (rid, v), a stored table planned for ``count`` rows."""
    planned = plan(count, least)
    tables, width, radius = (own if given is None else given for given, own in zip((tables, width, radius), planned))
    drawn = classes.select("v").orderBy(F.xxhash64("rid")).limit(SAMPLE) if count > SAMPLE else classes.select("v").limit(SAMPLE)
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in drawn.toLocalIterator()), np.float32).reshape(-1, dimensions).astype(np.float64)
    learned = fit_rotations(sample, TESTED + tables * width)
    tested, rotations = np.ascontiguousarray(learned[:, :TESTED]), np.ascontiguousarray(learned[:, TESTED:])
    error = bit_error(least)
    allowed = int(TESTED * error + DEVIATIONS * np.sqrt(TESTED * error * (1 - error)))
    flips = np.array([0, *(sum(1 << i for i in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r))], dtype=np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dimensions)
            keys = substrings(values, rotations, tables, width)
            keys = (keys[:, :, None] ^ flips) + (np.arange(tables, dtype=np.int64) << width)[None, :, None]
            rows = np.repeat(np.arange(len(values)), tables * len(flips))
            home = np.tile(np.arange(len(flips)) == 0, len(values) * tables)
            label = keys.reshape(-1)
            for at in range(0, len(rows), 50_000):
                part = pa.array(rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(label[at : at + 50_000]), batch.column(0).take(part), batch.column(1).take(part), pa.array(home[at : at + 50_000])], ["bucket", "rid", "v", "home"])

    rows = classes.select("rid", "v").mapInArrow(coded, "bucket bigint, rid bigint, v binary, home boolean")
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    if large.limit(1).collect():
        # A large bucket is a grid: a row asks in the cells of its query block and is held in those of its index block.
        parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
        spread = rows.join(large, "bucket", "left").withColumn("parts", parts).withColumn("own", own)
        cells = F.explode(F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("own").alias("x"), i.alias("y"))), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("x"), F.col("own").alias("y")))))))
        grid = spread.withColumn("cell", cells)
        asks = (F.col("parts") == 1) | (F.col("cell.x") == F.col("own"))
        held = F.col("home") & ((F.col("parts") == 1) | (F.col("cell.y") == F.col("own")))
        rows = grid.select(F.xxhash64("bucket", "cell.x", "cell.y").alias("label"), "rid", "v", asks.alias("asks"), held.alias("held"))
    else:
        rows = rows.select(F.col("bucket").alias("label"), "rid", "v", F.lit(True).alias("asks"), F.col("home").alias("held"))
    met = rows.repartition("label").sortWithinPartitions("label").mapInArrow(_buckets(k, least, dimensions, tested, allowed), "q bigint, c bigint, cosine double")
    best = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "c")
    return met.repartition("q").dropDuplicates(["q", "c"]).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def neighbours(vectors: DataFrame, k: int = K, least: float = LEAST, count: int | None = None, **index) -> DataFrame:
    """(chunk_id, neighbour_id, cosine) of ``vectors`` (chunk_id, embedding), planned for their number or for ``count`` of them."""
    own = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding").filter("chunk_id is not null and embedding is not null")
    rows = store(own.mapInArrow(_vectors, "chunk_id string, h1 bigint, h2 bigint, v binary"), "vectors")
    pick = rows.groupBy("chunk_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("chunk_id", "h.h1", "h.h2")
    once = Window.partitionBy("h1", "h2").orderBy("chunk_id")
    # In the order of their smallest chunk_id, so that ties by rid are ties by id.
    classes = store(rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1").orderBy("chunk_id").select(F.monotonically_increasing_id().alias("rid"), "h1", "h2", "v"), "vector-classes")
    members = pick.join(classes.select("h1", "h2", "rid"), ["h1", "h2"]).select("rid", "chunk_id")
    near = nearest_classes(classes, count or classes.count(), k, least, **index)
    smallest = members.withColumn("_n", F.row_number().over(Window.partitionBy("rid").orderBy("chunk_id"))).filter(F.col("_n") <= k + 1).drop("_n")
    others = near.join(smallest.select(F.col("rid").alias("c"), F.col("chunk_id").alias("id")), "c").select(F.col("q").alias("rid"), "id", "cosine")
    mine = smallest.select("rid", F.col("chunk_id").alias("id"), F.lit(1.0).alias("cosine"))
    listed = others.unionByName(mine).groupBy("rid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "id"))), 1, k + 1).alias("list"))
    each = members.join(listed, "rid").select("chunk_id", F.explode(F.slice(F.filter("list", lambda x: x["id"] != F.col("chunk_id")), 1, k)).alias("n"))
    return each.select("chunk_id", F.col("n.id").alias("neighbour_id"), (-F.col("n.minus")).alias("cosine"))
