"""Near-duplicate records by an exact multi-index Hamming join.

A record is the multiset of its words. Its signature has one bit per (word,
occurrence), at a 64-bit hash place, so the Hamming distance of two signatures is
the size of the symmetric difference of their multisets. A similarity (shared by
joined words) of at least ``SIMILARITY`` = 3/4 means a distance of at most
(a + b) / 7 for sizes a <= b, and b <= 4a/3.

The signature is split by place into chunks, and errors are enumerated on the index
side by clearing one bit of a chunk. Let a pair's smaller record have x bits the
larger one lacks, and the larger one y others. In a chunk with x_c and y_c of them,
the smaller record's chunk equals the larger one's if x_c + y_c = 0, and equals it
after one cleared bit if x_c = 0 and y_c = 1. So a chunk probed for equality fails at
a cost of 1 or more of 2x + y, one probed for one cleared bit at 2 or more
(generalised pigeonhole): probes worth more than the largest 2x + y that the
threshold allows for the record's size meet every partner. The record spends them
where they meet the fewest other records, by the frequencies of its words in the
whole collection, counted in a fixed number of hashed counters. A key is the sum of a
chunk's token hashes, so clearing a bit is a subtraction. No pair above the threshold
is lost, whatever the data and the counters; a parity sketch and an exact count drop
the rest.

Records with equal multisets are one class; only one row per class takes part in
the join. Sizes fall into groups with a chunk count each; a record takes part in
its own group, and as the larger one in those that hold records down to 3/4 of its size.

Defined cases: null texts and texts without words have no pairs; repeated
deliveries of an id count once; rows with a null id are left out; extra columns of
the records take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.runs import slices, words

#: The threshold as numerator and denominator: shared / joined >= 3/4.
SIMILARITY = (3, 4)
#: Largest sizes of the size groups, the largest ones that 1, 3, 7 and 15 chunks serve; beyond the last one the ratio goes on.
GROUPS = (5, 13, 33, 69)
RATIO = 2.05

#: Copies of one text that are compared in one task.
BLOCK = 5_000
#: Hashed counters of words (1 MB) and characters of text taken at once.
COUNTERS, SLICE = 1 << 18, 500_000

#: A token's lower 32 and upper 16 bits; ``h``: the lower bits of k1, by which classes are found.
BAGS = "id string, h bigint, k1 bigint, k2 bigint, size int, low array<int>, high array<smallint>"
#: ``facts`` packs, from the lowest bit: the size (at most ``MOST_SIZE``), a sketch, the allowed errors of a probe + 1, and whether no bit is cleared.
#: What a record's keys have in common lies together, which lets a shuffle's blocks shrink.
KEYS = "key bigint, h bigint, facts bigint"
#: Bits of a token, of a key, of ``h`` and of the parity sketch; the largest size told apart before the exact check.
TOKEN_BITS, KEY_BITS, SHORT_BITS, SKETCH_BITS, MOST_SIZE = 48, 40, 40, 40, (1 << 19) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def group_ends(largest: int) -> np.ndarray:
    ends = list(GROUPS)
    while ends[-1] < largest:
        ends.append(int(ends[-1] * RATIO))
    return np.array(ends)


def needed(size: np.ndarray | int) -> np.ndarray:
    """One more than the largest 2x + y of a record of ``size`` with a record at least as large above the threshold."""
    num, den = SIMILARITY
    a = np.asarray(size, dtype=np.int64)
    out = np.zeros(a.shape, np.int64)
    # With y = x + b - a, errors x + y <= (den-num)/(num+den) (a+b) leave x <= (bound - (b - a)) / 2.
    for more in range(int(a.max(initial=0)) * (den - num) // num + 1):
        x = ((den - num) * (2 * a + more) // (num + den) - more) // 2
        possible = (x >= 0) & ((a + more) * num <= a * den)
        out = np.where(possible, np.maximum(out, 3 * x + more), out)
    return out + 1


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of every word; equal words of a text have different tokens by their occurrence."""
    owner, code, found = words(texts)
    spelled = found.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in spelled), np.uint64, len(spelled))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(code))
    occurrence = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        token = mix(hashes[code] + (occurrence + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return owner, token >> np.uint64(64 - TOKEN_BITS)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the parts of ``values`` between ``bounds``; parts may be empty."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _bags(first_only: bool):
    """The multisets of texts; with ``first_only`` one row per multiset and slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1).to_pylist(), SLICE):
                owner, token = tokens(texts)
                size = np.bincount(owner, minlength=len(texts))
                bounds = np.concatenate([[0], np.cumsum(size)])
                # Sums over mixed tokens: equal multisets have equal sums.
                k1, k2 = _sums(mix(token), bounds), _sums(mix(token ^ np.uint64(0xD6E8FEB86659FD93)), bounds)
                ids = batch.column(0).slice(first, len(texts))
                use = size > 0
                if first_only:
                    order = np.lexsort((k2, k1))
                    again = np.zeros(len(texts), bool)
                    again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
                    use &= ~again
                at = pa.array(bounds.astype(np.int32))
                low = pa.ListArray.from_arrays(at, pa.array(token.astype(np.uint32).view(np.int32)))
                high = pa.ListArray.from_arrays(at, pa.array((token >> np.uint64(32)).astype(np.uint16).view(np.int16)))
                h = (k1 & np.uint64((1 << SHORT_BITS) - 1)).view(np.int64)
                out = pa.RecordBatch.from_arrays([ids, pa.array(h), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size.astype(np.int32)), low, high], ["id", "h", "k1", "k2", "size", "low", "high"])
                yield out.filter(pa.array(use))

    return work


def _joined(low: pa.Array, high: pa.Array) -> np.ndarray:
    """The tokens of two list columns, one after another."""
    low, high = (c.flatten().to_numpy(zero_copy_only=False) for c in (low, high))
    return low.view(np.uint32).astype(np.uint64) | high.view(np.uint16).astype(np.uint64) << np.uint64(32)


def counter(token: np.ndarray) -> np.ndarray:
    return (mix(token) >> np.uint64(20)).astype(np.int64) % COUNTERS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, records = np.zeros(COUNTERS, np.int64), 0
    for batch in batches:
        records += batch.num_rows
        total += np.bincount(counter(_joined(batch.column(0), batch.column(1))), minlength=COUNTERS)
    used = np.flatnonzero(total)
    # The records are counted along, as counter -1.
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], records))], ["counter", "n"])


def allowed_errors(weight: np.ndarray, cleared: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """t (records x chunks, -1 to 1) with a sum of t + 1 of at least ``budget``, at the least expected cost.

    t is -1 for a chunk that isn't probed, 0 for equality, 1 for one cleared bit.
    ``weight``: records expected to share the chunk; ``cleared``: to share it after clearing one bit.
    """
    step0, m = weight + 1e-2, weight.shape[1]
    step1 = np.maximum(cleared + 5e-2, step0)
    rank = np.argsort(np.argsort(np.concatenate([step0, step1], axis=1), axis=1, kind="stable"), axis=1, kind="stable")
    taken = rank < budget[:, None]
    return taken[:, :m].astype(np.int32) + taken[:, m:] - 1


def chunk_keys(h: np.ndarray, size: np.ndarray, flat: np.ndarray, counts: np.ndarray, records: int) -> list[np.ndarray]:
    """The columns of ``KEYS`` for records whose tokens lie in ``flat`` one after another."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    ends = group_ends(int(size.max()))
    high = np.searchsorted(ends, size)
    low = np.searchsorted(ends, -(-size * SIMILARITY[0] // SIMILARITY[1]))
    sketch = np.zeros(n, np.uint64)
    mixed = mix(flat)
    np.bitwise_xor.at(sketch, owner, np.uint64(1) << (mixed % np.uint64(SKETCH_BITS)))
    info = np.maximum(-np.log2(np.maximum(counts[counter(flat)], 1) / records), 0.05)
    needs = needed(np.arange(int(size.max()) + 1))
    columns: list[list[np.ndarray]] = [[] for _ in range(4)]
    for g in range(int(low.min()), int(high.max()) + 1):
        inside = (low <= g) & (g <= high)
        rec = np.flatnonzero(inside)
        if not len(rec):
            continue
        m = -(-int(needed(int(ends[g]))) // 2)
        place = np.cumsum(inside) - 1
        own = np.flatnonzero(inside[owner])
        chunk = ((mixed[own] >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        slot = place[owner[own]] * m + chunk
        order = np.argsort(slot, kind="stable")
        slot, token, bits = slot[order], mixed[own][order], info[own][order]
        whole = _sums(token, np.searchsorted(slot, np.arange(len(rec) * m + 1)))
        salt = mix(np.arange(len(rec) * m, dtype=np.uint64) % np.uint64(m) + np.uint64(g * 1000 + 1))
        with np.errstate(over="ignore"):
            keys = mix(whole + salt)
            cleared = mix(whole[slot] - token + salt[slot])
        total = np.bincount(slot, weights=bits, minlength=len(rec) * m)
        expected = records * 2.0 ** -np.minimum(total, 60)
        budget = np.where(high[rec] == g, needs[size[rec]], 0)
        # A chunk with one bit more is about as frequent as three without it.
        errors = allowed_errors(expected.reshape(-1, m), 3 * expected.reshape(-1, m), budget).ravel()
        for column, parts in zip(columns, ((keys, cleared), (np.ones(len(keys), bool), np.zeros(len(cleared), bool)), (errors, errors[slot]), (np.repeat(rec, m), rec[slot // m]))):
            column.extend(parts)
    key, whole, errors, rec = (np.concatenate(c) for c in columns)
    facts = np.minimum(size, MOST_SIZE)[rec] | sketch.astype(np.int64)[rec] << 19 | (errors.astype(np.int64) + 1) << 59 | whole.astype(np.int64) << 61
    return [(key >> np.uint64(64 - KEY_BITS)).view(np.int64), h[rec], facts]


def _keys(counts: np.ndarray, records: int, role: str):
    """The keys of records as ``probe`` (of whole chunks that are probed) or as ``index`` (of all, and with one bit cleared)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                h, size = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                flat = _joined(part.column(2), part.column(3))
                key, owner, facts = chunk_keys(h, size.astype(np.int64), flat, counts, records)
                if role == "probe":
                    use = (facts >> 61 & 1 == 1) & (facts >> 59 & 3 >= 1)
                    key, owner, facts = key[use], owner[use], facts[use]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(facts)], ["key", "h", "facts"])

    return work


#: The parts of tokens that the parity sketches of the check of pairs take; with both, all uses of the classes take the same columns.
PARITIES = ("low", "high")


def _parity(part: str) -> Column:
    """A parity sketch of 64 bits by six bits of a part of each token; two differ in no more bits than their multisets in tokens."""
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, t: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), t.cast("int").bitwiseAND(F.lit(63)))))


class NearDuplicates:
    """The classes of equal multisets and the links between classes.

    ``members``: (id, k1, k2), one row per record; ``links``: pairs of classes
    (k1_a, k2_a, k1_b, k2_b) above the threshold, each once.
    """

    def __init__(self, records: DataFrame, id_column: str = "id", text_column: str = "text"):
        own = records.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null")
        bags = own.mapInArrow(_bags(False), BAGS)
        once = Window.partitionBy("h", "k1", "k2").orderBy("size")
        self.members = bags.select("id", "k1", "k2").filter("id is not null and k1 is not null and k2 is not null").distinct()
        # Copies are merged in each slice before the shuffle, so a text that a third of the records share is no hot key.
        # All uses take the same columns: they share this one shuffle, and by ``h`` it serves the check of pairs, too.
        self.classes = own.mapInArrow(_bags(True), BAGS).drop("id").filter("h is not null and k1 is not null and k2 is not null").repartition("h").withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
        self.links = self._links(bags)

    def _links(self, bags: DataFrame) -> DataFrame:
        num, den = SIMILARITY
        counts = np.zeros(COUNTERS + 1, np.int64)
        # At most COUNTERS + 1 rows, whatever the collection.
        for row in bags.select("low", "high").mapInArrow(_counts, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n")).collect():
            counts[row[0]] = row[1]
        own = self.classes.select("h", "size", "low", "high", "k1", "k2")
        a, b = (own.mapInArrow(_keys(counts[:-1], max(1, int(counts[-1])), role), KEYS).alias(side) for role, side in (("probe", "a"), ("index", "b")))
        fact = lambda side, at, bits: F.shiftright(f"{side}.facts", at).bitwiseAND(F.lit((1 << bits) - 1))
        size = lambda side: fact(side, 0, 19)
        # A cleared bit is allowed only where the probe allows an error.
        one = (fact("b", 61, 1) == 1) | (fact("a", 59, 2) == 2)
        sketch = F.shiftright(F.col("a.facts").bitwiseXOR(F.col("b.facts")), 19).bitwiseAND(F.lit((1 << SKETCH_BITS) - 1))
        close = (F.bit_count(sketch) * (num + den) <= (den - num) * (size("a") + size("b"))) | (size("b") == MOST_SIZE)
        sized = (size("a") * den >= num * size("b")) & (size("a") <= size("b"))
        # A class isn't its own partner; two classes that share h by chance differ in size or sketch.
        other = (F.col("a.h") != F.col("b.h")) | (sketch != 0) | (size("a") != size("b"))
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & one & sized & close & other)
        pairs = met.select(F.least("a.h", "b.h").alias("h_a"), F.greatest("a.h", "b.h").alias("h_b")).distinct()
        # Classes that share h by chance all come along here; each is checked by its own tokens. Before tokens travel,
        # two more parity sketches drop most pairs that the exact check would drop.
        side = lambda s, *more: own.select(F.col("h").alias(f"h_{s}"), F.col("size").alias(f"size_{s}"), *(_parity(at).alias(f"{at}_parity_{s}") for at in PARITIES), *(F.col(c).alias(f"{c}_{s}") for c in more))
        bound = (den - num) * (F.col("size_a") + F.col("size_b"))
        likely = reduce(lambda x, y: x & y, (F.bit_count(F.col(f"{at}_parity_a").bitwiseXOR(F.col(f"{at}_parity_b"))) * (num + den) <= bound for at in PARITIES))
        carried = ["k1", "k2", "size", "low", "high"]
        likely_pairs = pairs.join(side("a"), "h_a").join(side("b", *(c for c in carried if c != "size")), "h_b").filter(likely).select("h_a", "size_a", "low_parity_a", *(f"{c}_b" for c in carried if c != "size"))
        # Found by h, as the classes lie by it, and told apart by size and sketch. Differences keep these from becoming
        # keys of the join, for which the classes would have to move.
        again = own.select(F.col("h").alias("h_a"), _parity("low").alias("again"), *(F.col(c).alias(f"{c}_a") for c in carried if c != "size"))
        both = likely_pairs.join(again, "h_a").filter((F.col("low_parity_a").bitwiseXOR(F.col("again")) == 0) & (F.size("low_a") - F.col("size_a") == 0))
        token = lambda s: F.zip_with(f"low_{s}", f"high_{s}", lambda x, y: x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(y.cast("bigint") * (1 << 32)))
        shared = F.size(F.array_intersect(token("a"), token("b")))
        ordered = (F.col("h_a") != F.col("k1_b").bitwiseAND(F.lit((1 << SHORT_BITS) - 1))) | (F.struct("k1_a", "k2_a") < F.struct("k1_b", "k2_b"))
        return both.filter(ordered & (shared * (num + den) >= num * (F.size("low_a") + F.size("low_b")))).select("k1_a", "k2_a", "k1_b", "k2_b")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), smaller id first: all pairs, copies included."""
        m = lambda s: self.members.select(F.col("id").alias(f"id_{s}"), F.col("k1").alias(f"k1_{s}"), F.col("k2").alias(f"k2_{s}"))
        linked = self.links.join(m("a"), ["k1_a", "k2_a"]).join(m("b"), ["k1_b", "k2_b"]).select("id_a", "id_b")
        # Of the same shape as above, so that all take one shuffle of the members. A class of more than ``BLOCK`` copies is a
        # grid of blocks against blocks, spread over tasks.
        counted = lambda s: m(s).withColumn("n", F.count("*").over(Window.partitionBy(f"k1_{s}", f"k2_{s}")))
        few = lambda s: counted(s).filter(F.col("n") <= BLOCK).drop("n")
        same = few("a").join(few("b"), (F.col("k1_a") == F.col("k1_b")) & (F.col("k2_a") == F.col("k2_b")) & (F.col("id_a") < F.col("id_b")))
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        many = counted("a").filter(F.col("n") > BLOCK).select(F.col("id_a").alias("id"), F.col("k1_a").alias("k1"), F.col("k2_a").alias("k2"), parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # A row stands on the left of the cells of its block from it on, and on the right of those up to it.
        cells = lambda low, high, x, y: many.select("id", "k1", "k2", "own", F.explode(F.sequence(low, high)).alias("other")).select("id", "k1", "k2", x.alias("x"), y.alias("y"))
        left, right = cells(F.col("own"), F.col("parts") - 1, F.col("own"), F.col("other")), cells(F.lit(0), F.col("own"), F.col("other"), F.col("own"))
        grid = left.withColumnRenamed("id", "left").join(right.withColumnRenamed("id", "right"), ["k1", "k2", "x", "y"]).filter((F.col("x") < F.col("y")) | (F.col("left") < F.col("right")))
        copies = same.select("id_a", "id_b").unionByName(grid.select(F.least("left", "right").alias("id_a"), F.greatest("left", "right").alias("id_b")))
        return linked.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(copies)

    def membership(self) -> DataFrame:
        """(id, class_id, links): each record's class, named by its smallest id, and the class's links to other classes."""
        ends = self.links.select(F.explode(F.array(F.struct(F.col("k1_a").alias("k1"), F.col("k2_a").alias("k2")), F.struct(F.col("k1_b").alias("k1"), F.col("k2_b").alias("k2")))).alias("e")).groupBy("e.k1", "e.k2").agg(F.count("*").alias("links"))
        named = self.members.groupBy("k1", "k2").agg(F.min("id").alias("class_id")).join(ends, ["k1", "k2"], "left")
        return self.members.join(named, ["k1", "k2"]).select("id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
