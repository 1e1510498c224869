"""Evaluation texts leaking into training text: a distributed positional inverted index.

The index is built once and stored in the shared folder: a row per shard (whole
documents of about ``SHARD`` characters) with its terms and, one after another, the
sorted positions of each term in the shard's token sequence. Shards hold whole
documents, so nothing is shuffled, nothing is sampled, and a lost task only reads its
shards again. Any number of searches read the same index.

A phrase is searched from its rarest term in the shard: its list, shifted by the term's
offset in the phrase, gives the possible starts, which are intersected with the shifted
lists of the other terms in order of rarity. With a ``slack`` every term may stand that
many places from its own (proximity matches: words inserted, left out or changed in
order); without it the match is exact. A match that runs over a document's end is none.

The test vocabulary and phrases travel with the tasks. Their size is checked: test
items of more than ``MOST_CHARACTERS`` are searched one part after another, each part's
result being written before the next one is read.

Defined cases: null and empty texts hold no words; items of fewer words than the
phrase length can't leak; repeated doc_ids are reported once; a null doc_id or
item_id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.runs import slices, words
from corpuscle.session import store

#: A leak is a run of so many consecutive words.
PHRASE = 12
#: Characters of a shard, and of test items searched at once (about 30 MB with all their phrases).
SHARD, MOST_CHARACTERS = 1_000_000, 3_000_000
#: Positions intersected at once.
AT_ONCE = 2_000_000

#: ``terms``, where the list of each begins in ``postings``, and where the words of each document begin.
INDEX = "doc_ids array<bigint>, begins array<int>, terms array<string>, lists array<int>, postings array<int>"
FOUND = "doc_id bigint, item_id bigint, phrases bigint"


class Phrases:
    """The different phrases of test items, as rows of term numbers."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        owner, code, terms = words([t or "" for _, t in items])
        self.n, self.terms = n, terms
        starts = np.arange(max(0, len(code) - n + 1))
        starts = starts[owner[starts] == owner[starts + n - 1]] if len(starts) else starts
        grams = code[starts[:, None] + np.arange(n)] if len(starts) else np.zeros((0, n), np.int64)
        self.grams, which = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, np.int64))
        ids = np.array([i for i, _ in items], dtype=np.int64)
        pairs = np.unique(np.stack([which.ravel(), ids[owner[starts]]], axis=1), axis=0) if len(grams) else np.zeros((0, 2), np.int64)
        #: Items of phrase g: items[bounds[g]:bounds[g + 1]].
        self.items = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.grams) + 1))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, texts in slices(batch.column(1).to_pylist(), SHARD):
            owner, code, terms = words(texts)
            if not len(code):
                continue
            used, code = np.unique(code, return_inverse=True)
            row = (ids[first : first + len(texts)], np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32), terms.take(pa.array(used)), np.concatenate([[0], np.cumsum(np.bincount(code))]).astype(np.int32), np.argsort(code, kind="stable").astype(np.int32))
            columns = [pa.array(c) if isinstance(c, np.ndarray) else c for c in row]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["doc_ids", "begins", "terms", "lists", "postings"])


def index(documents: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): a row per shard as ``INDEX``."""
    own = documents.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # Rows are large, so row groups are small: a task that reads the index holds one at a time.
    return store(own.mapInArrow(_shards, INDEX), "leak-index", row_group=16 << 20)


class Shard:
    """The lists of the test vocabulary in one shard."""

    def __init__(self, terms: pa.Array, lists: np.ndarray, postings: np.ndarray, begins: np.ndarray, wanted: pa.Array):
        place = pc.fill_null(pc.index_in(wanted, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        there = place >= 0
        self.begin = np.where(there, lists[place], 0).astype(np.int64)
        self.frequency = np.where(there, lists[place + 1] - lists[place], 0).astype(np.int64)
        self.postings, self.begins, self.n = postings, begins, int(begins[-1])
        # The lists of wanted terms one after another, each raised above the one before, so that one search meets any of them.
        self.offset = np.cumsum(self.frequency) - self.frequency
        at = np.repeat(self.begin - self.offset, self.frequency) + np.arange(int(self.frequency.sum()))
        self.keys = np.repeat(np.arange(len(place)), self.frequency) * (self.n + 1) + postings[at]

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The list of ``term`` has a position in [low, high], all within the shard."""
        base = term * (self.n + 1)
        i = np.searchsorted(self.keys, base + low)
        return (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= base + high)

    def find(self, grams: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(document number, phrase number) of every match, each pair once."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = grams.shape[1]
        frequency = self.frequency[grams]
        phrase = np.flatnonzero(frequency.min(axis=1) > 0) if len(grams) else none[0]
        if not len(phrase) or self.n == 0:
            return none
        rarity = np.argsort(frequency[phrase], axis=1, kind="stable")
        anchor = grams[phrase, rarity[:, 0]]
        load = np.cumsum(self.frequency[anchor] * (2 * slack + 1))
        cuts = np.searchsorted(load, np.arange(0, load[-1], AT_ONCE)).tolist()
        out = []
        for low, high in zip(cuts, [*cuts[1:], len(phrase)]):
            if low == high:
                continue
            own = np.arange(low, high)
            count = self.frequency[anchor[own]]
            row = np.repeat(own, count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            met = self.postings[self.begin[anchor[row]] + inner].astype(np.int64)
            doc = np.searchsorted(self.begins, met, side="right") - 1
            start = met - rarity[row, 0]
            if slack:
                row, doc = np.repeat(row, 2 * slack + 1), np.repeat(doc, 2 * slack + 1)
                start = (start[:, None] + np.arange(-slack, slack + 1)).ravel()
            first, last = self.begins[doc].astype(np.int64), self.begins[doc + 1].astype(np.int64) - 1
            keep = (start >= first) & (start + n - 1 <= last) if not slack else np.ones(len(row), bool)
            row, start, doc, first, last = (c[keep] for c in (row, start, doc, first, last))
            for j in range(1, n):
                shift = rarity[row, j]
                # Within the slack of its place and within the document.
                begin, end = np.maximum(start + shift - slack, first), np.minimum(start + shift + slack, last)
                keep = (begin <= end) & self.holds(grams[phrase[row], shift], begin, end)
                row, start, doc, first, last = (c[keep] for c in (row, start, doc, first, last))
            out.append(np.stack([doc, phrase[row]], axis=1))
        hits = np.unique(np.concatenate(out), axis=0)
        return hits[:, 0], hits[:, 1]


def _search(phrases: Phrases, slack: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, begins, terms, lists, postings = (c.slice(at, 1).flatten() for c in batch.columns)
                ids, begins, lists, postings = (c.to_numpy(zero_copy_only=False) for c in (ids, begins, lists, postings))
                doc, gram = Shard(terms, lists, postings, begins, phrases.terms).find(phrases.grams, slack)
                if not len(doc):
                    continue
                count = phrases.bounds[gram + 1] - phrases.bounds[gram]
                item = phrases.items[np.repeat(phrases.bounds[gram] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                pairs, n = np.unique(np.stack([np.repeat(doc, count), item], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]].astype(np.int64)), pa.array(pairs[:, 1]), pa.array(n)], ["doc_id", "item_id", "phrases"])

    return search


def _parts(items: DataFrame, n: int, most: int) -> Iterator[Phrases]:
    """The items in parts of about ``most`` characters, one in memory at a time; a longer item comes alone, whole."""
    part, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator():
        if part and size + len(row[1]) > most:
            yield Phrases(part, n)
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    if part:
        yield Phrases(part, n)


def search(stored: DataFrame, items: DataFrame, n: int = PHRASE, slack: int = 0, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, phrases) by a stored index: how many different phrases of ``n`` words they share, each word within ``slack`` places of its own."""
    found: list[DataFrame] = []
    waiting = None
    for phrases in _parts(items, n, most_characters):
        if waiting is not None:
            found.append(store(waiting, "leaks"))
        waiting = stored.mapInArrow(_search(phrases, slack), FOUND)
    if waiting is None:
        return stored.limit(0).select(F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("phrases"))
    # A document delivered again has the same matches.
    return reduce(DataFrame.unionByName, [*found, waiting]).groupBy("doc_id", "item_id").agg(F.max("phrases").alias("phrases"))


def leaks(documents: DataFrame, items: DataFrame, n: int = PHRASE, slack: int = 0, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, phrases): every document that shares ``n`` consecutive words or more with an item."""
    return search(index(documents), items, n, slack, most_characters)


def leaked_items(documents: DataFrame, items: DataFrame, n: int = PHRASE) -> DataFrame:
    """Per leaked item: the number of documents and the largest share of its phrases in one document."""
    total = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.greatest(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0))) - (n - 1), F.lit(1)).alias("total"))
    return leaks(documents, items, n).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("phrases").alias("most")).join(total, "item_id").select("item_id", "documents", F.least(F.lit(1.0), F.round(F.col("most") / F.col("total"), 6)).alias("largest_share"))
