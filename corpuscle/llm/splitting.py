"""Splitting oversized items at natural boundaries.

Every place between two code points has a strength as a cut: paragraph, line,
sentence, clause, blank, border of punctuation, nothing. A sparse table over the
strengths answers "the strongest cut of this window, the rightmost of equals" in
constant time. A piece takes the strongest cut between half the limit and the
limit, else the strongest one that gets further than the piece before, else it is
cut by force at the limit. The next piece begins ``overlap`` before the cut, or at
the cut itself where only that lets it end at a natural place.

Offsets are code points of the stored text, so a piece of a claim lies at
``char_start + piece_start`` of its chunk.

Defined cases: sizes don't count outer blanks, tabs and line breaks; a null text
has one piece without text if the offsets make the item oversized, else none;
repeated deliveries count once; rows with a null id are left out; a text of one
run longer than the limit is cut by force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import runs

#: Limits and the overlap in code points.
CHUNK_LIMIT, CLAIM_LIMIT, OVERLAP = 1000, 600, 100

PIECES = "item_kind string, item_id string, piece_index int, piece_start int, piece_end int, overlap int, forced int, text string"

# Sentence ends, of them those that need no blank, clause marks.
ENDS, FULL_ENDS, CLAUSES = ".!?…؟۔।॥。！？｡", "。！？｡।॥", ",;:،؛、，；："


def strengths(text: str) -> np.ndarray:
    """strength[p] of the cut before code point p; 0 at places that are no natural boundary."""
    cp = runs.code_points(text)
    n = len(cp)
    kind = runs.categories()[cp]
    space, mark = kind == runs.SPACE, kind == runs.MARK
    border = space | (kind == runs.PUNCTUATION)
    out = np.zeros(n + 1, np.int64)
    inner = out[1:n]
    before, after = slice(0, n - 1), slice(1, n)
    inner[border[before] | border[after]] = 1
    blank_end = space[before] & ~space[after]
    inner[space[before]] = 2
    # The last visible code point before each place.
    seen = np.maximum.accumulate(np.where(space, -1, np.arange(n)))
    last = np.where(seen >= 0, cp[np.maximum(seen, 0)], 0)
    of = lambda chars: np.isin(last, [ord(c) for c in chars])
    closing = np.isin(last, [ord(c) for c in "\"'”’»)]」』）"])
    previous = np.where(seen >= 1, cp[np.maximum(seen - 1, 0)], 0)
    ended = of(ENDS) | (closing & np.isin(previous, [ord(c) for c in ENDS]))
    inner[blank_end & of(CLAUSES)[before]] = 3
    inner[~space[before] & ~border[after] & np.isin(cp[before], [ord(c) for c in CLAUSES[4:]])] = 3
    inner[blank_end & ended[before]] = 4
    inner[~space[before] & ~border[after] & (of(FULL_ENDS) | (closing & np.isin(previous, [ord(c) for c in FULL_ENDS])))[before]] = 4
    # Line breaks since the last visible code point.
    breaks = np.concatenate([[0], np.cumsum(cp == 10)])
    since = breaks[1:n] - breaks[np.maximum(seen[before] + 1, 0)]
    inner[blank_end & (since == 1)] = 5
    inner[blank_end & (since > 1)] = 6
    inner[mark[after] & ~border[before]] = 0
    return out


class RangeMaximum:
    """A sparse table over ranges of at most ``longest`` values: the place of the largest value, the rightmost of equals."""

    def __init__(self, values: np.ndarray, longest: int | None = None):
        self.n = len(values)
        longest = min(self.n, longest or self.n)
        # Value and place in one number, so that the maximum is the rightmost of equals.
        level = values.astype(np.int64) * (self.n + 1) + np.arange(self.n)
        self.levels = [level]
        width = 1
        while 2 * width <= longest:
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, low: int, high: int) -> tuple[int, int]:
        """(value, place) of the range [low, high], (0, high) for an empty one."""
        if low > high:
            return 0, high
        k = (high - low + 1).bit_length() - 1
        value, place = divmod(int(max(self.levels[k][low], self.levels[k][high - (1 << k) + 1])), self.n + 1)
        return value, place


def cut(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap with the piece before, cut by force) of the pieces of ``text``, without its outer blanks."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    begin, stop = len(text) - len(text.lstrip(" \t\r\n")), len(text.rstrip(" \t\r\n"))
    if begin >= stop:
        return []
    if stop - begin <= limit:
        return [(begin, stop, 0, 0)]
    # No window is longer than the limit, so the table has a level per power of two up to it, whatever the text's length.
    table = RangeMaximum(strengths(text), limit)
    out, start, end = [], begin, begin
    while True:
        if stop - start <= limit:
            out.append((start, stop, end - start if out else 0, 0))
            return out
        low = max(start, end) + 1
        value, place = table.best(max(low, start + limit // 2), start + limit)
        if not value:
            value, place = table.best(low, start + limit)
        if not value and start < end:
            # Only without overlap may the piece end at a natural place.
            start = end
            continue
        if not value:
            place = start + limit
        out.append((start, place, end - start if out else 0, int(not value)))
        end = place
        start = max(start + 1, place - overlap)


def _oversized(df: DataFrame, kind: str, size: Column, limit: int, text: str) -> DataFrame:
    return df.filter(F.col("id").isNotNull() & (size > limit)).select(F.lit(kind).alias("item_kind"), F.col("id").alias("item_id"), F.col(text).alias("text")).dropDuplicates(["item_id"])


def _trimmed(c: str) -> Column:
    return F.char_length(F.btrim(F.col(c), F.lit(" \t\r\n")))


def _piece_rows(limits: dict[str, int], overlap: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, item, text in zip(batch["item_kind"], batch["item_id"], batch["text"]):
                found = cut(text, limits[kind], overlap) if isinstance(text, str) else []
                if not found:
                    rows.append((kind, item, 0, None, None, 0, 0, None))
                rows.extend((kind, item, i, a, b, shared, forced, text[a:b]) for i, (a, b, shared, forced) in enumerate(found))
            frame = pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_index", "piece_start", "piece_end", "overlap", "forced", "text"])
            yield frame.astype({"piece_start": "Int32", "piece_end": "Int32"})

    return work


def chunk_size() -> Column:
    return _trimmed("text")


def claim_size() -> Column:
    return F.when(F.col("char_end") > F.col("char_start"), F.col("char_end") - F.col("char_start")).otherwise(_trimmed("verbatim"))


def split_oversized(chunks: DataFrame, claims: DataFrame, chunk_limit: int = CHUNK_LIMIT, claim_limit: int = CLAIM_LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every oversized chunk and claim, as ``PIECES``. Only these items leave the JVM."""
    items = _oversized(chunks, "chunk", chunk_size(), chunk_limit, "text").unionByName(_oversized(claims, "claim", claim_size(), claim_limit, "verbatim"))
    return items.mapInPandas(_piece_rows({"chunk": chunk_limit, "claim": claim_limit}, overlap), PIECES)


def forced_items(pieces: DataFrame) -> DataFrame:
    """(item_kind, item_id, forced): forced is 1 where some piece had to be cut by force."""
    return pieces.groupBy("item_kind", "item_id").agg(F.max("forced").cast("bigint").alias("forced"))
