"""Overlapping chunks of texts at sentence or word ends.

The places of sentence marks, blanks and word borders are found once per text, as sorted
arrays; where a window ends and where the next one begins are searches in them. It runs
over Arrow batches.

Defined cases: null and blank texts give no chunk; fragments under ``LEAST``
characters none either and take no number; a window that reaches the end of a text
longer than the overlap is followed by a last short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.functions import identifiers as I
from corpuscle.functions import runs

SIZE, OVERLAP, LEAST, REACH = 1000, 200, 30, 100
# Sentence marks and the line break.
MARKS = [ord(c) for c in ".!?\n"]


@lru_cache(1)
def _spaces() -> np.ndarray:
    """True for the code points that are white space."""
    return np.char.isspace(np.arange(0x110000, dtype="<u4").view("<U1"))


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the chunks, in code points, without outer white space.

    A window ends behind the last sentence mark or line break of its last ``REACH`` characters, else at the last blank
    there, else at its size. The next one begins ``overlap`` before, at the first border of a word from there on.
    """
    cp = runs.code_points(text)
    space = _spaces()[cp]
    seen = np.flatnonzero(~space)
    if not len(seen):
        return []
    n = len(cp)
    stops, blanks = np.flatnonzero(np.isin(cp, MARKS)) + 1, np.flatnonzero(cp == 32)
    borders = np.flatnonzero(np.append(space, True) | np.append(True, space))

    def last(places: np.ndarray, low: int, high: int) -> int:
        """The last of the places in [low, high], -1 for none."""
        i = int(np.searchsorted(places, high, side="right"))
        return int(places[i - 1]) if i and places[i - 1] >= low else -1

    def end_of(start: int) -> int:
        full = start + size
        if full >= n:
            return n
        low = max(start + 1, full - REACH)
        found = last(stops, low + 1, full), last(blanks, low, full - 1)
        return next((place for place in found if place >= 0), full)

    def after(start: int, end: int) -> int:
        back = end - overlap
        return min(int(borders[np.searchsorted(borders, back)]), end) if back > start else start + max(size - overlap, 1)

    starts, ends = [0], [end_of(0)]
    while (at := after(starts[-1], ends[-1])) < n:
        starts.append(at)
        ends.append(end_of(at))
    inner = np.searchsorted(seen, starts), np.searchsorted(seen, ends) - 1
    left, right = np.append(seen, n)[inner[0]], np.append(seen, -1)[inner[1]] + 1
    return [(a, b) for a, b in zip(left.tolist(), right.tolist()) if b - a >= LEAST]


def chunk(df: DataFrame, id_column: str, text_column: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id_column, chunk_index, char_start, char_end, token_count, chunk_text)."""
    own = df.select(id_column, F.col(text_column).alias("text")).filter("text is not null")
    schema = StructType([own.schema[id_column]]).add("chunk_index", "integer").add("char_start", "integer").add("char_end", "integer").add("token_count", "integer").add("chunk_text", "string")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, i, a, b, (b - a) // 4, text[a:b]) for key, text in zip(batch[id_column], batch["text"]) for i, (a, b) in enumerate(windows(text, size, overlap))]
            yield pd.DataFrame(rows, columns=schema.names)

    return own.mapInPandas(work, schema)


def with_chunk_ids(chunks: DataFrame, section_id: str = "section_id") -> DataFrame:
    """Adds ``id``, which follows from the section's id and the chunk's number, so that every run gives the same."""
    return chunks.withColumn("id", I.uuid5(F.col(section_id), F.concat(F.lit("chunk:"), F.col("chunk_index"))))


def abstract_sections(articles: DataFrame) -> DataFrame:
    """One section per abstract that isn't blank: (section_id, article_id, section_type, char_start, char_end, text)."""
    body = F.col("abstract")
    return articles.filter(body.isNotNull() & (F.trim(body) != "")).select(I.uuid5(F.col("id"), F.lit("section:0")).alias("section_id"), F.col("id").alias("article_id"), F.lit("abstract").alias("section_type"), F.lit(0).alias("char_start"), F.char_length(body).alias("char_end"), body.alias("text"))


def font_sections(spans: DataFrame) -> DataFrame:
    """Sections of (article_id, place, font_size, text) spans: a title is a span of 1.15 times the body size or more and under 120 characters.

    The body size is the upper median per article; a running count of titles numbers the sections.
    """
    from pyspark.sql import Window

    body = spans.groupBy("article_id").agg(F.expr("sort_array(collect_list(font_size))[int(count(*) / 2)]").alias("body"))
    title = (F.col("font_size") >= 1.15 * F.col("body")) & (F.char_length("text") < 120)
    order = Window.partitionBy("article_id").orderBy("place")
    marked = spans.join(body, "article_id").withColumn("is_title", title.cast("int")).withColumn("section_index", F.sum(title.cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.when(F.col("is_title") == 0, F.struct("place", "text"))))
    return marked.groupBy("article_id", "section_index").agg(F.max(F.when(F.col("is_title") == 1, F.col("text"))).alias("title"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).filter(F.char_length("text") >= LEAST)
