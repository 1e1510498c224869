"""Abusive, hateful or sexual content: a subsequence string-kernel SVM with Nystroem landmarks.

The kernel counts common subsequences of three and four characters, gaps allowed,
each gap costing ``DECAY``; so insults with replaced, masked, inserted or spaced
characters keep most of their features. Texts are folded first (case, accents,
look-alike letters, digits, stretched letters, invisible characters). The feature
map of the kernel is explicit and hashed with signs, so the decision of the SVM over
the landmarks, sum(alpha_l * k(x, z_l)) + b, is one weight per hashed subsequence:
scoring a corpus is table look-ups and sums over whole batches.

Labels are given per document and units of text are judged, so training is by
multiple instances: a document labelled 0 holds no bad unit, one labelled 1 holds
the units that models fitted on other documents rate above nearly all units of
documents labelled 0 (cross-fitting in ``FOLDS``, over ``TURNS``); one in which they
find none counts as a rater's error. The threshold is the one of best F1 on labels
unseen by the model. Of a document with several labels the mean counts, at least
half being 1.

Only the fit is bounded, to ``MOST_LABELLED`` documents of ``MOST_CHARACTERS`` together
and ``MOST_UNITS`` units of them, drawn by a hash; it runs in one task. All documents
are scored over their whole text.

Defined cases: null and empty texts score as the empty unit, the bias; labels other
than 0 and 1, null labels and labels of absent documents don't count; without
labels of both classes every score is 0 and nothing is found; repeated rows stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import runs

#: Labelled documents and units of them that a model is fitted on.
MOST_LABELLED, MOST_UNITS = 12_000, 30_000
#: Characters of text that a model is fitted on.
MOST_CHARACTERS = 60_000_000
#: Landmarks, bits of a feature's hash, cost of a gap, regularization.
LANDMARKS, BITS, DECAY, RIDGE = 400, 13, 0.6, 1e-3
#: Characters of text taken at once.
SLICE = 500_000
#: Units below this length count as this long.
SHORTEST = 40
#: Parts of cross-fitting, rounds of choosing units, share of documents labelled 0 that chosen units rise above.
FOLDS, TURNS, ABOVE = 3, 3, 0.97

# Places of the subsequences' characters; one missing place is one gap.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4))
# Letters that look alike, and characters that aren't seen.
ALIKE = dict(zip("аеорсухіјѕһԁԛԝьвкмнтАВЕКМНОРСТУХІЅЈαορυνικτηοεΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ@$€", "aeopcyxijshdqwbbkmhtabekmhopctyxisjaopuvikthoeabezhikmnoptyxigase"))
UNSEEN = (0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370), *range(0xFE00, 0xFE10))
ENDS = ".!?…؟۔।॥。！？"
CLOSERS = "\"'”’»)]」』）"


@lru_cache(1)
def _folds() -> np.ndarray:
    """The folded code point of every code point, 0 for those that aren't seen."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in (*range(0x3000), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        base = unicodedata.normalize("NFKD", chr(i))[:1].lower()[:1] if not unicodedata.category(chr(i)).startswith("M") else chr(i)
        out[i] = ord(base) if base else i
    for a, b in ALIKE.items():
        out[ord(a)] = ord(b)
    out[runs.categories() == runs.SPACE] = 0x20
    out[[ord("’"), ord("‘"), ord("`"), ord("´")]] = ord("'")
    out[list(UNSEEN)] = 0
    return out


@lru_cache(1)
def _letters() -> np.ndarray:
    return runs.categories() == runs.LETTER


# The letters that the digits 0 to 9 stand for in words.
_LEET = np.array([ord(c) for c in "oizeasgtbg"], np.uint32)


@lru_cache(1)
def _caseless_start() -> np.ndarray:
    """True for code points that don't continue a sentence after its end: all but small letters and white space."""
    chars = np.arange(0x110000, dtype="<u4").view("<U1")
    return ~(np.char.islower(chars) | np.char.isspace(chars))


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points of all texts, where the units begin, each unit's text). Every text has a unit."""
    joined = "\n".join(texts) + "\n"
    cp = runs.code_points(joined)
    n = len(cp)
    kind = runs.categories()[cp]
    space = kind == runs.SPACE
    place = np.arange(n)
    # For each place, the next and the last one that is no white space, and the last one that is no closing mark either.
    following = np.minimum.accumulate(np.where(space, n, place)[::-1])[::-1]
    closer = np.isin(cp, [ord(c) for c in CLOSERS])
    seen = np.maximum.accumulate(np.where(space, -1, place))
    inner = np.maximum.accumulate(np.where(space | closer, -1, place))
    is_end = np.isin(cp, [ord(c) for c in ENDS])
    starts_unit = _caseless_start()[cp]
    lead = np.flatnonzero(~space & np.append(True, space[:-1]))
    before, held = np.append(-1, seen[:-1])[lead], np.append(-1, inner[:-1])[lead]
    ended = (held >= 0) & is_end[np.maximum(held, 0)]
    breaks = np.concatenate([[0], np.cumsum(cp == 10)])
    lines = breaks[lead] - breaks[np.maximum(before + 1, 0)]
    begin = lead[(before < 0) | (ended & starts_unit[lead]) | ((lines > 0) & starts_unit[lead]) | (lines > 1)]
    # Full stops of scripts without blanks.
    strong = np.flatnonzero(np.isin(cp, [ord(c) for c in "।॥。！？"])) + 1
    strong = strong[(strong < n) & ~space[np.minimum(strong, n - 1)] & ~closer[np.minimum(strong, n - 1)]]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    heads = np.cumsum(sizes) - sizes
    begin = np.union1d(np.union1d(begin, strong), heads)
    folded = _folds()[cp]
    # Not seen characters, repeated blanks and third and later repetitions of a letter are left out.
    keep = folded != 0
    keep[1:] &= ~(space[1:] & space[:-1])
    keep[heads] = True
    keep[2:] &= ~((folded[2:] == folded[1:-1]) & (folded[2:] == folded[:-2]) & (folded[2:] > 0x39))
    kept = np.concatenate([[0], np.cumsum(keep)])
    folded = folded[keep]
    # A digit beside a letter stands for the letter it looks like; in numbers all digits are one.
    digit = (folded >= 0x30) & (folded <= 0x39)
    letter = _letters()[folded]
    beside = np.append(False, letter[:-1]) | np.append(letter[1:], False)
    folded = np.where(digit, np.where(beside, _LEET[np.where(digit, folded - 0x30, 0)], 0x30), folded).astype(np.uint32)
    return folded, kept[begin], np.searchsorted(heads, begin, side="right") - 1


def signed(table: np.ndarray) -> np.ndarray:
    """The table by hash and sign."""
    return np.stack([table, -table], axis=1).reshape(-1)


def features(cp: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, float]]:
    """(hash of the subsequence that begins at each place, weight) per pattern; the last places have none."""
    with np.errstate(over="ignore"):
        c = cp.astype(np.uint32)
        scaled = [c * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
        for pattern in PATTERNS:
            n = len(c) - pattern[-1]
            if n <= 0:
                continue
            h = scaled[0][:n] + np.uint32(len(pattern) * 0x165667B1)
            for k, at in enumerate(pattern[1:], 1):
                h = h + scaled[k][at : at + n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            # One bit more than the table has: the lowest one is the sign.
            yield h >> np.uint32(31 - bits), DECAY ** (pattern[-1] + 1 - len(pattern))


def _padded(cp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units parted by four zeros, so that no subsequence joins two: (code points, begins, ends)."""
    at = np.arange(len(cp))
    number = np.searchsorted(begin, at, side="right") - 1
    out = np.zeros(len(cp) + 4 * len(begin), cp.dtype)
    out[at + 4 * number] = cp
    first = begin + 4 * np.arange(len(begin))
    return out, first, np.append(first[1:], len(out))


def norms(lengths: np.ndarray) -> np.ndarray:
    """The kernel's norm of a unit: as if its subsequences were all different."""
    weight = sum(DECAY ** (2 * (p[-1] + 1 - len(p))) for p in PATTERNS)
    return np.sqrt(np.maximum(lengths, SHORTEST) * weight)


def _decisions(text: np.ndarray, first: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(text), np.float32)
    by_sign = signed(table)
    for h, weight in features(text, int(len(table)).bit_length() - 1):
        total[: len(h)] += by_sign[h] * np.float32(weight)
    # Subsequences that reach into the padding are part of the unit, here as in the fit; those that begin in it aren't.
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    return (sums[ends - 4] - sums[first]) / norms(ends - first - 4)


def unit_scores(cp: np.ndarray, begin: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The decision for every unit."""
    return _decisions(*_padded(cp, begin), table) + bias


def document_scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The highest decision of a document's units."""
    cp, begin, owner = units(texts)
    scores = unit_scores(cp, begin, table, bias)
    out = np.full(len(texts), -np.inf)
    np.maximum.at(out, owner, scores)
    return out


class Units:
    """The units of labelled documents as hashed feature rows."""

    def __init__(self, texts: list[str], bits: int = BITS):
        self.bits = bits
        parts: list[tuple] = []
        at = 0
        for low, own in runs.slices(texts, SLICE):
            cp, begin, owner = units(own)
            text, first, ends = _padded(cp, begin)
            parts.append((text, first + at, ends + at, owner + low))
            at += len(text)
        self.text, self.first, self.ends, self.owner = (np.concatenate(p) for p in zip(*parts))
        self.n = len(self.first)
        self.norms = norms(self.ends - self.first - 4)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The dense feature rows of some units."""
        size = self.ends[which] - self.first[which]
        at = np.repeat(self.first[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row = np.repeat(np.arange(len(which)), size)
        begins = np.arange(len(at)) < np.repeat(np.cumsum(size) - 4, size)
        places, weights = [], []
        for h, weight in features(self.text[at], self.bits):
            own = begins[: len(h)]
            h = h[own]
            places.append((row[: len(own)][own] << self.bits) + (h >> np.uint32(1)))
            weights.append(np.where(h & np.uint32(1), -weight, weight))
        if not places:
            return np.zeros((len(which), 1 << self.bits), np.float32)
        out = np.bincount(np.concatenate(places), np.concatenate(weights), len(which) << self.bits)
        return (out.reshape(len(which), -1) / self.norms[which][:, None]).astype(np.float32)

    def kernel(self, which: np.ndarray, landmarks: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
        """k(unit, landmark) of some units, times ``then``."""
        marks = self.rows(landmarks).T
        marks = np.ascontiguousarray(marks if then is None else marks @ then, dtype=np.float32)
        out = np.empty((len(which), marks.shape[1]), np.float32)
        for a in range(0, len(which), 128):
            out[a : a + 128] = self.rows(which[a : a + 128]) @ marks
        return out

    def scores(self, table: np.ndarray) -> np.ndarray:
        """The decision of all units, without bias."""
        cuts = [*np.searchsorted(self.ends, np.arange(0, len(self.text), SLICE)).tolist(), self.n]
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                at = self.first[low]
                parts.append(_decisions(self.text[at : self.ends[high - 1]], self.first[low:high] - at, self.ends[low:high] - at, table))
        return np.concatenate(parts)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, start: np.ndarray | None = None, steps: int = 6, block: int = 4096) -> np.ndarray:
    """The primal SVM of weighted rows by Newton steps, summed over blocks of rows; the last coefficient is the bias."""
    n = x.shape[1] + 1
    w = np.zeros(n) if start is None else start
    penalty = np.append(np.full(n - 1, ridge), ridge * 1e-3)
    for _ in range(steps):
        second, first = np.diag(penalty), np.zeros(n)
        for at in range(0, len(x), block):
            a = np.concatenate([x[at : at + block], np.ones((len(x[at : at + block]), 1))], axis=1)
            # Rows beyond the margin have no part in the step.
            active = np.flatnonzero(y[at : at + block] * (a @ w) < 1)
            a, mass = a[active], weight[at : at + block][active]
            second += a.T @ (a * mass[:, None])
            first += a.T @ (mass * y[at : at + block][active])
        new = np.linalg.solve(second, first)
        if np.abs(new - w).max() < 1e-5:
            return new
        w = new
    return w


def _top(owner: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, owner, score)
    return out


def _threshold(top: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of best F1."""
    order = np.argsort(-top, kind="stable")
    right = np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(np.argmax(f1))
    return float((top[order[best]] + top[order[min(best + 1, len(order) - 1)]]) / 2)


def fit(texts: list[str], labels: np.ndarray, most_units: int = MOST_UNITS, landmarks: int = LANDMARKS, bits: int = BITS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weight of every hashed subsequence, bias) from documents and their labels (0 or 1)."""
    if len(texts) == 0 or labels.min() == labels.max():
        return np.zeros(1 << bits, np.float32), 0.0
    random = np.random.default_rng(seed)
    own = Units(texts, bits)
    n = len(texts)
    fold = (random.permutation(n) % FOLDS)[own.owner]
    bad = labels[own.owner] == 1
    # The working set: units of documents labelled 1, and of those labelled 0 at first any, then the worst.
    plus, minus = random.permutation(np.flatnonzero(bad)), random.permutation(np.flatnonzero(~bad))
    work = np.sort(np.concatenate([plus[: most_units // 2], minus[: most_units // 4]]))
    chosen = bad.copy()
    score = random.random(own.n)
    for turn in range(TURNS):
        inside = np.zeros(own.n, bool)
        inside[work] = True
        # Landmarks: of the chosen units, of the worst units of documents labelled 0, and of all others.
        half = random.permutation(np.flatnonzero(chosen & inside))[: landmarks // 2]
        zero = np.flatnonzero(~bad & inside)
        hard = zero[np.argsort(-score[zero], kind="stable")[: landmarks // 4]]
        marks = np.unique(np.concatenate([half, hard, random.permutation(zero)[: landmarks // 4]]))
        values, vectors = np.linalg.eigh(own.kernel(marks, marks).astype(np.float64) + 1e-6 * np.eye(len(marks)))
        root = (vectors / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T
        mapped = own.kernel(work, marks, root)
        known, part = bad[work], fold[work]
        w = None
        # Twice by turn: the units chosen by the first pass teach the second.
        for _ in range(2):
            held = np.empty(len(work))
            for f in range(FOLDS):
                w = _train(mapped, chosen[work], known, part != f, w)
                held[part == f] = mapped[part == f] @ w[:-1] + w[-1]
            top = _top(own.owner[work], held, n)
            bound = np.quantile(top[(labels == 0) & np.isfinite(top)], ABOVE)
            chosen = np.zeros(own.n, bool)
            chosen[work[known & (held > bound)]] = True
            if not chosen.any():
                chosen[work[known & (held == top[own.owner[work]])]] = True
        w = _train(mapped, chosen[work], known, np.ones(len(work), bool), w)
        table = (own.rows(marks).T @ (root @ w[:-1])).astype(np.float32)
        score = own.scores(table) + w[-1]
        if turn + 1 < TURNS:
            rest = np.flatnonzero(~bad & ~inside)
            worst = rest[np.argsort(-score[rest], kind="stable")[: most_units // 4 // (TURNS - 1)]]
            work = np.sort(np.concatenate([work, worst]))
    # The threshold: by held-out decisions for the working set, by the model for what it didn't see.
    score[work] = held
    return table, float(w[-1]) - _threshold(_top(own.owner, score, n), labels)


def _train(mapped: np.ndarray, chosen: np.ndarray, bad: np.ndarray, use: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    rows = np.flatnonzero(use & (chosen | ~bad))
    y = np.where(chosen[rows], 1.0, -1.0)
    share = max(chosen[rows].mean(), 1e-9)
    # Between equal weight of the classes and equal weight of the units.
    weight = np.where(chosen[rows], share**-0.5, (1 - share) ** -0.5)
    return squared_hinge(mapped[rows], y, weight / weight.sum(), RIDGE, start)


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents and ``most_characters`` of text, drawn by a hash of the id.

    Only labels of documents that are there and have a text are drawn from. A document that comes several times counts
    once, with its smallest text; one longer than a hundredth of ``most_characters`` isn't drawn.
    """
    votes = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("mean")).select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("label"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null and doc_id is not null")
    # Sizes first, so that only the texts drawn are shuffled; copies of a document fall together before the shuffle.
    sized = texts.select("doc_id", F.length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size")).filter(F.col("size") <= most_characters // 100)
    drawn = sized.join(votes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # A running sum over the rows drawn, at most ``most``.
    within = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("sum", F.sum("size").over(within)).filter(F.col("sum") <= most_characters).select("doc_id", "label")
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def model(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_units: int = MOST_UNITS) -> tuple[np.ndarray, float]:
    """The weights and the bias. The rows drawn, a bounded number, go to one task that fits them; the driver gets the weights only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        table, bias = fit([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), most_units)
        yield pa.RecordBatch.from_arrays([pa.array([table.astype(np.float32).tobytes()]), pa.array([bias])], ["weights", "bias"])

    found = labelled(documents, labels, most).repartition(1).mapInArrow(work, "weights binary, bias double").collect()
    return (np.frombuffer(bytes(found[0][0]), np.float32), found[0][1]) if found else (np.zeros(1 << BITS, np.float32), 0.0)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document; a score above 0 is flagged."""
    table, bias = model(documents, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs.slices(batch.column(2).to_pylist(), SLICE):
                found = document_scores(texts, table, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(np.round(found, 6)), pa.array(found > 0)], ["doc_id", "source", "score", "flagged"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(work, "doc_id bigint, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones and their share."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
