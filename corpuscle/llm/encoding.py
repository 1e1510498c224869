"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Frequent words, counted over all documents, are compiled into a minimal acyclic
automaton: common prefixes and suffixes share states, each transition carries how
many words lie before it, so the path of a word adds up to its number, and a table
gives the number's ids. The automaton is one file in the shared folder that Spark
hands to every executor once; workers map it into memory. Words it doesn't hold are
merged exactly by the tokenizer's own ranks.

The text is split before the merges by one numpy pass over code point classes that
follows the public pattern; each different piece of a slice is looked up once.

Defined cases: null and empty texts give an empty list; rows with a null doc_id
keep it; repeated rows stay; special tokens in the text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import runs
from corpuscle.session import shared_dir

#: The place of the public rank file, the same on every node.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words in the automaton (about 2 MB); all others are merged.
LEXICON = 50_000
#: Words longer than this many bytes are merged.
LONGEST = 32

# The public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_O, _L, _N, _S = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    c = runs.categories()
    return np.select([c == runs.LETTER, (c == runs.DIGIT) | (c == runs.NUMBER), c == runs.SPACE], [_L, _N, _S], _O).astype(np.uint8)


def piece_borders(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; ``starts`` marks the first code point of every text."""
    n = len(cp)
    kind = _classes()[cp]
    edge = starts.copy()
    edge[1:] |= kind[1:] != kind[:-1]
    begin = edge.copy()
    last = np.append(edge[1:], True)
    ends_text = np.append(starts[1:], True)
    # A run of white space before other text gives its last character to what follows, if that is a plain blank, or leaves it alone.
    tail = (kind == _S) & last & ~ends_text
    begin |= tail
    led = np.flatnonzero(tail & (cp == 0x20))
    begin[led + 1] = False
    # Contractions: a single quote mark that begins a piece, followed by one of seven endings.
    quote = np.flatnonzero((cp == 0x27) & begin & last & ~ends_text)
    quote = quote[quote + 1 < n]
    following = np.concatenate([cp, np.zeros(2, cp.dtype)])
    first, second = following[quote + 1], following[quote + 2]
    alone = np.append(starts, [True, True])[quote + 2]
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = ~one & ~alone & (((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
    for mask, length in ((one, 1), (two, 2)):
        own = quote[mask]
        begin[own + 1] = False
        own = own[own + 1 + length < n]
        begin[own + 1 + length] = True
    return np.append(np.flatnonzero(begin), n)


def split(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of pieces of each text, the pieces of all texts)."""
    joined = "".join(texts)
    cp = runs.code_points(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths) - lengths
    starts = np.zeros(len(cp), bool)
    starts[begins[lengths > 0]] = True
    if not len(cp):
        return np.zeros(len(texts), np.int64), pa.array([], pa.string()).dictionary_encode()
    borders = piece_borders(cp, starts)
    owner = np.searchsorted(begins + lengths, borders[:-1], side="right")
    return np.bincount(owner, minlength=len(texts)), runs.pieces(joined, cp, borders)


class Lexicon:
    """A minimal acyclic automaton over bytes that numbers its words, and the ids of each number."""

    def __init__(self, data: np.ndarray):
        head = data[:8].tolist()
        parts, at = [], 8
        for n in head[:5]:
            parts.append(data[at : at + n])
            at += n
        #: keys: state * 256 + byte, sorted; target and skip by transition; bounds and ids by word.
        self.keys, self.target, self.skip, self.bounds, self.ids = parts
        self.states = head[5]

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> np.ndarray:
        """The array of a lexicon. Words are added in order; a state that can't change any more is merged with its equal."""
        register: dict[tuple, int] = {}
        done: list[tuple] = []

        def freeze(node: list) -> int:
            # node: [final, [(byte, state), ...]]
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        order = sorted(w for w in words if w)
        path: list[list] = [[False, []]]
        before = b""
        for word in [*order, None]:
            same = 0
            if word is not None:
                limit = min(len(word), len(before))
                while same < limit and word[same] == before[same]:
                    same += 1
            while len(path) > same + 1:
                state = freeze(path.pop())
                path[-1][1].append((before[len(path) - 1], state))
            if word is not None:
                path.extend([False, []] for _ in word[same:])
                path[-1][0] = True
                before = word
        root = freeze(path[0])
        # The root becomes state 0; targets come before their sources in ``done``, so counts follow in one pass.
        number = lambda s: len(done) - 1 - s
        assert number(root) == 0
        count = [0] * len(done)
        rows = []
        for s, (final, moves) in enumerate(done):
            total = int(final)
            for byte, to in moves:
                rows.append((number(s) * 256 + byte, number(to), total))
                total += count[to]
            count[s] = total
        rows.sort()
        finals = np.array([done[len(done) - 1 - s][0] for s in range(len(done))], np.int64)
        table = np.array(rows, np.int64).reshape(-1, 3)
        lengths = np.fromiter((len(words[w]) for w in order), np.int64, len(order))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.fromiter((i for w in order for i in words[w]), np.int64, int(lengths.sum()))
        # A final state is kept as the sign of the target.
        target = np.where(finals[table[:, 1]] == 1, -table[:, 1] - 1, table[:, 1]) if len(table) else table[:, 1]
        head = np.array([len(table), len(table), len(table), len(bounds), len(ids), len(done), 0, 0], np.int64)
        return np.concatenate([head, table[:, 0], target, table[:, 2], bounds, ids])

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each word (bytes ``data`` between ``offsets``), -1 if it isn't held; all words step at once."""
        length = np.diff(offsets)
        out = np.full(len(length), -1, np.int64)
        if not len(self.keys):
            return out
        alive = np.flatnonzero((length > 0) & (length <= LONGEST))
        state = np.zeros(len(alive), np.int64)
        total = np.zeros(len(alive), np.int64)
        for step in range(LONGEST):
            if not len(alive):
                break
            key = state * 256 + data[offsets[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[at] == key
            alive, at, total = alive[held], at[held], total[held]
            total = total + self.skip[at]
            to = self.target[at]
            final = to < 0
            state = np.where(final, -to - 1, to)
            ends = length[alive] == step + 1
            out[alive[ends & final]] = total[ends & final]
            alive, state, total = alive[~ends], state[~ends], total[~ends]
        return out


@lru_cache(2)
def tokenizer(ranks: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})


@lru_cache(2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.memmap(SparkFiles.get(name), np.int64, "r"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in runs.slices(batch.column(0).to_pylist()):
            _, coded = split(texts)
            if len(coded):
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))], ["piece", "n"])


def frequent(documents: DataFrame, most: int = LEXICON) -> DataFrame:
    """The most frequent pieces of all documents, ties going to the smaller piece."""
    counts = documents.select("text").filter("text is not null").mapInArrow(_counted, "piece string, n bigint")
    return counts.filter(F.octet_length("piece") <= LONGEST).groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "piece").limit(most)


def publish(spark: SparkSession, words: list[str], ranks: str) -> str:
    """Compiles the words, writes the file to the shared folder and hands it to the executors; returns its name."""
    import hashlib

    own = tokenizer(ranks)
    data = Lexicon.build({w.encode(): own.encode_ordinary(w) for w in words}).tobytes()
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    place = f"{shared_dir(spark).rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        out = system.create(path, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(str(system.makeQualified(path)))
    return name


def ids_of(texts: list[str], lexicon: Lexicon, ranks: str) -> pa.ListArray:
    """The ids of each text."""
    per_text, coded = split(texts)
    found = coded.dictionary
    offsets = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1].astype(np.int64) if len(found) else np.zeros(1, np.int64)
    data = np.frombuffer(found.buffers()[2], np.uint8) if len(found) else np.zeros(0, np.uint8)
    number = lexicon.numbers(data, offsets)
    new = np.flatnonzero(number < 0)
    own = tokenizer(ranks)
    merged = [own.encode_ordinary(w) for w in found.take(pa.array(new)).to_pylist()]
    lengths = np.fromiter(map(len, merged), np.int64, len(merged))
    # Ids of the lexicon and then of the merged words in one row of values.
    values = np.concatenate([lexicon.ids, np.fromiter((i for m in merged for i in m), np.int64, int(lengths.sum()))])
    safe = np.maximum(number, 0)
    begin = np.where(number >= 0, lexicon.bounds[safe], 0)
    size = np.where(number >= 0, lexicon.bounds[safe + 1] - lexicon.bounds[safe], 0) if len(lexicon.bounds) > 1 else np.zeros(len(number), np.int64)
    begin[new], size[new] = len(lexicon.ids) + np.cumsum(lengths) - lengths, lengths
    code = coded.indices.to_numpy()
    each = size[code]
    total = np.cumsum(each)
    ids = values[np.repeat(begin[code] - (total - each), each) + np.arange(int(each.sum()))].astype(np.int32)
    text_ends = np.concatenate([[0], np.concatenate([[0], total])[np.cumsum(per_text)]])
    return pa.ListArray.from_arrays(pa.array(text_ends.astype(np.int32)), pa.array(ids))


def encode(documents: DataFrame, ranks: str = RANKS, lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, ids): one row per row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    name = publish(spark, [r[0] for r in frequent(own, lexicon).select("piece").collect()], ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs.slices(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids_of(texts, _mapped(name), ranks)], ["doc_id", "ids"])

    return own.mapInArrow(work, "doc_id bigint, ids array<int>")


def decode(ids: list[int], ranks: str = RANKS) -> str:
    """The text of ids."""
    return tokenizer(ranks).decode(ids)
