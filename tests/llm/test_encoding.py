import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import encoding as E

JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not (os.path.exists(E.RANKS) and os.path.exists(JSON)), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def lexicon(words):
    own = E.tokenizer(E.RANKS)
    return E.Lexicon(E.Lexicon.build({w.encode(): own.encode_ordinary(w) for w in words}))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="a'sdtmrevlLZ  \n\t\xa0　9½éक्ा中.,!😀<|endoftext|>", max_size=25), max_size=5))
def test_ids_are_those_of_the_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert E.ids_of(texts, lexicon(["a", " a", "'s", ".", "  "]), E.RANKS).to_pylist() == want


def test_automaton_numbers_its_words():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(300)})
    built = lexicon(words)
    import numpy as np
    import pyarrow as pa

    asked = pa.array(words + ["", "abcabcabcabc", "d", "a" * 40])
    offsets = np.frombuffer(asked.buffers()[1], np.int32)[: len(asked) + 1].astype(np.int64)
    got = built.numbers(np.frombuffer(asked.buffers()[2], np.uint8), offsets)
    assert got.tolist() == list(range(len(words))) + [-1] * 4
    # Shared suffixes: fewer states than a tree of prefixes has.
    assert built.states < len({w[:i] for w in words for i in range(len(w) + 1)})


def test_documents(spark, public):
    texts = ["Hello world, it's fine.", None, "", "  \n ", "Grüße 中文 <|endoftext|>", "x" * 30_000, "Hello world"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in E.encode(df, lexicon=5).collect()}
    assert got == dict(enumerate(public([t or "" for t in texts])))
    assert got[1] == [] and got[2] == []
    assert E.decode(got[4]) == texts[4]
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
