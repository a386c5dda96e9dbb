import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from limpid.llm import tokens
from limpid.llm.prefix_bpe import EncodedText, encoder
from limpid.llm.queries import QUERIES
from plain import multiset, sha

PATH = public_tokenizers.path(tokens.RANKS)


@pytest.fixture(scope="module")
def own():
    return encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


PARTS = ["a", "B", "é", "ß", "  ", " ", "\n", "\t", "\x1c", "\x85", "the", "ing", "1", "23", "'s", "'re", "!!", "😀", "数据", "=", "<|endoftext|>", "́"]


def test_texts_equal_the_library(own, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(500)] + ["a" * 3000, " " * 3000, "=-" * 2000]
    assert own.pack_all(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_every_code_point_is_cut_like_the_library(own, library):
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{p}1 {p}{p}." for p in points]
    assert own.pack_all(texts) == [packed(library.encode_ordinary(t)) for t in texts]


def test_appends_and_edits_equal_encoding_anew(own, library):
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        live = EncodedText(own, text)
        for _ in range(3):
            a = rng.randint(0, len(text))
            b, put = rng.randint(a, len(text)), rng.choice(["", "x", " the", "\n\n", "ing 1", "é"])
            text = text[:a] + put + text[b:]
            live.splice(a, b, put)
            assert live.ids() == library.encode_ordinary(text)
        live.append("er s")
        assert live.ids() == library.encode_ordinary(text + "er s")


def test_tables_are_mended_near_an_edit(own):
    rng = random.Random(5)
    for _ in range(100):
        piece = "".join(rng.choice("abcdeing") for _ in range(400)).encode()
        a = rng.randint(0, 300)
        b, put = a + rng.randint(0, 9), rng.choice([b"", b"x", b"ing"])
        new, table = own.edit(piece, own.extend(piece, []), a, b, put)
        assert new == piece[:a] + put + piece[b:] and table == own.extend(new, [])


def test_query_equals_the_library(spark, sf, docs, library):
    expected = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), sha(packed(ids)), sha((r.text or "").encode())))
    assert multiset(map(tuple, QUERIES["op2_byte_bpe"](spark, sf).collect())) == multiset(expected)


def test_edges(edge, nothing, library):
    rows = tokens.decode(tokens.encode(edge)).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(tokens.encode_and_decode(edge).collect(), key=key) == sorted(rows, key=key)
    assert len(rows) == edge.count()
    for r in rows:
        assert bytes(r.ids) == packed(library.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    assert tokens.decode(tokens.encode(nothing)).count() == 0
