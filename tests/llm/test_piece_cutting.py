"""Pieces are cut as the tokenizer's expression says, and each is looked up once a batch, however often it stands there."""

import random

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from limpid.llm import token_files

RULE = regex.compile(r"[\p{L}]+|[\p{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s\p{L}\p{N}]+")
HAND = ["", " ", "'", "'s", "''s", "'s's", "'some", "'re", "'r", "'rex", "it's 'tis '12 '\n", "x'll'l", "\"'s 5'd", "'v", "'ve", "a\x1cb\x85c\xa0d", "'", "²³½ªº", "é'sé'r", "s", "'re've'm'll'd't"]


def random_texts():
    rng = random.Random(4)
    return ["".join(rng.choices("'''''stmdrevl'ae1 5\n.,\"é²ß\x85\xa0\x1c\0-", k=rng.randrange(40))) for _ in range(3_000)]


def test_pieces_are_cut_as_the_expression_says():
    every = "".join(map(chr, range(token_files.LATIN)))
    for texts in (HAND, HAND[::-1], random_texts(), [every, every[::-1]], [""], ["", ""], ["'"], ["a'r"], [" '"]):
        pieces, bounds = token_files.cut_pieces(texts)
        got = pieces.to_pylist()
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(got)
        assert [got[a:b] for a, b in zip(bounds, bounds[1:])] == [RULE.findall(t) for t in texts]


def test_ids_equal_the_library_around_apostrophes():
    own = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    library.encode_special_tokens = True
    texts = [*HAND, "数'据's", *random_texts()[:500]]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.pack_all(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


class Counted(dict):
    asked = 0

    def get(self, *a):
        Counted.asked += 1
        return super().get(*a)

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)


def test_a_piece_is_looked_up_once_a_batch():
    own = token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER))
    own.known = Counted()
    texts = ["one two three, 4 " * 200] * 20
    once = own.pack_all(texts[:1])[0]
    Counted.asked = 0
    assert own.pack_all(texts) == [once] * 20
    assert Counted.asked <= 5
