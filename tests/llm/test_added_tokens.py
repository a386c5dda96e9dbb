"""Token files against the unchanged library, where texts hold its added tokens."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from limpid.llm import token_files
from limpid.llm.queries import QUERIES

TEXTS = [
    "a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>Y", "<|ENDOFTEXT|>", "<|endoftext|", "\u00fc <|startoftext|>\u6570", "plain", "", None,
]


def test_query_equals_the_unchanged_library(spark, tmp_path):
    library, start, expected = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER)), 0, []
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, QUERIES["op8_token_files"](spark, str(tmp_path)).collect())) == expected
