"""Work that corpus queries must not do more than once, and bounds of what a task holds."""

import contextlib
import io
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from limpid.llm import collocations, decontaminate, prefix_bpe, token_files, tokens
from limpid.llm.common import WORD, lower_ascii
from limpid.llm.ngram_prints import Prints


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(True)
    return out.getvalue()


def test_decontamination_cuts_texts_once(spark, edge):
    items = spark.createDataFrame([(1, "mit license cc by 4 0")], "item_id long, text string")
    plan = _plan(decontaminate.judge(edge, items))
    assert "regexp" not in plan and "translate(" not in plan and "split(" not in plan


def test_words_are_cut_as_the_word_rule_says(spark, edge):
    odd = spark.createDataFrame([("",), (None,), ("...",), ("\x00a\x7fB\x80c",), (" lead",), ("trail ",), ("Ä😀x-ÿ@Z[z`{|}~",), ("a,b",)], "text string")
    texts = edge.select("text").unionByName(odd)
    by_rule = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
    assert texts.where(decontaminate.words(F.col("text")) != by_rule).count() == 0


def test_fingerprints_are_held_about_once(monkeypatch):
    held = 600_000
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "SLICE", 1 << 16)
    texts = [" ".join(f"w{i}x{k}" for k in range(900)) for i in range(500)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 500), pa.array(texts), pa.array(np.arange(500))], names=["lang", "text", "key"])
    prints = Prints()
    list(collocations._fingerprints(prints, prints.span)(iter([batch.slice(0, 5)])))  # tables of powers
    tracemalloc.start()
    rows = sum(r.num_rows for r in collocations._fingerprints(prints, prints.span // 8 + 1)(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows >= 2 * 3 * 8
    assert peak < 40 * held


def test_pieces_of_late_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(prefix_bpe, "CACHE_ENTRIES", 100)
    monkeypatch.setattr(token_files, "CACHE_PIECES", 100)
    first, second = (" ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for i in range(90)) for w in ("vx", "kw"))
    for made, work in (
        (prefix_bpe.PrefixEncoder(prefix_bpe.load_ranks(public_tokenizers.path(tokens.RANKS)), public_tokenizers.PATTERN), "extend"),
        (token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER)), "_piece"),
    ):
        given = [made.pack_all([first]), made.pack_all([second])]
        done, calls = getattr(made, work), []
        monkeypatch.setattr(made, work, lambda *a, done=done, calls=calls: calls.append(a) or done(*a))
        assert [made.pack_all([second]), made.pack_all([first])] == given[::-1]
        assert not calls
