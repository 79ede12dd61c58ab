from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.cases import documents, frame

from tidemark.llm import token_counts, token_output, tokens

ENCODER = tokens.WordEncoder(tokens.vocabulary("word_bpe_49k.json"))


def whole(text: str | None) -> list[int]:
    return ENCODER.own.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \n\t.,'~ABHJWhjwý̱<|>")), max_size=40), max_size=4))
def test_word_encoder_equals_whole_texts(texts):
    assert [x.tolist() for x in ENCODER(texts)] == [whole(t) for t in texts]


def test_special_strings():
    texts = ["a<|endoftext|>b", "<|STARTOFTEXT|> x", "x <|startoftext|> y. z", "~ a ~~ b~", "It's. THEY'LL, no."]
    assert [x.tolist() for x in ENCODER(texts)] == [whole(t) for t in texts]


class Recorder:
    """The library's encoder, and all strings that it was given."""

    def __init__(self, own):
        self.own, self.given = own, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.own.encode_batch_fast(texts, **options)

    def encode(self, text, **options):
        return self.own.encode(text, **options)


def test_words_are_encoded_once_side_by_side():
    encoder = tokens.WordEncoder(tokens.vocabulary("word_bpe_49k.json"))
    encoder.own = Recorder(encoder.own)
    texts = pa.array(["Red green", None, "green\tred. blue", "blue, red4 don't", "\u0130stanbul \u00e9t\u00e9 stra\u00dfe e\u0301"], pa.string())
    assert [x.tolist() for x in encoder(texts[:3])] == [whole(t) for t in texts[:3].to_pylist()]
    words, *rest = encoder.own.given
    assert words == "blue green red" and rest == ["."]  # letters without a sign between them
    assert [x.tolist() for x in encoder(texts)] == [whole(t) for t in texts.to_pylist()]
    given = " ".join(encoder.own.given).split(" ")
    assert max(Counter(c for c in given if c != "~").values()) == 1


def test_pairs_of_one_slot_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_output, "SLOTS", 2)  # four slots for all pairs
    ids = np.random.default_rng(5).integers(0, 9, 3000, dtype=np.uint32)
    grammar = token_output.repair(ids, 9)
    assert max(occurrences(grammar.symbols.tolist()).values()) < token_output.LEAST
    assert grammar.expand(grammar.symbols)[0].tolist() == ids.tolist() == grammar.spelled().tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.sampled_from([6, 49408, 65536, 100_000]))
def test_blocks_round_trip(docs, vocabulary):
    docs = [np.array(d, np.uint32) for d in docs]
    block = token_output.Block(token_output.pack(docs, vocabulary))
    assert block.ids().tolist() == [x for d in docs for x in d]
    assert [block.document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]


def occurrences(symbols: list[int]) -> Counter:
    """Of each pair of neighbours, the most places that do not overlap."""
    out, last = Counter(), {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair, -2) < i - 1:
            out[pair] += 1
            last[pair] = i
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(1, 12))
def test_no_pair_is_left_that_pays(ids, copies):
    ids = np.tile(np.array(ids, np.uint32), copies)
    whole_pairs = token_output.repair(ids, 7)
    assert max(occurrences(whole_pairs.symbols.tolist()).values(), default=0) < token_output.LEAST
    assert len(np.unique(whole_pairs.flat.reshape(-1, 2), axis=0)) == len(whole_pairs.sizes)  # one rule for a pair
    for grammar in (whole_pairs, token_output.compress(ids, 7), token_output.compress(ids, 7).ordered()[0]):
        assert grammar.expand(grammar.symbols)[0].tolist() == ids.tolist()
    uses, sizes = grammar.uses(), grammar.sizes
    assert (uses >= 2).all() and (uses * (sizes - 1) > sizes).all()
    assert len(grammar.flat) + len(grammar.symbols) <= len(ids)


def test_passages_become_one_symbol():
    draw = np.random.default_rng(3)
    passage = draw.integers(0, 40_000, 1000, dtype=np.uint32)
    ids = np.concatenate([x for _ in range(50) for x in (passage, draw.integers(0, 40_000, 30, dtype=np.uint32))])
    grammar = token_output.compress(ids, 49408)
    assert len(grammar.symbols) <= 50 * 33 and len(grammar.flat) <= 1100


def test_token_output(spark):
    rows = documents()
    got = token_output.read_back(token_output.encoded(frame(spark, rows), block=64)).collect()
    ids = [[*whole(r[1]), 2] for r in rows]
    want = sorted((str(r[0]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.id or -1 for r in got] == sorted(r.id or -1 for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert token_output.read_back(token_output.encoded(frame(spark, rows).limit(0))).count() == 0
    same = spark.createDataFrame([(None, f"text {i}") for i in range(40)], "doc_id long, text string")
    got = token_output.read_back(token_output.encoded(same, block=8)).collect()
    assert len(got) == 40 and len({r.start for r in got}) == 40


def test_flat_files(spark, tmp_path):
    draw = np.random.default_rng(8)
    for width, kind in ((2, "<u2"), (4, "<u4")):
        folder, want = tmp_path / str(width), []
        folder.mkdir()
        for name in ("a.bin", "b.bin", "c.bin"):
            docs = [draw.integers(0, 9, n).tolist() for n in draw.integers(0, 40, 30)] if name != "c.bin" else []
            (folder / name).write_bytes(np.array([x for d in docs for x in (*d, 9)] + ([1, 2] if name == "b.bin" else []), kind).tobytes())
            want += [(name, i, sum(len(d) + 1 for d in docs[:i]), len(d)) for i, d in enumerate(docs)]
        for block in (1, 7, 4096):
            got = token_counts.scan(token_counts.flat_files(spark, str(folder), block, width), 9, width).collect()
            assert sorted((r.file.rsplit("/", 1)[1], r.number, r.start, r.n_tokens) for r in got) == want


def test_widths_and_ends_are_checked(spark, tmp_path):
    docs = frame(spark, documents(3)[:3])
    with pytest.raises(ValueError, match="end id"):
        token_counts.count_tokens(docs, end=17)
    with pytest.raises(ValueError, match="fit"):
        token_counts.count_tokens(docs, end=1 << 16)
    wide = token_counts.count_tokens(docs, end=1 << 16, width=4).collect()
    assert sorted((r.id, r.n_tokens) for r in wide) == sorted((r.id, r.n_tokens) for r in token_counts.count_tokens(docs).collect())


def test_token_counts(spark):
    rows = documents()
    encode = tokens.byte_encoder(tokens.vocabulary("byte_bpe_50k.tiktoken"))
    want = sorted((str(r[0]), len(encode(r[1] or ""))) for r in rows)
    for block in (1, 7, 1 << 18):
        if block == 1:
            small = [r for r in rows if len(r[1] or "") < 1000]
            got = token_counts.count_tokens(frame(spark, small), block=block).collect()
            assert sorted((str(r.id), r.n_tokens) for r in got) == sorted((str(r[0]), len(encode(r[1] or ""))) for r in small)
        else:
            got = token_counts.count_tokens(frame(spark, rows), block=block).collect()
            assert sorted((str(r.id), r.n_tokens) for r in got) == want
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.file, r.start)):
        assert r.start == by.get(r.file, 0)
        by[r.file] = r.start + r.n_tokens + 1
    assert token_counts.count_tokens(frame(spark, rows).limit(0)).count() == 0
