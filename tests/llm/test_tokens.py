"""Byte-level BPE and packing: against the tokenizer library, and round trips."""

import base64

import corpus_pipeline
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import BPE, no_docs, odd_docs, odd_rows

from faultsift.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    with open(BPE[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library_and_decode(spark, library):
    tokens = bpe.encode(odd_docs(spark), *BPE, carry=("doc_id", "text", "ids"))
    assert tokens.columns == ["doc_id", "text", "ids"]
    rows = bpe.decode(tokens, BPE[0], carry=("text", "ids")).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(no_docs(spark), *BPE), BPE[0]).count() == 0


def test_one_map_encodes_and_decodes(spark):
    both = bpe.encode(odd_docs(spark), *BPE, carry=("text", "decoded"), decoded=True)
    apart = bpe.decode(bpe.encode(odd_docs(spark), *BPE, carry=("text",)), BPE[0], carry=("text", "ids"))
    assert both.columns == apart.columns == ["text", "ids", "decoded"]
    assert both.exceptAll(apart).isEmpty() and both.count() == len(odd_rows())


def test_the_pipeline_encodes_and_decodes_in_one_worker_a_task(spark, capsys):
    corpus_pipeline.byte_level_bpe(spark, odd_docs(spark), "").explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text_matches_the_library(library, text):
    encoder = bpe.Encoder(bpe.vocabulary(*BPE))
    ids, counts = encoder.encode([text, "", text])
    want = library.encode_ordinary(text)
    assert counts.tolist() == [len(want), 0, len(want)] and ids.tolist() == want * 2


def test_long_pieces_and_matrices_merge_alike(library):
    vocab = bpe.vocabulary(*BPE)
    random = np.random.default_rng(0)
    pieces = ["".join(random.choice(list("abehtnoing"), n)).encode() for n in (2, 30, 200, 256, 257, 900)] + [b"e" * 1000]
    ids, counts = vocab.encode_pieces(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == vocab._merge_long(piece) == library.encode_ordinary(piece.decode())


def test_pack_loses_nothing(spark):
    docs = odd_docs(spark).where("doc_id IS NOT NULL AND NOT (doc_id = 2)")
    packed = packing.pack(docs, length=64, text_column="text")
    for r in packed.collect():
        marks, place = r["cu_seqlens"], np.frombuffer(r["positions"], "<u2")
        assert marks[0] == 0 and len(r["doc_ids"]) == len(r["starts"]) == len(marks) - 1
        assert len(place) == 64 == len(np.frombuffer(r["ids"], "<u2"))
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            assert place[a:b].tolist() == list(range(b - a))
    whole: dict = {}
    for r in packing.unpack(packed, length=64).collect():
        whole.setdefault(r["doc_id"], {})[r["start"]] = r["tokens"]
    for r in docs.collect():
        ids = [t for start in sorted(whole[r["doc_id"]]) for t in whole[r["doc_id"]][start]]
        assert ids == [*(r["text"] or "").encode(), packing.END_OF_TEXT]
    assert packing.pack(no_docs(spark), text_column="text").count() == 0


def test_pack_of_token_ids_counts_repeated_and_null_rows(spark):
    tokens = bpe.encode(odd_docs(spark), *BPE)
    packed = packing.pack(tokens, length=32, ids_column="ids", end_id=50256, vocabulary=50257)
    segments = packing.unpack(packed, length=32, vocabulary=50257)
    total = sum(len(r["tokens"]) for r in segments.collect())
    assert total == sum(len(r["ids"]) + 1 for r in tokens.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_takes_the_fullest_row_that_holds_the_piece(sizes):
    rows = packing.best_fit_decreasing(np.array(sizes, np.int64), 40)
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = min((r for r in room if r >= sizes[i]), default=None)
        if rows[i] == len(room):
            assert fit is None
            room.append(40)
        else:
            assert room[rows[i]] == fit
        room[rows[i]] -= sizes[i]
