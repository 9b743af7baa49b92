"""The registered queries on the smallest tables: against SQL where there is some, else brute force."""

import base64
import collections
import hashlib
import math
import zlib

import pytest
import tiktoken
from tests.llm.fixtures import BPE
from tests.llm.test_models import tokens
from tests.llm.test_neardup import brute_classes

from faultsift.llm import packing
from faultsift.llm.queries import END_ID, QUERIES
from faultsift.llm.statements import STATEMENTS
from oracle.compare import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op7_near_duplicates": "doc_id bigint, class_id bigint, class_size bigint",
    "op8_packed_ids": "pack_id bigint, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>",
    "op9_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
                          "runs_sha256 string, collapsed_sha256 string",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint"}


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_against_sql(spark, name):
    ok, note = compare(spark, name, QUERIES[name], STATEMENTS[name], SF, connect(SF))
    assert ok and "types agree" in note, note


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    found = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == COLUMNS[name]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_byte_bpe(spark, texts):
    with open(BPE[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    rows = QUERIES["op2_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = library.encode_ordinary(texts[r["doc_id"]] or ""), (texts[r["doc_id"]] or "").encode()
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                hashlib.sha256(text).hexdigest())


def test_near_duplicates(spark, texts):
    want = {i: (c[0][1], len(c)) for c in brute_classes(list(texts.items())) for _, i in c}
    assert {r[0]: (r[1], r[2]) for r in QUERIES["op7_near_duplicates"](spark, SF).collect()} == want


def test_lm_scoring(spark, texts):
    own = {i: tokens(t) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    count = collections.Counter(t for i, ts in own.items() if not held[i] for t in ts)
    total = sum(count.values())
    for r in QUERIES["op9_lm_scoring"](spark, SF).collect():
        ts = own[r["doc_id"]]
        assert tuple(r)[1:5] == (held[r["doc_id"]], len(ts), sum(count[t] > 0 for t in ts), total)
        base = sum(math.log10((count[t] + 1) / (total + len(count) + 1)) for t in ts)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


def test_packed_rows_hold_the_token_ids(spark, texts):
    with open(BPE[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    assert max(ranks.values()) == END_ID - 1
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=ranks, special_tokens={})
    whole: dict = {}
    for r in packing.unpack(QUERIES["op8_packed_ids"](spark, SF), vocabulary=END_ID + 1).collect():
        whole.setdefault(r["doc_id"], {})[r["start"]] = r["tokens"]
    assert len(whole) == len(texts)
    for i, t in texts.items():
        ids = [x for start in sorted(whole[i]) for x in whole[i][start]]
        assert ids == [*library.encode_ordinary(t or ""), END_ID]
