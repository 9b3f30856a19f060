"""Token counts and byte-level BPE against the libraries; WARC round trips."""

import base64
import hashlib
import io
import gzip

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspark.llm import byte_bpe, queries, token_counts, warc

from .conftest import EDGE

MODEL = P.path("piece_bpe_32k.model")
ODD = st.text(st.sampled_from("ab é▁ \t\n😀.,'s1"), max_size=40)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(edge, empty, pieces):
    rows = token_counts.count_tokens(edge, MODEL, 4096).collect()
    want = sorted((len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for _, t, *_ in EDGE)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.count_tokens(empty, MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pre_tokens_add_up(text):
    model = token_counts._model(MODEL)
    assert sum(token_counts._lengths(model, token_counts.pre_tokens(text)) if text else []) == len(model.encode(text))


@pytest.mark.parametrize("chunk, overlap", [(16384, 512), (32, 12), (7, 5)])
def test_bpe_round_trip(edge, bpe, chunk, overlap):
    rows = byte_bpe.encode(edge.where("doc_id IS NULL OR doc_id NOT IN (8, 10)") if chunk < 100 else edge, queries.RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = []
    for i, t, *_ in EDGE:
        if chunk >= 100 or i not in (8, 10):
            ids = np.asarray(bpe.encode_ordinary(t or ""), "<u4").tobytes()
            want.append((str(i), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in rows)


def test_bpe_decode_and_empty(edge, empty):
    encoded = byte_bpe.encode(edge, queries.RANKS, P.PATTERN)
    texts = sorted(bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, queries.RANKS, P.PATTERN).collect())
    assert texts == sorted(t or "" for _, t, *_ in EDGE)
    assert byte_bpe.round_trip(empty, queries.RANKS, P.PATTERN).count() == 0


def test_bpe_survives_what_the_library_does_not(bpe):
    codec = byte_bpe.Codec.of(queries.RANKS, P.PATTERN)
    text = "a" + " " * 5000 + "b"
    assert codec.decode(codec.encode(text)) == text.encode()


def test_warc(spark):
    pages = [(1, "u1", "<p>same</p>"), (2, "u2", "<p>same</p>"), (3, "u\r\n3", "é" * 100000), (4, None, None), (5, "u5", ""), (None, "u6", "<p>same</p>"), (2, "u2", "<p>same</p>"), (7, "u7", "only")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    rows = warc.write_and_read(df).collect()
    assert len(rows) == len(pages)
    texts = {i: (t or "").encode() for i, _, t in pages}
    for r in rows:
        assert r.payload_bytes == len(texts[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(texts[r.page_id]).digest()).decode()
        best = max(i for i, t in texts.items() if t == texts[r.page_id] and i is not None)
        assert (r.refers_to == best) if r.record_type == "revisit" else (r.page_id == best and r.refers_to is None)
    assert sum(r.record_type == "response" for r in rows) == len(set(texts.values()))
    assert {r.record_type for r in warc.write_and_read(df, min_bytes=1000).collect()} == {"response"}
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_warc_reader_is_strict():
    good = warc.record(1, "u", b"payload" * 50000, "response", None, "2024-01-01T00:00:00Z")
    two = good + warc.record(2, "v", b"payload", "revisit", 1, "2024-01-01T00:00:00Z")
    read = list(warc.read_records(io.BytesIO(two), with_payload=True))
    assert [r["page_id"] for r in read] == [1, 2] and read[0]["payload"] == b"payload" * 50000 and read[1]["payload"] is None
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(good).replace(b"payload", b"pAyload", 1)))))
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\nWARC-Type: response")
