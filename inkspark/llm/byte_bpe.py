"""Byte-level BPE of whole texts with a rank file, and back (operator 9).

Texts of at most CHUNK characters are encoded as they are. Longer ones are cut into chunks that overlap by OVERLAP
characters, and the chunks are dealt over the cluster:

1. each chunk is pre-tokenised and encoded by itself. The pattern has no memory, so once a boundary found from an arbitrary
   start coincides with a true one, all further boundaries are true;
2. chunks pass on their ids, and the boundaries in both overlaps with their places in the ids: texts are shuffled once;
3. a text's chunks are stitched at the first boundary that neighbours both found in their overlap.

A text in which some neighbours share no boundary (such as a run of letters longer than the overlap) is put together
again from the bytes of its chunks' ids and encoded whole, so results are exact for every text. Decoding concatenates the
tokens' raw bytes.

A null text counts as empty and gives no ids. Repeated rows each give a row. An empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 512
#: A boundary needs so many characters behind it to be independent of the chunk's end (longest look-ahead: 'll).
AHEAD = 3

_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """One rank file and its pattern, loaded once in each worker."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "Codec":
        if (ranks_path, pattern) not in _codecs:
            _codecs[ranks_path, pattern] = cls(ranks_path, pattern)
        return _codecs[ranks_path, pattern]

    def encode(self, text: str) -> bytes:
        try:
            ids = self.encoding.encode_ordinary(text)
        except Exception:  # the library's pattern gives up on runs of about a million blanks; match by match it does not
            ids = [i for m in self.pattern.finditer(text) for i in self.encoding._encode_single_piece(m.group())]
        return np.asarray(ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    def starts(self, text: str) -> np.ndarray:
        return np.array([m.start() for m in self.pattern.finditer(text)], np.int64)

    def places(self, text: str, ids: bytes, at: np.ndarray) -> np.ndarray:
        """For boundaries ``at`` (characters), how many of the ids come before them."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        before = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        return np.searchsorted(np.cumsum(self.sizes[np.frombuffer(ids, "<u4")]), before[at], side="right")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _encoded(docs: DataFrame, text_col: str, id_col: str, codec: Callable[[], Codec], columns: dict[str, tuple], chunk: int, overlap: int) -> DataFrame:
    """A row for each document: the id, and of each column (kind, function of the codec and the ids)."""
    kind = dict(docs.dtypes)[id_col]
    out = f"id {kind}, " + ", ".join(f"{c} {t}" for c, (t, _, _) in columns.items())

    def results(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        made = [pa.array([f(codec(), x) for x in ids], t) for _, t, f in columns.values()]
        return pa.RecordBatch.from_arrays([keys, *made], names=["id", *columns])

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield results(part.column(0), [codec().encode(t) for t in part.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for first in range(0, len(text), 64 * chunk):
                    at = range(first, min(first + 64 * chunk, len(text)), chunk)
                    same = pa.array([i] * len(at), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array([a // chunk for a in at], pa.int32()), pa.array([text[a : a + chunk + overlap] for a in at], pa.string())],
                        names=["id", "row", "chunk", "text"],
                    )

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, zones = [], ([], [], [], [])
            for k, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids.append(codec().encode(text))
                starts = codec().starts(text)
                starts = starts[starts <= len(text) - AHEAD]
                for zone, at in zip((zones[:2], zones[2:]), (starts[starts < overlap], starts[starts >= chunk])):
                    zone[0].append(at + k * chunk)
                    zone[1].append(codec().places(text, ids[-1], at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary()), *(pa.array(z, pa.list_(pa.int64())) for z in zones)], names=["id", "row", "chunk", "ids", *parts])

    def stitched(pieces: list[dict]) -> bytes:
        start, made = 0, []
        for one, two in zip(pieces, pieces[1:]):
            known = dict(zip(one["tail"], one["tail_at"]))
            at = next((i for i, p in enumerate(two["head"]) if p in known), None)
            if at is None:
                return codec().encode("".join(codec().decode(p["ids"]).decode()[:chunk] for p in pieces))
            made.append(one["ids"][4 * start : 4 * known[two["head"][at]]])
            start = two["head_at"][at]
        return b"".join([*made, pieces[-1]["ids"][4 * start :]])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                yield results(part.column("id"), [stitched(p) for p in part.column("pieces").to_pylist()])

    parts = ("head", "head_at", "tail", "tail_at")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    whole = rows.where(~is_long).select("id", "text").mapInArrow(encode_whole, out)
    chunks = rows.where(is_long).mapInArrow(cut, f"id {kind}, row long, chunk int, text string").repartition("row", "chunk")
    chunks = chunks.mapInArrow(encode_chunks, f"id {kind}, row long, chunk int, ids binary, " + ", ".join(f"{p} array<long>" for p in parts))
    texts = chunks.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("chunk", "ids", *parts))).alias("pieces"))
    return whole.unionByName(texts.mapInArrow(put_together, out)).withColumnRenamed("id", id_col)


def _codec(ranks_path: str, pattern: str) -> Callable[[], Codec]:
    return lambda: Codec.of(ranks_path, pattern)


_N = ("long", pa.int64(), lambda _, ids: len(ids) // 4)
_IDS = ("binary", pa.binary(), lambda _, ids: ids)
_IDS_SHA = ("string", pa.string(), lambda _, ids: _sha(ids))
_DECODED_SHA = ("string", pa.string(), lambda codec, ids: _sha(codec.decode(ids)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each document: id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the decoded bytes."""
    columns = {"n_tokens": _N, "ids": _IDS, "ids_sha256": _IDS_SHA, "decoded_sha256": _DECODED_SHA}
    return _encoded(docs, text_col, id_col, _codec(ranks_path, pattern), columns, chunk, overlap)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """As encode(), without the ids."""
    columns = {"n_tokens": _N, "ids_sha256": _IDS_SHA, "decoded_sha256": _DECODED_SHA}
    return _encoded(docs, text_col, id_col, _codec(ranks_path, pattern), columns, chunk, overlap)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and the decoded bytes of each row of encode(). Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "decoded"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
