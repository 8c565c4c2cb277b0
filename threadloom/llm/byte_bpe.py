"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.arrow_rows import SLICE_ROWS, built_once, file_broadcast, slices
from threadloom.llm.chunks import PieceEncoder
from threadloom.llm.rank_queue import RankQueue
from threadloom.llm.registry import documents, query

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class ByteBpe:
    """Encoder and decoder for a rank file: lines of base64 bytes and rank."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())}
        by_id = dict(zip(self.ranks.values(), self.ranks))
        self.by_id = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())
        self.whole = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.queue = RankQueue(self.ranks)
        self.words = self.queue.words
        self.matches = regex.compile(pattern).findall
        self.pieces = PieceEncoder(self._ids, self._later)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: always merge the pair of lowest rank, the leftmost of equals."""
        return [self.ranks[piece]] if piece in self.ranks else self.queue.merge_all([piece])[0].tolist()

    def _merged(self, matches: list[str]) -> list[bytes]:
        """Ids of each match. Those that are no whole token are merged together, by one call of the queue."""
        matches = [m.encode() for m in matches]
        known = list(map(self.whole.get, matches))
        ids, starts = self.queue.merge_all([m for m, k in zip(matches, known, strict=True) if k is None])
        merged, cuts = ids.astype("<i4").tobytes(), (4 * starts).tolist()
        parts = (merged[a:b] for a, b in zip(cuts, cuts[1:]))
        return [next(parts) if k is None else k for k in known]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = [self.matches(t) for t in texts]
        encoded = iter(self._merged([m for matches in found for m in matches]))
        return [b"".join([next(encoded) for _ in matches]) for matches in found]

    def _later(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space: laid end to end as one text, told apart by the spaces before them."""
        odd = [p for p in pieces if not p or p[-1].isspace() or p[0].isspace()]
        out = dict(zip(odd, self._ids([" " + p for p in odd]), strict=True))
        whole = [p for p in pieces if p not in out]
        if whole:
            matches = self.matches(" " + " ".join(whole))
            encoded = self._merged(matches)
            starts = [i for i, m in enumerate(matches) if m[0] == " "]
            ends = [*starts[1:], len(matches)]
            out.update((p, encoded[a] if b - a == 1 else b"".join(encoded[a:b]))
                       for p, a, b in zip(whole, starts, ends, strict=True))
        return [out[p] for p in pieces]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.pieces.encode_all(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for, no list none. An id that is no token is an error."""
        offsets = ids.offsets.to_numpy()
        spelt = self.by_id.take(ids.values[int(offsets[0]):int(offsets[-1])])
        if spelt.null_count:
            raise KeyError("an id that is no token")
        _, places, content = spelt.buffers()
        places = np.frombuffer(places, np.int32)[spelt.offset:spelt.offset + len(spelt) + 1]
        bounds = places[offsets - offsets[0]]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), content])

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN,
                     text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out``: the ids of the whole text, array<int>.

    Each match of ``pattern``, which must cut before single spaces (see ``chunks``), is encoded by itself; special
    strings are ordinary text. NULL and empty texts have no
    ids. A column named ``out`` is replaced; all other columns stay as they are. Rows are independent: no shuffle.
    """
    content = file_broadcast(docs.sparkSession, vocabulary)
    kept = [c for c in docs.columns if c != out]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built_once(ByteBpe, content.value, pattern)
        for rows, texts in slices(batches, text_col):
            ids = bpe.encode_all([t or "" for t in texts])
            lengths = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            values = np.frombuffer(b"".join(ids), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*kept, out])

    schema = docs.select(*kept).withColumn(out, F.lit(None).cast("array<int>")).schema
    return docs.select(*kept).mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids",
                     out: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``out``: the bytes that the ids stand for. NULL ids give no bytes."""
    content = file_broadcast(encoded.sparkSession, vocabulary)
    kept = [c for c in encoded.columns if c != out]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built_once(ByteBpe, content.value, public_tokenizers.PATTERN)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*rows.columns, bpe.decode_all(rows.column(ids_col))], [*kept, out])

    schema = encoded.select(*kept).withColumn(out, F.lit(None).cast("binary")).schema
    return encoded.select(*kept).mapInArrow(decoded, schema)


def with_digests(docs: DataFrame) -> DataFrame:
    """n_tokens, and SHA-256 of the ids and of the decoded bytes, next to the columns of ``docs``."""
    return decode_documents(encode_documents(docs)).select(
        *[c for c in docs.columns if c != "text"], F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_byte_bpe")
def byte_bpe(spark, sf_dir) -> DataFrame:
    return with_digests(documents(spark, sf_dir).select("doc_id", "text"))
