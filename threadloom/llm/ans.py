"""Static range asymmetric numeral system over token ids: one frequency table, independent interleaved blocks.

A file is a magic number, a JSON header's length, the JSON header, then arrays
in the order of ``ARRAYS``, then the streams of the blocks. All numbers are little-endian.
Each block holds ``steps`` rows of ``LANES`` ids, one coder state per lane. Its
checkpoint is the final states, the place of its stream and the CRC-32 of its
ids, so a reader can start at any block and check it. The coder works on all
blocks of a file at once: one array operation per step.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

MAGIC = b"TLRANS01"
LANES = 64
BLOCK_IDS = 1 << 16
SCALE_BITS = 20
SMALL_IDS = 1 << 20  # ids below are counted and looked up in tables of that length
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
WORD = np.uint64(32)
SCALE = np.uint64(SCALE_BITS)
SLOTS = np.uint64((1 << SCALE_BITS) - 1)
ARRAYS = (("symbols", "<u4"), ("frequencies", "<u4"), ("doc_ids", "<i8"), ("doc_null", "u1"), ("doc_lengths", "<u4"),
          ("block_words", "<u4"), ("block_crc", "<u4"), ("states", "<u8"))


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in use and frequencies of at least 1 that sum to 2^SCALE_BITS (so at most that many symbols)."""
    if ids.max() < SMALL_IDS:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    scaled = np.maximum(1, counts * ((1 << SCALE_BITS) - len(symbols)) // counts.sum()).astype(np.int64)
    scaled[np.argmax(scaled)] += (1 << SCALE_BITS) - scaled.sum()
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def layout(n: int) -> tuple[int, int]:
    """Blocks and steps for ``n`` ids: blocks of equal shape, about BLOCK_IDS ids each."""
    blocks = max(1, -(-n // BLOCK_IDS))
    return blocks, max(1, -(-n // (blocks * LANES)))


def encode_file(ids: np.ndarray, doc_ids: list[int | None], doc_lengths: list[int]) -> bytes:
    """One file with the ids of some documents, laid end to end."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    symbols, frequencies = frequency_table(ids if n else np.zeros(1, np.uint32))
    starts = np.concatenate(([0], np.cumsum(frequencies[:-1], dtype=np.uint64))).astype(np.uint64)
    blocks, steps = layout(n)
    padded = np.full(blocks * steps * LANES, symbols[np.argmax(frequencies)], np.uint32)
    padded[:n] = ids
    if symbols[-1] < SMALL_IDS:
        places = np.zeros(int(symbols[-1]) + 1, np.int32)
        places[symbols] = np.arange(len(symbols), dtype=np.int32)
        index = places[padded]
    else:
        index = np.searchsorted(symbols, padded)
    index = index.reshape(blocks, steps, LANES).transpose(1, 0, 2)
    f, c = frequencies.astype(np.uint64)[index], starts[index]
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, wrote = np.empty((steps, blocks, LANES), np.uint32), np.empty((steps, blocks, LANES), bool)
    for t in range(steps - 1, -1, -1):
        ft = f[t]
        full = x >= (ft << np.uint64(63 - SCALE_BITS))
        wrote[t], words[t] = full, x.astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        q = x // ft
        x = (q << SCALE) + (x - q * ft) + c[t]
    wrote, words = wrote.transpose(1, 0, 2), words.transpose(1, 0, 2)
    per_block = padded.reshape(blocks, -1)
    arrays = {
        "symbols": symbols, "frequencies": frequencies,
        "doc_ids": np.array([d or 0 for d in doc_ids], np.int64),
        "doc_null": np.array([d is None for d in doc_ids], np.uint8), "doc_lengths": np.array(doc_lengths, np.uint32),
        "block_words": wrote.sum(axis=(1, 2)), "states": x,
        "block_crc": [zlib.crc32(b.astype("<u4").tobytes()) for b in per_block]}
    header = json.dumps({"ids": n, "blocks": blocks, "steps": steps, "lanes": LANES, "scale_bits": SCALE_BITS,
                         "sizes": [int(np.size(arrays[k])) for k, _ in ARRAYS]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header,
                     *[np.asarray(arrays[k]).astype(kind).tobytes() for k, kind in ARRAYS],
                     words[wrote].astype("<u4").tobytes()])


class TokenFile:
    """A file's header and checkpoints; ids are decoded by block."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack_from("<I", content, 8)[0]
        self.header = json.loads(content[12:12 + size])
        if (self.header["lanes"], self.header["scale_bits"]) != (LANES, SCALE_BITS):
            raise ValueError("written with other parameters")
        at = 12 + size
        for (name, kind), n in zip(ARRAYS, self.header["sizes"], strict=True):
            setattr(self, name, np.frombuffer(content, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.stream = np.frombuffer(content, "<u4", offset=at)
        if len(self.stream) != self.block_words.sum(dtype=np.int64):
            raise ValueError("the file is cut short")

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` (exclusive; all by default), without padding."""
        blocks, steps = self.header["blocks"], self.header["steps"]
        last = blocks if last is None else last
        n = last - first
        frequencies = self.frequencies.astype(np.uint64)
        starts = np.concatenate(([0], np.cumsum(frequencies[:-1]))).astype(np.uint64)
        slot_index = np.repeat(np.arange(len(frequencies), dtype=np.int32), self.frequencies)
        x = self.states.reshape(blocks, LANES)[first:last].astype(np.uint64)
        at = np.concatenate(([0], np.cumsum(self.block_words, dtype=np.int64)))[first:last].reshape(n, 1)
        out = np.empty((steps, n, LANES), np.uint32)
        for t in range(steps):
            slot = x & SLOTS
            index = slot_index[slot.astype(np.int64)]
            out[t] = self.symbols[index]
            x = frequencies[index] * (x >> SCALE) + slot - starts[index]
            need = x < LOW
            place = np.cumsum(need, axis=1)
            if place[:, -1].any():
                word = self.stream[np.minimum(at + place - 1, len(self.stream) - 1).clip(0)]
                x = np.where(need, (x << WORD) | word, x)
                at = at + place[:, -1:]
        ids = out.transpose(1, 0, 2).reshape(n, -1)
        for b in range(n):
            if zlib.crc32(ids[b].astype("<u4").tobytes()) != self.block_crc[first + b]:
                raise ValueError(f"block {first + b} is damaged")
        return ids.reshape(-1)[:max(0, self.header["ids"] - first * steps * LANES)]
