"""Patched frame-of-reference blocks for arrays of token ids.

A file image is a header, the block index, the documents' lengths and the blocks:

    magic "PFR1", n_tokens u64, n_blocks u32, n_docs u32        header (20 bytes)
    n_blocks + 1 offsets u64                                    start of each block, end of the last
    n_docs lengths u64                                          tokens of each document
    blocks: min u32, width u8, n_exceptions u8 (of 256 ids at most: 255 + 1 never occurs), then
            8 x width u32 words of packed differences, then n_exceptions positions u8 and as many
            excess values u32 (the bits above ``width``)

Everything is little-endian. A block holds 256 ids; the last one is padded with its minimum. The
width is the least that fits the differences up to a percentile, so at most a tenth are exceptions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
PERCENTILE = 90
_MAGIC = b"PFR1"
_LANES = BLOCK // 32


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2**53."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) values below 2**width as (n, 8 * width) words; lane k holds values 32k to 32k + 31."""
    n = len(values)
    lanes = values.reshape(n, _LANES, 32).astype(np.uint64)
    words = np.zeros((n, _LANES, width + 1), np.uint64)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        v = lanes[:, :, k] << np.uint64(shift)
        words[:, :, word] |= v & np.uint64(0xFFFFFFFF)
        words[:, :, word + 1] |= v >> np.uint64(32)
    return words[:, :, :width].astype("<u4").reshape(n, _LANES * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    if not width:
        return np.zeros((n, BLOCK), np.uint64)
    lanes = np.zeros((n, _LANES, width + 1), np.uint64)
    lanes[:, :, :width] = words.reshape(n, _LANES, width)
    out = np.empty((n, _LANES, 32), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        both = lanes[:, :, word] | (lanes[:, :, word + 1] << np.uint64(32))
        out[:, :, k] = (both >> np.uint64(shift)) & mask
    return out.reshape(n, BLOCK)


def encode(ids: np.ndarray, lengths: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The file image of documents with ``lengths`` ids each, one after the other (unsigned 32-bit)."""
    ids = np.asarray(ids, np.uint32)
    lengths = np.asarray(lengths, "<u8")
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n_blocks, BLOCK)
    if n_blocks and len(ids) % BLOCK:
        blocks[-1, len(ids) % BLOCK :] = blocks[-1, : len(ids) % BLOCK].min()
    least = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    diff = blocks - least[:, None]
    rank = min(BLOCK - 1, -(-BLOCK * percentile // 100) - 1)
    width = _bits(np.partition(diff, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.int64)
    excess = diff >> width.astype(np.uint64)[:, None]
    low = diff & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    n_exc = (excess != 0).sum(axis=1)
    sizes = 6 + 4 * _LANES * width + 5 * n_exc
    head = 20 + 8 * (n_blocks + 1) + 8 * len(lengths)
    offsets = head + np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    out = np.zeros(int(offsets[-1]), np.uint8)
    header = _MAGIC + np.array([len(ids)], "<u8").tobytes() + np.array([n_blocks, len(lengths)], "<u4").tobytes()
    out[:head] = np.frombuffer(header + offsets.astype("<u8").tobytes() + lengths.tobytes(), np.uint8)
    starts = offsets[:-1]
    fixed = np.concatenate(
        [least.astype("<u4").view(np.uint8).reshape(-1, 4), width.astype(np.uint8)[:, None], n_exc.astype(np.uint8)[:, None]],
        axis=1,
    )
    out[starts[:, None] + np.arange(6)] = fixed
    for w in np.unique(width).tolist():
        if w:
            which = np.flatnonzero(width == w)
            packed = _pack(low[which], w).view(np.uint8)
            out[starts[which][:, None] + 6 + np.arange(packed.shape[1])] = packed
    block, pos = np.nonzero(excess)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.concatenate(([0], np.cumsum(n_exc)[:-1])), n_exc)
        at = starts[block] + 6 + 4 * _LANES * width[block]
        out[at + nth] = pos.astype(np.uint8)
        values = excess[block, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at + n_exc[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes()


def lengths_of(image: bytes) -> np.ndarray:
    """Tokens of each document of a file image."""
    n_blocks, n_docs = np.frombuffer(image, "<u4", 2, 12)
    return np.frombuffer(image, "<u8", int(n_docs), 20 + 8 * (int(n_blocks) + 1)).astype(np.int64)


def decode(image: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``end`` of a file image; only the blocks that hold them are read."""
    if image[:4] != _MAGIC:
        raise ValueError("not a file of patched frame-of-reference blocks")
    n = int(np.frombuffer(image, "<u8", 1, 4)[0])
    n_blocks = int(np.frombuffer(image, "<u4", 1, 12)[0])
    end = n if end is None else min(end, n)
    if end <= first:
        return np.zeros(0, np.uint32)
    lo, hi = first // BLOCK, -(-end // BLOCK)
    starts = np.frombuffer(image, "<u8", n_blocks + 1, 20)[lo:hi].astype(np.int64)
    data = np.frombuffer(image, np.uint8)
    fixed = np.ascontiguousarray(data[starts[:, None] + np.arange(6)])
    least = np.ascontiguousarray(fixed[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width, n_exc = fixed[:, 4].astype(np.int64), fixed[:, 5].astype(np.int64)
    diff = np.zeros((hi - lo, BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        words = np.ascontiguousarray(data[starts[which][:, None] + 6 + np.arange(4 * _LANES * w)]).view("<u4")
        diff[which] = _unpack(words, w)
    block = np.repeat(np.arange(hi - lo), n_exc)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.concatenate(([0], np.cumsum(n_exc)[:-1])), n_exc)
        at = starts[block] + 6 + 4 * _LANES * width[block]
        pos = data[at + nth]
        excess = np.ascontiguousarray(data[(at + n_exc[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        diff[block, pos] |= excess.astype(np.uint64) << width[block].astype(np.uint64)
    return (diff + least[:, None]).reshape(-1)[first - lo * BLOCK : end - lo * BLOCK].astype(np.uint32)
