"""Words, word hashes and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once inside a task; a longer document makes a slice of its own.
SLICE_BYTES = 4 << 20

#: Odd multiplier of the polynomial word hashes, and the constants of a 64-bit finaliser.
RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column holds about `limit` bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(begin, end - begin)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: offsets (n + 1) into the flat list of words."""
    texts = pc.fill_null(texts, "")
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = found.offsets.to_numpy().astype(np.int64)
    words = found.values
    filled = np.concatenate([[0], np.cumsum(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))])
    if filled[-1] != len(words):  # white space at the ends of a text leaves empty pieces
        offsets, words = filled[offsets], words.filter(pc.greater(pc.binary_length(words), 0))
    else:
        offsets, words = offsets - offsets[0], words.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets.astype(np.int64), words


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of every word; each distinct word is hashed once."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    table = np.fromiter((digest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64)
    return table[coded.indices.to_numpy()]


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that lets every input bit reach every output bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * _MIX_1
    values = values ^ (values >> np.uint64(33))
    values = values * _MIX_2
    return values ^ (values >> np.uint64(33))


def powers(count: int) -> np.ndarray:
    """RADIX ** 0 .. RADIX ** (count - 1) modulo 2 ** 64."""
    out = np.full(count, RADIX, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive words (len - width + 1 values)."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    scale = powers(len(hashes))
    inverse = np.full(len(hashes) - width + 1, pow(int(RADIX), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * scale, dtype=np.uint64)])
    return mixed((total[width:] - total[:-width]) * inverse)


def document_keys(ids: pa.Array, texts: pa.Array) -> list[bytes]:
    """Binary keys that sort by document id (null first), then by a 128-bit hash of the text.

    Rows that repeat both have the same key; rows that share only the id differ.
    """
    digest = xxhash.xxh3_128_digest
    return [
        (b"\0" * 9 if i is None else b"\1" + (i + (1 << 63)).to_bytes(8, "big")) + digest(t or "")
        for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)
    ]
