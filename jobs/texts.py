"""What is done to texts within tasks, on Arrow batches: words, canonical keys and hashed runs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20  # bytes of text that are made into runs at a time
FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(text: pa.Array) -> pa.Array:
    """The words of each text, in lower case (A-Z), between ASCII white space; one empty word where there is none."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, ""))))


def keys_of(text: pa.Array) -> pa.Array:
    """The md5 of each text's words with single spaces between them; null for a text without a word."""
    plain = (x.as_buffer() for x in pc.binary_join(words_of(text), pa.scalar(" ", text.type)))
    return pa.array([hashlib.md5(x).hexdigest() if x.size else None for x in plain], text.type)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * FACTOR
    return h ^ (h >> SHIFT)


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits for each word, from eight bytes at a time of all words that have so many."""
    flat = words.cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.zeros(ends[-1] + 8, np.uint8)
    if ends[-1]:
        data[:-8] = np.frombuffer(flat.buffers()[2], np.uint8, ends[-1])
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    which, at, left = np.arange(len(flat)), ends[:-1], np.diff(ends)
    out = mixed(left.astype(np.uint64))
    while len(which):
        out[which] = mixed(out[which] ^ (eights[at] & LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return out


def runs_of(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of n words of a text: the text's place in the array and 64 bits of hash."""
    words = words_of(text)
    flat = words.flatten()
    h = hashes(flat)
    run = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        run = mixed(run) + h[k : k + len(run)]
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(count) - count
    full = np.maximum(count - n + 1, 0)
    full[(count == 1) & (np.append(pc.binary_length(flat).to_numpy(zero_copy_only=False), 0)[start] == 0)] = 0  # no word at all
    row = np.repeat(np.arange(len(full)), full)
    return row, run[np.arange(len(row)) + (start - (np.cumsum(full) - full))[row]]


def run_batches(keep: list[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: keep and run of each run of n words of column text, some megabytes of text at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1), len(size)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                row, run = runs_of(piece["text"], n)
                yield pa.RecordBatch.from_arrays([*[piece[c].take(pa.array(row)) for c in keep], pa.array(run.view(np.int64))], [*keep, "run"])

    return made
