"""Substring dedup: words covered by a window that also starts in an earlier document go.

A window is WINDOW consecutive words of one document; the earlier document is the one with the
smaller id. Windows are judged on the input, not on what is left. Three passes over token blocks:

1. Each block makes a count-min sketch of its distinct windows: DEPTH rows of WIDTH counters, WIDTH a power of
   two of SPARSE times all words or more, the same for all blocks. It goes out without its zeros, in ranges of counters, to
   the owners of the ranges, which add the sketches up counter by counter and say which counters exceed one. The
   least counter of a window never falls below the number of blocks that hold it, so no repeated window is lost; a block
   flags the windows estimated in two blocks or seen by itself in two documents.
2. Only flagged windows are sent with 96 bits of hash and the smallest id in the block, grouped
   exactly, and answered by one bit: does a smaller id occur elsewhere?
3. Each block removes what its own ids and those bits decide.

A window is sent at most once a block, so a passage that a third of all documents share costs
one entry a block. Null and empty texts have no words; texts of fewer words than a window keep
all of them; null ids come after all others; rows that repeat an id do not remove each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASK, Block, answer, bundle, by_owner, join_blocks, map_blocks, owners_for, to_blocks, unbundle
from .common import NULL_ID, materialize, mix, pack, pack_sorted, ranked, release, unpack, unpack_sorted, window_hash

WINDOW = 13
DEPTH = 2  # rows of the count-min sketch
SPARSE = 4  # counters a row has for each word of the corpus, at least
ODD = np.uint64(0x9E3779B97F4A7C15)



class _Windows:
    """The windows of a block in order of document id, and its distinct ones in order of hash."""

    def __init__(self, block: Block, k: int):
        ids = block.numbers(NULL_ID)
        order = np.argsort(ids, kind="stable")
        inside = np.maximum(block.counts[order] - k + 1, 0)
        first = np.repeat(block.starts[order] - (np.cumsum(inside) - inside), inside)
        self.at = first + np.arange(inside.sum())
        self.id = np.repeat(ids[order], inside)
        self.hashes = block.hashes()
        self.code, self.hash = ranked(window_hash(self.hashes, self.at, k))
        places = np.arange(len(self.code))
        self.first, end = np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash), np.int64)
        self.first[self.code[::-1]] = places[::-1]  # an occurrence in the document with the smallest id
        end[self.code] = places
        self.least = self.id[self.first]
        self.repeated = self.id[end] > self.least  # in two documents of this block

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending counters of a row that the windows fall on, how many windows do, and each window's among them."""
        drop = np.uint64(64 - bits)
        if row == 0:
            order, cell = None, self.hash >> drop  # windows are in order of hash
        else:
            with np.errstate(over="ignore"):
                cell = (mix(self.hash + np.uint64(row)) * ODD) >> drop
            order = np.argsort(cell)
            cell = cell[order]
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        place = np.cumsum(new) - 1
        counts = np.bincount(place) if len(cell) else place
        if order is not None:
            back = np.empty(len(cell), np.int64)
            back[order] = place
            place = back
        return cell[new], counts, place

    def flagged(self, got: dict, owners: int, bits: int) -> np.ndarray:
        estimated = np.ones(len(self.hash), bool)
        for row in range(DEPTH):
            cells, _, place = self.cells(row, bits)
            above = np.zeros(len(cells), bool)
            for owner, part in by_owner(cells << np.uint64(64 - bits), owners):
                above[part] = np.unpackbits(np.frombuffer(got[SKETCH + row, owner], np.uint8), count=part.stop - part.start)
            estimated &= above[place]
        return np.flatnonzero(estimated | self.repeated)


SKETCH, EXACT = 10, 2  # kinds of messages: one for each row of the sketch, and flagged windows


def width_bits(words: int) -> int:
    """The logarithm of the counters in a row."""
    return min(60, max(16, int(SPARSE * words).bit_length()))


def _sketch(owners: int, k: int, bits: int):
    def ask(block: Block) -> Iterator[dict]:
        w = _Windows(block, k)
        for row in range(DEPTH):
            cells, counts, _ = w.cells(row, bits)
            for owner, part in by_owner(cells << np.uint64(64 - bits), owners):
                yield {"owner": owner, "block": block.block, "kind": SKETCH + row, "data": bundle(pack_sorted(cells[part]), np.packbits(counts[part] > 1).tobytes())}

    return ask


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The sum of sketches over one range: its first counter, and counters; parts: (counters that are not zero, whether above one)."""
    low = min(int(c[0]) for c, _ in parts)
    total = np.zeros(max(int(c[-1]) for c, _ in parts) - low + 1, np.int32)
    for cells, twice in parts:
        total[(cells - np.uint64(low)).astype(np.int64)] += 1 + twice  # counters of one sketch differ
    return low, total


def _estimate(owner: int, rows: list[dict]) -> Iterator[dict]:
    """Adds up the sketches of one range and answers, for every counter that a block has, whether the sum exceeds one."""
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        parts = []
        for r in own:
            cells, twice = unbundle(r["data"])
            cells = unpack_sorted(cells)
            parts.append((cells, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))))
        low, total = merged(parts)
        for r, (cells, _) in zip(own, parts, strict=True):
            yield {"block": r["block"], "kind": kind, "owner": owner, "data": np.packbits(total[(cells - np.uint64(low)).astype(np.int64)] > 1).tobytes()}


def _ask_exact(owners: int, k: int, bits: int):
    def ask(block: Block, got: dict) -> Iterator[dict]:
        w = _Windows(block, k)
        flagged = w.flagged(got, owners, bits)
        second = window_hash(block.hashes(1), w.at[w.first[flagged]], k, 1).astype(np.uint32)
        h, least = w.hash[flagged], w.least[flagged].view(np.uint64) ^ np.uint64(1 << 63)
        for owner, part in by_owner(h, owners):
            low = least[part].min()
            yield {"owner": owner, "block": block.block, "kind": EXACT, "data": bundle(pack_sorted(h[part]), second[part].tobytes(), int(low).to_bytes(8, "little"), pack(least[part] - low))}

    return ask


def _exact(owner: int, rows: list[dict]) -> Iterator[dict]:
    """Groups windows by both hashes and answers which occur with a smaller id elsewhere."""
    first, second, least, sizes = [], [], [], []
    for r in rows:
        h, s, low, ids = unbundle(r["data"])
        first.append(unpack_sorted(h))
        second.append(np.frombuffer(s, np.uint32))
        least.append(unpack(ids) + np.uint64(int.from_bytes(low, "little")))
        sizes.append(len(first[-1]))
    a, b, ids = np.concatenate(first), np.concatenate(second), np.concatenate(least)
    order = np.lexsort((ids, b, a))
    a, b, own = a[order], b[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    earlier = np.empty(len(a), bool)
    earlier[order] = smallest < own
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        yield {"block": r["block"], "kind": EXACT, "owner": owner, "data": np.packbits(earlier[at : at + n]).tobytes()}
        at += n


def _remove(owners: int, k: int, bits: int, key: str):
    def cut(block: Block, got: dict) -> Iterator[dict]:
        w = _Windows(block, k)
        flagged = w.flagged(got, owners, bits)
        earlier = np.zeros(len(w.hash), bool)
        for owner, part in by_owner(w.hash[flagged], owners):
            earlier[flagged[part]] = np.unpackbits(np.frombuffer(got[EXACT, owner], np.uint8), count=part.stop - part.start).astype(bool)
        goes = w.at[earlier[w.code] | (w.id > w.least[w.code])]
        n = len(w.hashes)
        edges = np.bincount(goes, minlength=n + k + 1)[: n + 1].astype(np.int64)
        edges[k:] -= np.bincount(goes, minlength=n + 1)[: n + 1 - k] if n + 1 > k else 0
        covered = np.cumsum(edges[:n]) > 0
        words = np.array([*block.vocabulary, None], object)
        codes = block.codes
        for i, a, c in zip(block.ids, block.starts, block.counts, strict=True):
            kept = ~covered[a : a + c]
            yield {key: i, "n_words": int(c), "n_removed": int(c - kept.sum()), "kept": b" ".join(words[codes[a : a + c][kept]]).decode("utf-8", "replace")}

    return cut


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """key, n_words, n_removed and kept, the words left joined by one space."""
    blocks = materialize(to_blocks(df, key, text, block_bytes=block_bytes))
    owners, bits = owners_for(blocks), width_bits(blocks.agg(F.sum("words")).first()[0] or 0)
    estimated = materialize(answer(map_blocks(blocks, _sketch(owners, window, bits), ASK), _estimate))
    release(df.sparkSession)
    decided = materialize(answer(join_blocks(blocks, estimated, _ask_exact(owners, window, bits), ASK), _exact))
    release(df.sparkSession)
    return join_blocks(blocks, estimated.union(decided), _remove(owners, window, bits, key), f"{key} long, n_words long, n_removed long, kept string")
