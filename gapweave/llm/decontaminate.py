"""Benchmark decontamination by greedy string tiling.

Documents and test items are compared as words, in lower case and without punctuation.
Seeds are runs of ``LEAST`` words that both share. For each document and item with seeds,
greedy string tiling repeatedly finds the longest run of unmarked words that both have, by
Karp-Rabin hashes of windows, and marks it on both sides, until no run of ``LEAST`` words
is left. Tiles may lie in any order, so an item whose sentences were rearranged is covered
as well as one in place. A document is contaminated by an item of which at least
``coverage`` of the words are tiled.

Every tile is made of seeds, so words outside seeds take no part, and an item is skipped
when even all its seed words together would not reach the coverage.

The benchmark is the stated query set. It goes to the tasks in blocks of at most
``block_words`` words (or one longer item); each block is held against all documents, which
are not shuffled. What a task holds is bounded by the block and its longest document.

Defined results: null or empty texts match nothing; items of fewer than ``LEAST`` words are
not looked for; repeated items count once, a repeated document each time; an empty
benchmark leaves all documents. A null id is reported as such. Of windows of one length the
first in the document goes first, to the first free place in the item. Repetitive texts cost
what others of their length do. Further columns stay in ``drop_contaminated`` and are not
read by ``contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapweave.llm.columns import words_of
from gapweave.llm.textbytes import BASE, U, chunks, folded, mix64, powers, shingles, words

LEAST = 5
COVERAGE = 0.5
BLOCK_WORDS = 200_000
FIELDS = "item_words long, tiled_words long, n_tiles int, longest int, coverage double"


class Block(NamedTuple):
    """Items of one block: their words, seeds sorted by hash, and which items have which seed."""

    ids: list
    items: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    has_seed: np.ndarray
    has_item: np.ndarray
    may: np.ndarray  # by the top bits of a hash: whether some seed has them


def _block(rows) -> Block:
    texts = pa.array([r.text for r in rows], pa.string())
    items: list[np.ndarray] = []
    seed, item, place = [], [], []
    for first, end, data, at in chunks(texts, 1 << 30):
        word, text = words(*folded(data, at))
        cut = np.searchsorted(text, np.arange(end - first + 1))
        items += [word[a:b] for a, b in zip(cut, cut[1:])]
        h, t, p = shingles(word, text, LEAST)
        seed.append(h), item.append(t + first), place.append(p - cut[t])
    h, t, p = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((seed, U), (item, np.int64), (place, np.int64)))
    order = np.argsort(h, kind="stable")
    may = np.zeros(1 << 20, bool)
    may[(h >> U(44)).astype(np.int64)] = True
    h, t, p = h[order], t[order], p[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return Block([r.item_id for r in rows], items, h, t, p, h[new], t[new], may)


def blocks(bench: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, a bounded block at a time."""
    items = bench.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.size(words_of(F.col("text"))))).first()[0] or 0
    n = -(-total // (block_words // 2 if total > block_words else block_words))  # halves leave room for uneven hashing
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = items.where(part == k).orderBy("item_id", "text").collect()
        if rows:
            yield _block(rows)


def _window(prefix: np.ndarray, size: int, back: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` words."""
    return (prefix[size:] - prefix[:-size]) * back[: len(prefix) - size]


_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place in a, place in b, length)``, the longest first."""
    n = max(len(a), len(b)) + 1
    power, back = powers(n), powers(n, _INVERSE)
    prefix = [np.concatenate(([U(0)], np.cumsum(mix64(x) * power[: len(x)], dtype=U))) for x in (a, b)]
    marked = [np.zeros(len(x), bool) for x in (a, b)]
    found: list[tuple[int, int, int]] = []

    def free(side: int, size: int) -> np.ndarray:
        used = np.concatenate(([0], np.cumsum(marked[side])))
        return np.flatnonzero(used[size:] == used[:-size])

    def windows(size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Places of unmarked windows on both sides, and their hashes."""
        at = [free(k, size) for k in (0, 1)]
        return at, [_window(prefix[k], size, back)[at[k]] for k in (0, 1)]

    def some(size: int) -> bool:
        """Whether both sides have a window of this size."""
        return size <= min(len(a), len(b)) and bool(len(np.intersect1d(*windows(size)[1])))

    def mark(size: int) -> None:
        """Walk one side in order and pair each unmarked window with the first unmarked equal one.

        Marks only grow, so places of the other side that are marked are passed for good: the
        pairs of equal windows, which repetitive texts have in great number, are never listed.
        """
        at, hashes = windows(size)
        by: dict[int, list[int]] = {}
        for q, h in zip(at[1][::-1].tolist(), hashes[1][::-1].tolist()):
            by.setdefault(h, []).append(q)  # the first place is last
        hit = np.isin(hashes[0], hashes[1])
        taken = -1  # windows before this place overlap the last tile
        for i, h in zip(at[0][hit].tolist(), hashes[0][hit].tolist()):
            if i < taken:
                continue
            places, passed = by[h], []
            while places:
                j = places[-1]
                if marked[1][j] or marked[1][j + size - 1]:  # tiles are no shorter, so an end is marked
                    places.pop()
                elif np.array_equal(a[i : i + size], b[j : j + size]):
                    marked[0][i : i + size] = True
                    marked[1][j : j + size] = True
                    found.append((i, j, size))
                    taken = i + size
                    break
                else:  # only the hash is equal
                    passed.append(places.pop())
            places += passed[::-1]

    low, high = least, min(len(a), len(b))
    while high >= least and some(least):
        low, top = least, high
        while low < top:  # the longest size with a match: a match holds matches of all smaller sizes
            middle = (low + top + 1) // 2
            low, top = (middle, top) if some(middle) else (low, middle - 1)
        mark(low)
        high = low - 1
    return found


def _matches(sorted_hashes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ``(index in h, index in sorted_hashes)`` of equal hashes."""
    left, right = np.searchsorted(sorted_hashes, h), np.searchsorted(sorted_hashes, h, "right")
    count = right - left
    return np.repeat(np.arange(len(h)), count), np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _compare(data, at, block: Block, coverage: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows ``(text, item, words, tiled, tiles, longest)`` of a chunk that reach the coverage."""
    word, text = words(*folded(data, at))
    h, t, p = shingles(word, text, LEAST)
    some = np.flatnonzero(block.may[(h >> U(44)).astype(np.int64)])
    h, t, p = h[some], t[some], p[some]
    # where each document has a seed of each item
    at_hit, entry = _matches(block.has_seed, h)
    if not len(at_hit):
        return
    doc, item, start = t[at_hit], block.has_item[entry], p[at_hit]
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    # and where each item has a seed of the document, each distinct seed being looked up once
    order = np.lexsort((h, t))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (t[order][1:] != t[order][:-1])
    once = order[new]
    at_seed, entry = _matches(block.seed, h[once])
    of, with_item, place = t[once][at_seed], block.item[entry], block.place[entry]
    order = np.lexsort((with_item, of))
    of, with_item, place = of[order], with_item[order], place[order]
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    cut_item = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(with_item, prepend=-1) != 0))
    ends, ends_item = np.append(cut[1:], len(doc)), np.append(cut_item[1:], len(of))
    for x, y, u, v in zip(cut, ends, cut_item, ends_item):
        b = block.items[item[x]]
        seeds = np.zeros(len(b), bool)
        for j in range(LEAST):
            seeds[place[u:v] + j] = True
        if seeds.sum() < coverage * len(b):
            continue
        at_words = np.unique((start[x:y, None] + np.arange(LEAST)).ravel())
        gap = np.flatnonzero(np.diff(at_words) > 1) + 1
        # a word that no item has keeps runs apart that are not adjacent in the text
        a = np.insert(word[at_words], gap, U(0))
        got = tiles(a, b)
        tiled = sum(n for _, _, n in got)
        if tiled >= coverage * len(b):
            yield int(doc[x]), int(item[x]), len(b), tiled, len(got), got[0][2]


def contaminated(docs: DataFrame, bench: DataFrame, *, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and test item of which at least ``coverage`` is tiled."""
    kinds = {f.name: f.dataType.simpleString() for f in (docs.schema["doc_id"], bench.schema["item_id"])}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, {FIELDS}"
    narrow = docs.select("doc_id", "text")

    def search(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (first + r[0], *r[1:])
                    for first, _, data, at in chunks(batch.column(1))
                    for r in _compare(data, at, block, coverage)
                ]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(cols[0], pa.int64())),
                        pa.array([block.ids[i] for i in cols[1]], items),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int64()),
                        pa.array(cols[4], pa.int32()),
                        pa.array(cols[5], pa.int32()),
                        pa.array([n / m for n, m in zip(cols[3], cols[2])], pa.float64()),
                    ],
                    names=["doc_id", "item_id", "item_words", "tiled_words", "n_tiles", "longest", "coverage"],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    items = to_arrow_type(bench.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(bench, block_words):
        out = out.unionByName(narrow.mapInArrow(search(block), schema))
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without those contaminated by any item; a block at a time, without a join."""
    where = docs.columns.index("text")

    def keep(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, data, at in chunks(batch.column(where)):
                    clean[[first + r[0] for r in _compare(data, at, block, coverage)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in blocks(bench, block_words):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
