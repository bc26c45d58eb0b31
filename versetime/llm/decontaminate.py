"""Benchmark decontamination: item-sized windows by SimHash, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import staged

#: Words of a shingle, least similarity, and bits that fingerprints may differ in.  At similarity 0.8 at most one in nine
#: shingles of a window differs from the item's, and fingerprints in ten bits on average with a deviation of three, so that
#: 23 bits leave none out in practice (see the tests for recall by length).  Items of fewer than nine shingles must agree.
SHINGLE, SIMILARITY, RADIUS, EXACT_SHINGLES = 5, 0.8, 23, 9
#: Blocks of a fingerprint: of those within the radius one block differs in RADIUS // BLOCKS bits or fewer.
BLOCKS = 8
#: Bytes of benchmark text that are broadcast at once; more take more passes.
ITEM_BYTES = 8 << 20
#: Characters of a text that are split into words at once, pairs of places and items that are looked up at once, and
#: windows that have their fingerprints taken at once.
PIECE_CHARS, PAIRS, STRETCH = 1 << 20, 1 << 20, 1 << 14

_TABLE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "array<struct<item_id:long,similarity:double,start_word:long,n_words:int,hamming:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("hamming", pa.int32())]))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; white space and ASCII punctuation separate them."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def pieces(text: str, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words before, words) of a text, in pieces of bounded length that repeat ``overlap`` words."""
    at, before, kept = 0, 0, []
    while True:
        stop = at + PIECE_CHARS
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        own = kept + words_of(text[at:stop])
        yield before, own
        if stop >= len(text):
            return
        kept = own[len(own) - overlap :] if overlap < len(own) else own
        before += len(own) - len(kept)
        at = stop


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    own = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = max(0, len(own) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ own[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each start; a shingle weighs as often as it occurs."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts + count] - total[starts]
    return np.packbits(ones * 2 > count, axis=1, bitorder="little").view(np.uint64).ravel()


class _Postings:
    """The rarest shingles of the items, one of which any window similar enough must hold: sorted keys, and the items of each.

    A window is similar only if it shares ``similarity`` of an item's shingles; so it holds one of any that weigh more than
    the rest may.  Those that the fewest items have are taken, which keeps common phrases out.
    """

    def __init__(self, items: np.ndarray, hashes: list[np.ndarray], similarity: float) -> None:
        _, place, held_by = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_inverse=True, return_counts=True)
        rarity, at, keys = held_by[place], 0, []
        for h in hashes:
            own, weight = np.unique(h, return_counts=True)
            order = np.lexsort((own, rarity[at : at + len(own)]))
            at += len(own)
            needed = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
            keys.append(own[order[: np.searchsorted(np.cumsum(weight[order]), needed) + 1]])
        flat, owner = np.concatenate(keys), np.repeat(items, [len(k) for k in keys])
        order = np.lexsort((owner, flat))
        self.items = owner[order].astype(np.int32)
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)
        self.shift = np.uint64(64 - max(16, min(24, int(len(self.keys)).bit_length() + 3)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.keys >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key number) of the shingles that are keys."""
        at = np.flatnonzero(self.seen[hashes >> self.shift])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        found = self.keys[place] == hashes[at]
        return at[found], place[found]

    def pairs(self, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions of its keys), about ``PAIRS`` positions at once, so that an item may come again."""
        counts = self.first[place + 1] - self.first[place]
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1):
            n = counts[own]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[place[own]], n)
            items, positions = self.items[entry], np.repeat(at[own], n)
            order = np.lexsort((positions, items))
            items, positions = items[order], positions[order]
            edges = np.flatnonzero(np.diff(items)) + 1
            yield from zip(items[np.append(0, edges)].tolist(), np.split(positions, edges), strict=True)


class Items:
    """Benchmark items in arrays: their shingles, their fingerprints, and the keys by which windows are looked up."""

    def __init__(self, ids: list[int], texts: list[str | None], radius: int = RADIUS, similarity: float = SIMILARITY) -> None:
        self.radius, self.similarity = radius, similarity
        self.ids, sizes, hashes = [], [], []
        for i, text in zip(ids, texts, strict=True):
            if own := words_of(text or ""):
                self.ids.append(i)
                sizes.append(len(own))
                hashes.append(shingle_hashes(own, min(SHINGLE, len(own))))
        self.sizes = np.array(sizes, np.int64)
        self.longest = max(sizes, default=0)
        self.prints = np.array([window_fingerprints(h, np.zeros(1, np.int64), len(h))[0] for h in hashes], np.uint64)
        self.first = np.append(0, np.cumsum([len(h) for h in hashes])).astype(np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        shingle = np.minimum(self.sizes, SHINGLE)
        self.postings = {int(s): _Postings(k := np.flatnonzero(shingle == s), [hashes[i] for i in k], similarity) for s in np.unique(shingle)}

    def radius_of(self, size: int, width: int) -> int:
        """Bits that the fingerprints of an item of ``size`` words and of a window of ``width`` may differ in.

        A text shorter than the item is one window, which is always verified.
        """
        if width < size:
            return 64
        return 0 if size - SHINGLE + 1 < EXACT_SHINGLES else self.radius

    def search(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, differing bits) of the best window for each item found."""
        best: dict[int, tuple] = {}
        for before, words in pieces(text, self.longest - 1):
            for size, postings in self.postings.items():
                hashes = shingle_hashes(words, size)
                at, place = postings.hits(hashes)
                for k, own in postings.pairs(at, place) if len(at) else ():
                    self._windows(hashes, len(words), before, size, k, own, best)
        return [(self.ids[k], -s, start, n, bits) for k, (s, start, n, bits) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, n_words: int, before: int, size: int, k: int, p: np.ndarray, best: dict) -> None:
        """Keep the best of the windows that hold one of the places ``p`` for item ``k``, in stretches of bounded length."""
        n = int(self.sizes[k])
        width = min(n, n_words)  # a text shorter than the item is one window
        low, high = np.maximum(0, p + size - width), np.minimum(p, n_words - width)
        # Places are in order, and so are their windows: each begins where those of the place before end.
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        breaks = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
        for begin, end in zip(low[np.append(0, breaks)].tolist(), high[np.append(breaks, len(p)) - 1].tolist(), strict=True):
            for at in range(begin, end + 1, STRETCH):
                self._verified(hashes, np.arange(at, min(end + 1, at + STRETCH)), before, k, n, width, width - size + 1, best)

    def _verified(self, hashes: np.ndarray, starts: np.ndarray, before: int, k: int, n: int, width: int, count: int, best: dict) -> None:
        first, radius = int(starts[0]), self.radius_of(n, width)
        prints = window_fingerprints(hashes[first : int(starts[-1]) + count], starts - first, count)
        # Bits by block: within the radius, one block differs in radius // BLOCKS bits or fewer, and only such are summed.
        blocks = np.bitwise_count((prints ^ self.prints[k]).view(np.uint8).reshape(-1, BLOCKS))
        near = np.flatnonzero((blocks <= radius // BLOCKS).any(axis=1))
        bits = blocks[near].sum(axis=1, dtype=np.int64)
        near, bits = near[bits <= radius], bits[bits <= radius]
        if not len(near):
            return
        item = self.hashes[self.first[k] : self.first[k + 1]]
        # Places that share a shingle with the item at all; a window needs enough of them before its weights are compared.
        reach = hashes[first + int(near[0]) : first + int(near[-1]) + count]
        shared = np.append(0, np.cumsum(np.isin(reach, item)))
        enough = shared[near - near[0] + count] - shared[near - near[0]] >= self.similarity * len(item) - 1e-9
        wanted = Counter(item.tolist()) if enough.any() else Counter()
        for at, apart in zip((near[enough] + first).tolist(), bits[enough].tolist(), strict=True):
            both = (Counter(hashes[at : at + count].tolist()) & wanted).total()
            score = both / (count + len(item) - both)
            rank = (-score, before + at, width, apart)
            if score >= self.similarity and (k not in best or rank < best[k]):
                best[k] = rank


def found_items(shared) -> object:
    """A column function: the items of a broadcast :class:`Items` that a text holds."""

    @F.arrow_udf(_FOUND)
    def of(texts: pa.Array) -> pa.Array:
        search = shared.value.search
        names = [f.name for f in _FOUND_TYPE.value_type]
        return pa.array([[dict(zip(names, x, strict=True)) for x in search(t.as_py() or "")] for t in texts], _FOUND_TYPE)

    return of


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> list[Callable[[], Items]]:
    """The benchmark as blocks of at most about ``item_bytes``, each small enough to be broadcast, read when called."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // item_bytes))

    def read(k: int) -> Items:
        own = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == k).sort("item_id", "text").toArrow()
        return Items(own.column("item_id").to_pylist(), own.column("text").to_pylist())

    return [partial(read, k) for k in range(blocks)]


def _each_block(rows: DataFrame, blocks: list[Callable[[], Items]], use: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """``use(rows, column function)`` of each block, put together; one block is broadcast at a time."""
    share, out = rows.sparkSession.sparkContext.broadcast, None
    for read in blocks:
        shared = share(read())
        own = use(rows, found_items(shared))
        if len(blocks) > 1:
            own = staged(own, "found")
            shared.unpersist()
        out = own if out is None else out.unionByName(own)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, n_words, hamming)``: the best window for each item a document holds.

    A window has as many words as the item (all words of a shorter text) and at least one of its rarest shingles,
    without which no similarity is enough (:class:`_Postings`), so it meets only items that it shares these with.  Its
    SimHash is compared with theirs in blocks: within the radius (:meth:`Items.radius_of`) some block agrees up to a few bits.  Those are verified
    by the exact weighted Jaccard similarity of five-word shingles, a shingle's weight being how often it occurs; shorter
    items are one shingle.

    The documents are never shuffled; the benchmark is broadcast in blocks of bounded size, and where it has several,
    what one finds is written before the next is sent.  Null and empty
    texts hold nothing; items that are null or have no words are never found; repeated rows, and items that
    repeat, are each returned; of equal windows the first counts; an empty table gives no rows; other columns are
    not read; item ids must be whole numbers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    use = lambda own, found: own.select("doc_id", F.explode(found("text")).alias("found")).select("doc_id", "found.*")
    return _each_block(rows, item_blocks(benchmark, item_bytes=item_bytes), use)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item of the benchmark.

    With one block of items that is a filter.  With more, rows are written with a number first, and the numbers of
    those that hold an item are taken away at the end.
    """
    blocks = item_blocks(benchmark, item_bytes=item_bytes)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(blocks[0]())
        return docs.where(F.size(found_items(shared)(F.col(text_col))) == 0)
    rows = staged(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("number")), "numbered")
    holding = _each_block(rows.select("number", "text"), blocks, lambda own, found: own.where(F.size(found("text")) > 0).select("number"))
    return rows.join(holding.distinct(), "number", "left_anti").select("row.*")
