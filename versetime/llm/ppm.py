"""Language-model scoring by prediction by partial matching over byte contexts.

The trie of contexts is a table of its deepest counts, from one pass over the rows.  What the shorter contexts,
escapes and exclusions make of each (context, symbol) key is worked out in groups of contexts with the same last
bytes, so a text's code length is a sum of one value a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versetime.llm.common import staged

#: Longest context in bytes; a context and its symbol fill a 64-bit key up to six.
ORDER = 5
#: Both the end of a text and what stands before its start: a byte that UTF-8 never has.
END = 0xFF
#: Bytes that are scored at once, and distinct keys that a counting task gathers before it sends them on.
BLOCK_BYTES, GATHERED_KEYS = 1 << 20, 1 << 21
#: Commonest keys and words that are broadcast at most (about 30 bytes each in a worker), keys of a group of contexts on
#: average, and bytes of the longest contexts that are broadcast with their counts (2 ** 24 at most).
COMMON_KEYS, COMMON_WORDS, RATED_KEYS, LOW = 1 << 20, 1 << 18, 400_000, 2

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_END_WORD = np.int64(0x656E64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Block:
    """Pieces of texts as one buffer: keys of all scored bytes, hashes of all words, and whose they are."""

    order: int
    rows: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bytes: int = 0

    def add(self, row: int, before: bytes, piece: bytes) -> None:
        self.rows.append(row)
        self.parts += (before, piece)
        self.lengths.append(len(piece))
        self.bytes += len(piece)

    def ends(self) -> np.ndarray:
        """Whether each piece is the last of its text."""
        return np.array([p[-1:] == bytes([END]) for p in self.parts[1::2]], bool)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key of each scored byte, first key of each piece, word hashes, piece of each word)."""
        text = np.frombuffer(b"".join(self.parts), np.uint8)
        lengths = np.array(self.lengths)
        first = np.cumsum(lengths + self.order) - lengths
        scored = np.ones(len(text), bool)
        scored[(first[:, None] - 1 - np.arange(self.order)).ravel()] = False
        key = np.zeros(len(text) - self.order, np.uint64)
        for i in range(self.order + 1):
            key <<= np.uint64(8)
            key |= text[i : len(text) - self.order + i]
        inside = (text != 0x20) & (text != END)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        own = scored[begin] if len(begin) else np.zeros(0, bool)
        begin, end = begin[own], end[own]
        total = np.concatenate([[np.uint64(0)], np.cumsum((text + np.uint64(1)) * _powers(_BASE, len(text)))])
        words = (total[end] - total[begin]) * _powers(_INVERSE, len(text))[begin]
        words ^= words >> np.uint64(31)
        words *= np.uint64(0xBF58476D1CE4E5B9)
        words ^= words >> np.uint64(29)
        piece = np.searchsorted(first, begin, side="right") - 1
        return key[scored[self.order :]], np.cumsum(lengths) - lengths, words.view(np.int64), piece


def blocks(texts: list[str | None], order: int) -> Iterator[Block]:
    """Texts as blocks of about ``BLOCK_BYTES``.  Long texts are cut after a space, with their context kept."""
    block = Block(order)
    start = bytes([END]) * order
    for row, text in enumerate(texts):
        body = b" ".join((text or "").encode("utf-8", "replace").lower().split()) + bytes([END])
        at = 0
        while at < len(body):
            stop = len(body) if len(body) - at <= BLOCK_BYTES else body.find(b" ", at + BLOCK_BYTES) + 1 or len(body)
            block.add(row, (start + body[max(0, at - order) : at])[-order:] if order else b"", body[at:stop])
            at = stop
            if block.bytes >= BLOCK_BYTES:
                yield block
                block = Block(order)
    if block.rows:
        yield block


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in found])
    counts = np.concatenate([n for _, n in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(order: int):
    """Counts of (context, symbol) keys, kind 0, and of word hashes, kind 1, of the texts in a partition.

    Rows are (trained, text); what only texts that are not trained on have comes with count zero.
    """

    def send(kind: int, found: list) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(found)
        for i in range(0, len(keys), 1 << 16):
            own = keys[i : i + (1 << 16)]
            yield pa.record_batch({"kind": pa.array(np.full(len(own), kind, np.int8)), "key": pa.array(own), "n": pa.array(counts[i : i + (1 << 16)])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], []]
        size = [0, 0]
        for batch in batches:
            trained = batch.column(0).to_numpy(zero_copy_only=False)
            for use in (True, False):
                texts = batch.column(1).filter(pa.array(trained == use)).to_pylist()
                for block in blocks(texts, order):
                    keys, _, words, _ = block.keys()
                    ends = np.array([block.ends().sum() * use], np.int64)
                    for kind, (own, n) in ((0, np.unique(keys.view(np.int64), return_counts=True)), (1, np.unique(words, return_counts=True))):
                        found[kind].append((own, n * use))
                        size[kind] += len(own)
                    found[1].append((np.array([_END_WORD]), ends))
                    for kind in (0, 1):
                        if size[kind] > GATHERED_KEYS:
                            found[kind] = [_merged(found[kind])]
                            size[kind] = len(found[kind][0][0])
                            if size[kind] > GATHERED_KEYS // 2:
                                yield from send(kind, found[kind])
                                found[kind], size[kind] = [], 0
        for kind in (0, 1):
            if found[kind]:
                yield from send(kind, found[kind])

    return run


def _mask(size: int) -> np.int64:
    """The last ``size`` bytes of a key."""
    return np.int64((1 << 8 * size) - 1)


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys stand among sorted ones; -1 for those that aren't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Level:
    """The contexts of one length: the counts of what follows them, their totals and their numbers of symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.contexts, first = np.unique(keys >> 8, return_index=True)
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.symbols = np.diff(np.append(first, len(keys)))
        self.first = first

    def shorter(self, size: int) -> Level:
        """The level of ``size`` bytes of context, by the same counts."""
        keys, at = np.unique(self.keys & _mask(size + 1), return_inverse=True)
        return Level(keys, np.bincount(at, self.counts, len(keys)).astype(np.int64))


def log_probabilities(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of (context, symbol) keys, by the levels of contexts of no byte up to the longest.

    A context of total T and q distinct symbols gives a symbol of count c the share (c - 1/2) / T and the escape
    q / 2T.  After an escape the symbols of the longer context are excluded from T and q of the shorter one.
    What no context has seen is uniform over the bytes that have never been.
    """
    out, at = np.zeros(len(keys)), np.arange(len(keys))
    above, longer = np.full(len(keys), -1), None  # the context one byte longer whose symbols are ruled out
    for j in range(len(levels) - 1, -1, -1):
        level, key = levels[j], keys[at] & _mask(j + 1)
        hit, context = _place(level.keys, key), _place(level.contexts, key >> 8)
        total, symbols = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        seen = context >= 0
        total[seen], symbols[seen] = level.total[context[seen]], level.symbols[context[seen]]
        if longer is not None and (ruled := above >= 0).any():
            # What a longer context rules out here: the counts at this level of the symbols that it has.
            gone = level.counts[_place(level.keys, longer.keys & _mask(j + 1))]
            total[ruled] -= np.add.reduceat(gone, longer.first)[above[ruled]]
            symbols[ruled] -= longer.symbols[above[ruled]]
        found, missed = hit >= 0, (hit < 0) & seen & (symbols > 0)
        out[at[found]] += np.log10((level.counts[hit[found]] - 0.5) / total[found])
        out[at[missed]] += np.log10(symbols[missed] / (2.0 * total[missed]))
        at, above, longer = at[~found], context[~found], level
    out[at] -= np.log10(max(1, 256 - len(levels[0].keys)))
    return out


def _rated(shared, order: int, low: int):
    """log10 of the probability of all keys whose contexts agree in their last ``low + 1`` bytes, from their counts.

    All longer contexts of these keys are here; the shorter ones are in the broadcast level of ``low`` bytes.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, counts = (table.column(c).to_numpy() for c in ("key", "c"))
        by_key = np.argsort(keys)
        keys, counts = keys[by_key], counts[by_key]
        base = Level(*shared.value)
        levels = [base.shorter(j) for j in range(low)] + [base]
        if order > low:
            deepest = Level(keys[counts > 0], counts[counts > 0])
            levels += [deepest.shorter(j) for j in range(low + 1, order)] + [deepest]
        return pa.table({"key": pa.array(keys), "c": pa.array(counts), "value": pa.array(log_probabilities(levels, keys))})

    return run


class Lookup:
    """Position of 64-bit keys in a table by open addressing; -1 for keys that it lacks."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo, slot = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._home(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])]
        return found


class Common:
    """The values of the commonest keys and words, found by open addressing in tables that a worker builds once."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables, self.find = tables, {}

    def __call__(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is known, values of those that are)."""
        if kind not in self.find:
            self.find[kind] = Lookup(self.tables[kind][0])
        at = self.find[kind](keys)
        return at >= 0, self.tables[kind][1][at[at >= 0]]


def _listed(kind: int, keys: np.ndarray, rows: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    """Rarer keys, or words, with their numbers in each row."""
    by = np.lexsort((keys, rows))
    keys, rows = keys[by], rows[by]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
    n = len(first)
    empty = {c: pa.nulls(n, pa.float64() if "score" in c else pa.int64()) for c in ("n_tokens", "n_known", "n_bytes", "base_score", "score")}
    return pa.record_batch({"row": pa.array(rows[first]), "doc_id": pa.nulls(n, id_type)} | empty | {
        "kind": pa.array(np.full(n, kind, np.int8)), "key": pa.array(keys[first]), "n": pa.array(np.diff(np.append(first, len(keys)))),
    })


def _scored(shared, order: int, train_tokens: int, distinct: int):
    """Rows (doc_id, text) as their sums by the common keys and words, and the rarer ones of each, with their numbers.

    A partition's rows are numbered; a row of sums has a null kind.
    """
    cost = _word_cost(train_tokens, distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            sums = {c: np.zeros(n, np.int64) for c in ("n_tokens", "n_known", "n_bytes")} | {c: np.zeros(n) for c in ("base_score", "score")}
            for block in blocks(batch.column(1).to_pylist(), order):
                keys, _, words, piece = block.keys()
                rows = np.array(block.rows)
                ends = np.flatnonzero(block.ends())
                tokens = np.concatenate([words, np.full(len(ends), _END_WORD)])
                owner = np.concatenate([rows[piece], rows[ends]])
                of_key = np.repeat(rows, block.lengths)
                sums["n_tokens"] += np.bincount(owner, minlength=n)
                np.add.at(sums["n_bytes"], rows, block.lengths)
                for kind, own, whose in ((0, keys.view(np.int64), of_key), (1, tokens, owner)):
                    known, found = common(kind, own)
                    if kind:
                        sums["n_known"] += np.bincount(whose[known][found > 0], minlength=n)
                        sums["base_score"] += np.bincount(whose[known], np.log10(found + 1.0) - cost, n)
                    else:
                        sums["score"] += np.bincount(whose[known], found, n)
                    if not known.all():
                        yield _listed(kind, own[~known], number + whose[~known], batch.column(0).type)
            empty = {"kind": pa.nulls(n, pa.int8()), "key": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64())}
            yield pa.record_batch({"row": pa.array(number + np.arange(n)), "doc_id": batch.column(0)} | {c: pa.array(v) for c, v in sums.items()} | empty)
            number += n

    return run


def _word_cost(train_tokens: int, distinct: int) -> float:
    return float(np.log10(train_tokens + distinct + 1)) if train_tokens + distinct else 0.0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _rank(count: str) -> Column:
    """A whole number that grows with a count, 256 at most."""
    return F.floor(4 * F.log2(F.col(count) + 1)).cast("int")


def _least_rank(values: DataFrame, kind: int, most: int) -> int:
    """The least rank from which there are not more than ``most`` values of a kind."""
    ranks = values.where(F.col("kind") == kind).groupBy("rank").agg(F.count("*").alias("n")).orderBy(F.desc("rank")).collect()
    total = 0
    for r in ranks:
        total += r["n"]
        if total > most:
            return r["rank"] + 1
    return 0


def trained_values(rows: DataFrame, order: int = ORDER, rated_keys: int = RATED_KEYS) -> DataFrame:
    """The model as a staged table ``(kind, key, c, value, rank)`` of all that occurs in ``rows(trained, text)``.

    Kind 0 is each (context, symbol) key with its count and the log10 of its probability, kind 1 each word with its
    count twice.  Keys are dealt out by the last bytes of their contexts, so that all longer contexts of a key are in
    its group; a group has ``rated_keys`` on average, and what shares ``LOW + 1`` bytes is 2 ** 24 keys at most.
    """
    counts = staged(rows.select("trained", "text").mapInArrow(_counted(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("c")), "counts")
    low = min(LOW, order)
    keys = counts.where("kind = 0")
    base = keys.where("c > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (low + 1)) - 1)).alias("key")).agg(F.sum("c").alias("c")).toArrow()
    at, n = (base.column(c).to_numpy().astype(np.int64) for c in ("key", "c"))
    shared = rows.sparkSession.sparkContext.broadcast((np.sort(at), n[np.argsort(at)]))
    near = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * (low + 1)) - 1))
    groups = max(1, -(-keys.count() // rated_keys))
    rated = keys.select("key", "c", F.pmod(F.xxhash64(near), F.lit(groups)).alias("near")).groupBy("near").applyInArrow(_rated(shared, order, low), "key long, c long, value double")
    words = counts.where("kind = 1").select(F.lit(1).cast("byte").alias("kind"), "key", "c", F.col("c").cast("double").alias("value"))
    return staged(rated.select(F.lit(0).cast("byte").alias("kind"), "key", "c", "value").unionByName(words).withColumn("rank", _rank("c")), "model")


def ppm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, common_keys: int = COMMON_KEYS, common_words: int = COMMON_WORDS, rated_keys: int = RATED_KEYS,
) -> DataFrame:
    """Score every text by a byte-context trie that is trained on the rows which are not held out.

    A text is its words (runs without ASCII white space, A-Z lower-cased) with one space between them and one
    end symbol.  The longest known context of up to ``order`` bytes predicts each byte; an escape, half a count for
    each of the context's distinct symbols, leads to the next shorter one, where the symbols just ruled out are
    excluded from the counts; after order 0 the bytes not seen in training are uniform.  ``score`` is log10 of
    the text's probability.  ``base_score`` is that of single words with one added to each count,
    ``train_tokens`` counts the words and ends trained on, and ``n_known`` a text's tokens among them.

    The model grows with the corpus and stays a table (:func:`trained_values`).  At most ``common_keys`` and
    ``common_words`` of its commonest values are broadcast, which give most of every text; what else a text has is
    counted by row and key and joined with the rest of the table, so no task, nor the driver, holds a model.
    Texts are read twice, whatever the model's size.
    Whole texts count, in blocks of bounded memory.  Null texts are empty ones (one end symbol); null ids are
    trained on; repeated rows count as often as they occur; without training rows every byte is uniform; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = trained_values(rows.select((~held_out(F.col("doc_id"))).alias("trained"), "text"), order, rated_keys)
    total, distinct = model.where("kind = 1 and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = [_least_rank(model, kind, most) for kind, most in enumerate((common_keys, common_words))]
    tables = []
    for kind in (0, 1):
        own = model.where((F.col("kind") == kind) & (F.col("rank") >= least[kind])).select("key", "value").toArrow()
        tables.append((own.column("key").to_numpy().astype(np.int64), own.column("value").to_numpy().astype(np.float64)))
    shared = docs.sparkSession.sparkContext.broadcast(Common(tables))
    sums = "n_tokens long, n_known long, n_bytes long, base_score double, score double"
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {sums}, kind byte, key long, n long"
    parts = staged(rows.mapInArrow(_scored(shared, order, int(total), distinct), schema), "scores")
    rest = model.where(F.when(F.col("kind") == 0, F.col("rank") < least[0]).otherwise(F.col("rank") < least[1])).select("kind", "key", "value")
    found = parts.where("kind is not null").select("row", "kind", "key", "n").join(rest, ["kind", "key"])
    word, cost = F.col("kind") == 1, _word_cost(int(total), distinct)
    more = found.groupBy("row").agg(
        F.sum(F.when(~word, F.col("n") * F.col("value"))).alias("_score"), F.sum(F.when(word, F.col("n") * (F.log10(F.col("value") + 1) - cost))).alias("_base"),
        F.sum(F.when(word & (F.col("value") > 0), F.col("n"))).alias("_known"),
    )
    out = parts.where("kind is null").join(more, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", plus("n_known", "_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base_score", "_base"), plus("score", "_score"), "n_bytes",
    )
