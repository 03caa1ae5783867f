"""Benchmark decontamination by SimHash windows of the items' sizes.

Sizes form a ladder, so that items of about one size share their windows: an item is cut to the step below nine tenths
of its words, at its start, in its middle and at its end, and every window of a text of that many words gets a
64-bit SimHash of its words, weighed by their length. An edit or a lost word near one end then leaves a cut untouched. Four blocks of sixteen bits are looked up in tables that list the items whose block differs in two bits at
most: fingerprints that differ in up to eleven bits agree that far in one block at least, so none within the radius is missed.
Candidates are verified by the exact weighted similarity of their five-word shingles. Where a text's start or end cuts an item off,
and in texts shorter than a cut, candidates are the items of whose shingles the text has enough, so none is missed there by size.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import WordIds, documents, map_rows, mixed, query, shingles as shingle_names, texts_of

#: Largest distance of fingerprints; with four blocks it lets one block differ in two bits.
RADIUS, BLOCKS, BLOCK_BITS = 11, 4, 16
#: Least similarity, words of a shingle, most places between windows, and places around a candidate that are verified.
LEAST, SIZE, STRIDE, AROUND = 0.75, 5, 3, 3
#: Items looked up at a time; a larger benchmark is taken in blocks of so many.
MOST_ITEMS = 5_000
#: Words worked on at a time, and a number that every stride divides.
CHUNK, STRIDES = 1 << 14, 6
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_UPPER).split()


def weighed_shingles(words: list[bytes], size: int = SIZE) -> Counter:
    """Occurrences of each shingle times its letters; the whole sequence where it has fewer words."""
    size = min(size, len(words))
    found = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else Counter()
    return Counter({s: n * sum(map(len, s)) for s, n in found.items()})


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; 0 where both are empty."""
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def signed_bits(ids: np.ndarray, words: list[bytes], kind) -> np.ndarray:
    """Running sums of the weighed bits of the words; wrapping around does no harm to differences."""
    # bits are spread out once for each different word
    own, first, where = np.unique(ids, return_index=True, return_inverse=True)
    bits = np.unpackbits(mixed(own).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(kind)
    weight = np.minimum(np.fromiter(map(len, words), np.int64, len(words))[first], 12).astype(kind)
    total = np.zeros((len(words) + 1, 64), kind)
    np.cumsum(((2 * bits - 1) * weight[:, None])[where], axis=0, dtype=kind, out=total[1:])
    return total


def fingerprints(total: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    return np.packbits(total[at + size] - total[at] > 0, axis=1).view("<u8").ravel()


def grid_fingerprints(total: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Fingerprints of the windows at every ``stride`` places from the first on."""
    return np.packbits(total[size::stride] - total[: len(total) - size : stride] > 0, axis=1).view("<u8").ravel()


def near_blocks(radius: int) -> np.ndarray:
    """All block values of at most ``radius`` set bits."""
    return np.asarray([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(BLOCK_BITS), k)], np.uint16)


def ladder(n: int) -> int:
    """Words of an item's cuts: the largest step that is at most nine tenths of it; small items stay whole."""
    step = 1
    while (longer := max(step + 1, step * 6 // 5)) <= n * 9 // 10:
        step = longer
    return n if n < 10 else step


class Items:
    """Lookup tables of a block of benchmark items by their number of words."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.names = WordIds()
        # cuts by their size: item, its shingles, its words and the place of the cut
        self.groups: dict[int, list[tuple[int, Counter, int, int]]] = {}
        self.longest = 0
        prints: dict[int, list[np.uint64]] = {}
        # items of a shingle or more: item, shingles, words, places of each shingle; all their shingles by name
        self.whole: list[tuple[int, Counter, int, dict[int, list[int]]]] = []
        names, owner, weight = [], [], []
        for item, text in items:
            words = words_of(text)
            if words:
                n, size, shingles = len(words), ladder(len(words)), weighed_shingles(words)
                self.longest = max(self.longest, n)
                ids = self.names.of(words)
                if n > SIZE:
                    own = shingle_names(ids, SIZE)
                    places: dict[int, list[int]] = {}
                    for at, name in enumerate(own.tolist()):
                        places.setdefault(name, []).append(at)
                    names.append(own)
                    owner.append(np.full(len(own), len(self.whole)))
                    weight += [sum(map(len, words[i : i + SIZE])) for i in range(len(own))]
                    self.whole.append((item, shingles, n, places))
                total = signed_bits(ids, words, np.int64)
                for at in sorted({0, (n - size) // 2, n - size}):
                    self.groups.setdefault(size, []).append((item, shingles, n, at))
                    prints.setdefault(size, []).append(fingerprints(total, size, np.asarray([at]))[0])
        if self.whole:
            order = np.argsort(np.concatenate(names), kind="stable")
            self.owner, self.weight = np.concatenate(owner)[order], np.asarray(weight, np.float64)[order]
            self.held, first = np.unique(np.concatenate(names)[order], return_index=True)
            self.first = np.append(first, len(order))
            self.least = LEAST * np.bincount(self.owner, self.weight)
        self.kind = np.int16 if max(self.groups, default=0) * 12 < 2**15 else np.int64
        self.prints = {n: np.asarray(p, np.uint64) for n, p in prints.items()}
        self.tables = {n: self._tables(p) for n, p in self.prints.items()}

    @staticmethod
    def _tables(prints: np.ndarray) -> list[np.ndarray]:
        """For each set of up to 64 items a table for each block: the items near a block value, as bits."""
        near, out = near_blocks(RADIUS // BLOCKS), []
        for at in range(0, len(prints), 64):
            table = np.zeros((BLOCKS, 1 << BLOCK_BITS), np.uint64)
            for i, p in enumerate(prints[at : at + 64]):
                for b in range(BLOCKS):
                    value = np.uint16((int(p) >> (BLOCK_BITS * b)) & 0xFFFF)
                    table[b, near ^ value] |= np.uint64(1 << i)
            out.append(table)
        return out

    def candidates(self, own: np.ndarray, size: int, at: np.ndarray) -> list[tuple[int, int]]:
        """(place, item of the group) of all windows, by fingerprint and place, within the radius of an item."""
        out = []
        blocks = own.view("<u2").reshape(-1, BLOCKS)
        for k, table in enumerate(self.tables[size]):
            hit = table[0][blocks[:, 0]]
            for b in range(1, BLOCKS):
                hit = hit | table[b][blocks[:, b]]
            some, prints, near = np.flatnonzero(hit), self.prints[size], []
            hit = hit[some]
            # most windows have one bit or two, so the lowest bits of all go at a time
            while len(some):
                low = hit & (~hit + np.uint64(1))
                item = np.bitwise_count(low - np.uint64(1)).astype(np.int64) + 64 * k
                close = np.flatnonzero(np.bitwise_count(own[some] ^ prints[item]) <= RADIUS)
                near += zip(some[close].tolist(), item[close].tolist())
                hit = hit ^ low
                more = np.flatnonzero(hit)
                some, hit = some[more], hit[more]
            out += [(int(at[row]), item) for row, item in sorted(near)]
        return out

    def matches(self, texts: list[bytes]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text the items it holds: similarity, first word and words of the most similar window."""
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        batch: list[tuple[int, int, list[bytes]]] = []
        held = 0
        for d, text in enumerate(texts):
            words = words_of(text)
            # long texts are cut with an overlap that holds every window
            for at in range(0, max(1, len(words)), CHUNK):
                part = words[at : at + CHUNK + 2 * self.longest]
                # places of all strides are places of the whole batch if every part starts at one
                part += [b""] * (-len(part) % STRIDES)
                batch.append((d, at, part))
                held += len(part)
                if held >= CHUNK:
                    self._search(batch, found)
                    batch, held = [], 0
        self._search(batch, found)
        return found

    def _search(self, batch: list[tuple[int, int, list[bytes]]], found: list) -> None:
        words = [w for _, _, part in batch for w in part]
        if not words or not self.groups:
            return
        lengths = np.asarray([len(part) for _, _, part in batch])
        # a word is never empty, so what was added behind a part does not count
        starts, own = np.cumsum(lengths) - lengths, np.asarray([len(part) - part[-STRIDES:].count(b"") for _, _, part in batch])
        ends = starts + own
        end, begin = np.repeat(ends, lengths), np.repeat(starts, lengths)
        ids = self.names.of(words)
        total = signed_bits(ids, words, self.kind)

        def verify(item: int, shingles: Counter, place: int, n: int) -> None:
            value = similarity(weighed_shingles(words[place : place + n]), shingles) if n > 0 else 0.0
            if value >= LEAST:
                b = int(np.searchsorted(ends, place, side="right"))
                d, start = batch[b][0], batch[b][1] + place - int(begin[place])
                best = found[d].get(item)
                if best is None or (value, -start) > (best[0], -best[1]):
                    found[d][item] = (value, start, n)

        for item, shingles, place, n in self._cut_off(ids, ends, begin, end):
            verify(item, shingles, place, n)
        for size, group in self.groups.items():
            # every few places of a text, and its last window
            stride = max(1, min(STRIDE, size // 6))
            if len(words) < size:
                continue
            at = np.arange(0, len(words) + 1 - size, stride)
            inside = at + size <= end[at]
            last = (ends - size)[(own >= size) & ((own - size) % stride != 0)]
            prints = np.concatenate([grid_fingerprints(total, size, stride)[inside], fingerprints(total, size, last)])
            at = np.concatenate([at[inside], last])
            if not len(at):
                continue
            tried: dict[tuple[int, int], int] = {}
            for place, i in self.candidates(prints, size, at):
                _, _, n, cut = group[i]
                lo, hi = int(begin[place]), int(end[place])
                for p in range(place - cut - AROUND, place - cut + AROUND + 1):
                    # at the ends of a text its window is what there is of it
                    tried.setdefault((max(lo, min(p, hi - 1)), i), min(n, n + p - lo if p < lo else n, hi - max(lo, p)))
            for (place, i), n in tried.items():
                item, shingles, _, _ = group[i]
                verify(item, shingles, place, n)

    def _cut_off(self, ids: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(item, its shingles, place, words) of windows that a text's start or end cuts off, where the text has enough of the item.

        A similarity of ``LEAST`` needs that share of the item's weight at least.
        """
        if not self.whole or len(ids) < SIZE:
            return
        names = shingle_names(ids, SIZE)
        at = np.minimum(np.searchsorted(self.held, names), len(self.held) - 1)
        some = np.flatnonzero((self.held[at] == names) & (np.arange(len(names)) + SIZE <= end[: len(names)]))
        # each shingle once a text, with all its places in items
        text, shingle = np.divmod(np.unique(np.searchsorted(ends, some, side="right") * len(self.held) + at[some]), len(self.held))
        size = self.first[shingle + 1] - self.first[shingle]
        entry = np.repeat(self.first[shingle] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pair, where = np.unique(np.repeat(text, size) * len(self.whole) + self.owner[entry], return_inverse=True)
        weight = np.bincount(where, self.weight[entry], len(pair))
        for key in pair[weight >= self.least[pair % len(self.whole)] - 1e-6].tolist():
            t, k = divmod(key, len(self.whole))
            item, shingles, n, places = self.whole[k]
            hi = int(ends[t])
            lo = int(begin[hi - 1])
            near = {*range(lo, min(lo + n + AROUND, hi - SIZE + 1)), *range(max(lo, hi - n - AROUND), hi - SIZE + 1)}
            starts = {a - b + s for a in near for b in places.get(int(names[a]), ()) for s in range(-AROUND, AROUND + 1)}
            for p in sorted(starts):
                if p < lo or p + n > hi:
                    yield item, shingles, max(lo, p), min(hi, p + n) - max(lo, p)


def item_blocks(items: DataFrame) -> list[Items]:
    """The benchmark in blocks of ``MOST_ITEMS``; items without words are left out, those of one id count each."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    count = rows.count()
    blocks = max(1, -(-count // (MOST_ITEMS // 2)))
    out = []
    for b in range(blocks):
        # by hash, so that a block holds about half the bound; the bound is checked
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).limit(MOST_ITEMS + 1).collect()
        if len(part) > MOST_ITEMS:
            raise ValueError("a block of benchmark items is too large: are there many equal items?")
        out.append(Items(sorted(((r["item_id"], r["text"].encode()) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, words, similarity: the most similar window of each item that a text holds.

    Null and empty texts hold none; repeated rows give rows each. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def told(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keys, out = batch.column(0).to_pylist(), []
            for key, found in zip(keys, shared.value.matches(texts_of(batch))):
                out += [(key, item, start, n, value) for item, (value, start, n) in found.items()]
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "words", "similarity"])

        part = map_rows(rows, ["doc_id", "text"], told, "doc_id long, item_id long, start long, words int, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all columns stay."""
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not found for found in shared.value.matches(texts_of(batch))], pa.bool_()))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        docs = map_rows(docs, docs.columns, clean, schema)
    return docs


@query()
def op7_decontamination(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
