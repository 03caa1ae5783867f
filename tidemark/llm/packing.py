"""Best-fit packing with certified bin counts.

Pieces are dealt at random to partitions of bounded size and packed there by best-fit decreasing. Dual feasible
functions give a lower bound on the bins of each partition; a partition that meets it is certified. The others, and
bins less than half full, exchange their documents: they are dealt anew and packed again, and the new packing is
kept where it needs fewer bins.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import documents, map_rows, query, texts_of
from tidemark.llm.tables import written
from tidemark.llm.token_counts import PIECES, byte_symbols, vocabulary_path

#: Words whose ids a task remembers.
MOST_WORDS = 1_200_000
PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"
PACKED = "id long, length long, round int, part long, bin long, offset long, fill long, bins long, bound long"


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers; ids between blanks are remembered.

    Where the file's ids follow the order of its merges, ids of single words come from the rank form of the same
    vocabulary, which gives the same ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.words: dict[str, bytes | bool] = {}
        self.ranked = self._ranked(path)
        self.stops = {c: self.stretch(c) for c in ",."}
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise ValueError("ids are kept in the byte order of the machine")

    @staticmethod
    def _ranked(path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in merges]
        if made != sorted(set(made)) or (made and min(made) < 256):
            return None
        import tiktoken

        back = {c: b for b, c in byte_symbols().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in ids.items() if all(c in back for c in t)}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The library's ids, without begin, end or added special tokens."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch without added tokens."""
        return array("I", self.ranked.encode_ordinary(text)).tobytes() if self.ranked else self.encode(text)

    def word(self, word: str) -> bytes | bool:
        """Ids of a blank and a word; False where the blank stands beside other white space."""
        if not word or word[0].isspace() or word[-1].isspace():
            return False
        if word[-1] in self.stops and word[:-1].isalpha():
            # letters and what follows them are pieces of their own
            core = self.words.get(word[:-1])
            if core is None:
                core = self.words[word[:-1]] = self.stretch(" " + word[:-1])
            return core + self.stops[word[-1]]
        return self.stretch(" " + word)

    def ids(self, texts: list[str]) -> list[bytes]:
        out, known = [], self.words
        for text in texts:
            c = [] if self.whole is not None and self.whole.search(text) else text.split(" ")
            # no piece of the byte-level rule crosses a blank that stands alone
            if not c or (len(c) > 1 and (c[0][-1:].isspace() or c[-1][:1].isspace() or (not c[-1] and not c[-2]))):
                out.append(self.encode(text))
                continue
            inner = c[1:-1]
            found = list(map(known.get, inner))
            if None in found:
                if len(known) > MOST_WORDS:
                    known.clear()
                for i, ids in enumerate(found):
                    if ids is None:
                        found[i] = known[inner[i]] = self.word(inner[i])
            if False in found:
                out.append(self.encode(text))
                continue
            head = self.stretch(c[0]) if c[0] else b""
            tail = self.stretch(" " + c[-1]) if len(c) > 1 else b""
            out.append(b"".join([head, *found, tail]))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text and its end id.

    Only longer documents are cut; their first piece may be shorter, the others are full. A null text is empty and
    gives one piece with the end id alone. A null key stays null, repeated rows give pieces of their own.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, tail = encoder(path), np.asarray([end_id], "<u4").tobytes()
        keys, all_ids = batch.column(0).to_pylist(), e.ids([t.decode("utf-8", "replace") for t in texts_of(batch)])
        out = []
        for key, ids in zip(keys, all_ids):
            ids += tail
            n = len(ids) // 4
            at, i = 0, 0
            while at < n:
                length = n % capacity or capacity if at == 0 else capacity
                out.append((key, i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                at, i = at + length, i + 1
        columns = list(zip(*out)) or [[]] * 5
        kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_rows(rows, ["doc_id", "text"], cut, PIECE.format(kind=kind))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length: longest first, each into the fullest bin that holds it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    bins = np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        # rooms that hold it, as bits; the lowest is the best fit
        fits = open_rooms >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b, used = capacity, used, used + 1
        bins[i] = b
        if left > length:
            room[left - length].append(b)
            open_rooms |= 1 << (left - length)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of bins by two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # small ones count nothing, those that only small ones fit beside count a whole bin
    many, mass = np.cumsum(count), np.cumsum(count * size)
    for small in range(1, capacity // 2 + 1):
        whole = many[-1] - many[capacity - small]
        own = mass[capacity - small] - mass[small - 1]
        best = max(best, int(whole + -(-own // capacity)))
    # rounding to k-ths of a bin
    for k in range(1, 33):
        exact = (size * (k + 1)) % capacity == 0
        twice = np.where(exact, size * k, (size * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((count * twice).sum()) // (k * capacity)))
    return best


def packed(items: DataFrame, capacity: int, round_: int, parts: int) -> DataFrame:
    """Each partition of (id, length) packed by itself."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id"], ascending=[False, True])
        lengths = pdf["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(fill)[:-1]])
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - start[bins[order]]
        return pd.DataFrame({
            "id": pdf["id"], "length": lengths, "round": np.int32(round_), "part": pdf["part"], "bin": bins, "offset": offset,
            "fill": fill[bins], "bins": len(fill), "bound": lower_bound(lengths, capacity),
        })

    part = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(parts))
    return items.select("id", "length", part.alias("part")).groupBy("part").applyInPandas(pack, PACKED)


def pack(items: DataFrame, capacity: int = 2048, rows_per_part: int = 50_000, rounds: int = 2) -> DataFrame:
    """Bins for (id, length): columns of ``PACKED``.

    Lengths are 1 to ``capacity``. Each partition holds about ``rows_per_part`` rows, whatever the size of the table.
    """
    total = items.count()
    now = written(packed(items, capacity, 0, max(1, -(-total // rows_per_part))))
    for r in range(1, rounds + 1):
        loose = (F.col("bins") > F.col("bound")) | (F.col("fill") * 2 < capacity)
        state = now.where(loose).agg(F.count("*").alias("n"), F.sum(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        if not state["n"]:
            break
        again = written(packed(now.where(loose).select("id", "length"), capacity, r, max(1, -(-state["n"] // rows_per_part))))
        if again.agg(F.sum(F.when(F.col("offset") == 0, 1))).first()[0] >= state["bins"]:
            break
        # what stays has lost bins, so its partition is certified for what it holds
        now = written(now.where(~loose).unionByName(again))
    return now


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every piece with its sequence and its place there.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    # the ids are written with the rows, so that a task that runs again reads the same ones
    table = written(pieces(docs, path, capacity).withColumn("id", F.monotonically_increasing_id()))
    places = pack(table.select("id", "length"), capacity)
    # rounds, partitions and bins are far below these factors
    sequence = (F.col("round") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    return table.join(places.select("id", sequence, "offset"), "id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), vocabulary_path())
