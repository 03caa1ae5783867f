"""Token counts by byte-pair merging, without token ids.

Each piece of text is merged by a heap of adjacent pairs and a linked list of symbols: the pair of the lowest rank
goes first, and the count is the number of initial symbols less the number of merges. Counts of pieces are remembered
up to a bound, so a task's memory does not grow with its input; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import documents, map_rows, query, texts_of

#: Pieces of the byte-level vocabulary, as its pre-tokenizer cuts them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered in a task.
MOST_PIECES = 600_000
#: A blank beside other white space: what is cut there depends on the neighbour.
BESIDE = regex.compile(r"\s[ ]|[ ]\s")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Counts of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or odd:
            raise ValueError("only plain byte-level pair vocabularies are counted")
        symbols = byte_symbols()
        names: dict[str, int] = {symbols[b]: b for b in range(256)}
        # rank and result of each pair of symbols
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = names.setdefault(left + right, len(names))
            self.pairs[names[left], names[right]] = (rank, made)
        whole = [t["content"] for t in spec.get("added_tokens", ())]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take their neighbours along are not counted")
        self.whole = regex.compile("|".join(regex.escape(t) for t in sorted(whole, key=len, reverse=True))) if whole else None
        self.cut = regex.compile(PIECES)
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Number of symbols left of ``data`` when no pair can be merged."""
        n = len(data)
        symbol = list(data)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            found = pairs.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = right[i]
            # the pair is stale if either side has been merged since
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                found = pairs.get((made, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
            h = left[i]
            if h >= 0:
                found = pairs.get((symbol[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
            merges += 1
        return n - merges

    def piece(self, piece: str) -> int:
        count = self.pieces.get(piece)
        if count is None:
            count = self.merged(piece.encode())
            if len(piece) <= 64:
                if len(self.pieces) >= MOST_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = count
        return count

    def stretch(self, text: str) -> int:
        return sum(map(self.piece, self.cut.findall(text)))

    def word(self, word: str) -> int:
        """Count of a blank and the stretch up to the next blank."""
        count = self.words.get(word)
        if count is None:
            count = self.stretch(" " + word)
            if len(word) <= 64:
                if len(self.words) >= MOST_PIECES:
                    self.words.clear()
                self.words[word] = count
        return count

    def plain(self, text: str) -> int:
        if BESIDE.search(text):
            return self.stretch(text)
        # no piece crosses a blank that stands alone, so stretches between blanks are counted apart
        first, *rest = text.split(" ")
        known = self.words.get
        total = self.stretch(first)
        for w in rest:
            count = known(w)
            total += self.word(w) if count is None else count
        return total

    def count(self, text: str) -> int:
        if self.whole is None:
            return self.plain(text)
        parts = self.whole.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bytes and tokens of every whole text.

    A row per row of ``docs``: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). A null text counts as
    empty (0 tokens), a null key stays null, repeated rows are counted each, other columns are not read.
    """

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, m = texts_of(batch), merger(path)
        counts = [m.count(t.decode("utf-8", "replace")) for t in texts]
        return pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    out = map_rows(rows, ["key", "text"], counted, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query()
def op1_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), vocabulary_path())
