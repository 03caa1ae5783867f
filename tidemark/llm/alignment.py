"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

The tokens of a slice of documents are two list columns. They are flattened with the index of the document they came
from, byte lengths are taken by id and summed up within each document, and a hash join on (document, byte end) leaves
the places where both tokenizers end a token. These places cut a text into groups, and each pair of tokens that end
there is a link.

Links are stored once. How often a pair of ids is linked is counted by ``Table.group_by`` in every batch, and Spark
merges the counts. In a linked pair the bytes of one token end with those of the other, so the ids of all links are
at most as many pairs as both vocabularies have bytes: that bound is checked before the counts are broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import documents, prepare, query
from tidemark.llm.packing import Encoder
from tidemark.llm.tables import written
from tidemark.llm.token_counts import byte_symbols, vocabulary_path

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: A link is named by the id of the first tokenizer times this, and the id of the second.
WIDTH = 1 << 32
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


def byte_pieces(model: str) -> list[bytes]:
    """The bytes of each id of a sentence-piece model: its piece, a lower block as a blank, byte pieces as their byte."""
    library = pieces_library(model)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return [
        bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
    ]


def byte_entries(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    back = {c: b for b, c in byte_symbols().items()}
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    names = [""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        names[i] = name
    return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


@lru_cache(maxsize=1)
def level_library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    # special strings inside texts are plain text
    library.encode_special_tokens = True
    return library


@lru_cache(maxsize=1)
def pieces_library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def lists_of(parts: list[list[int]]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(parts), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


class Side:
    """Tokens of one tokenizer: byte lengths and bytes by id, and the decimal name of each id."""

    def __init__(self, entries: list[bytes]):
        self.bytes = pa.array(entries, pa.binary())
        self.lengths = pa.array([len(e) for e in entries], pa.int64())
        self.names = pa.array([str(i) for i in range(len(entries))], pa.string())

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of all tokens of each list."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.bytes.take(ids.values)), b"")

    def ends(self, ids: pa.ListArray, name: str) -> pa.Table:
        """A row per token: document, byte end in it, id and place among all tokens."""
        doc = pc.list_parent_indices(ids)
        running = pc.cumulative_sum(self.lengths.take(ids.flatten()))
        # what had run up before the document's first token
        before = np.concatenate([[0], running.to_numpy(zero_copy_only=False)])[ids.offsets.to_numpy()[:-1]]
        end = pc.subtract(running, pa.array(before).take(doc))
        return pa.table({"doc": doc, "end": end, name: ids.flatten(), f"at_{name}": np.arange(len(doc))})

    def groups(self, ids: pa.ListArray, cuts: np.ndarray) -> pa.Array:
        """Names of the ids of each group, joined by commas; a group ends with the token at its cut."""
        offsets = np.concatenate([[0], cuts + 1]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.names.take(ids.flatten())), ",")


class Aligner:
    """Both tokenizers and their tables."""

    def __init__(self, vocabulary: str, model: str):
        self.pieces = pieces_library(model)
        # the rank form of the same file gives the same ids for less work, and takes special strings as plain text
        self.ranked = Encoder._ranked(vocabulary)
        self.level = level_library(vocabulary) if self.ranked is None else None
        self.a, self.b = Side(byte_entries(vocabulary)), Side(byte_pieces(model))

    def level_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the byte-level vocabulary, by its rank form where its ids follow the order of its merges."""
        if self.ranked is not None:
            return list(map(self.ranked.encode_ordinary, texts))
        return [e.ids for e in self.level.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both tokenizers; none for empty texts and for texts that a tokenizer does not keep byte for byte."""
        spaced = [" " + t for t in texts]
        a = lists_of(self.level_ids(spaced))
        b = lists_of(self.pieces.encode(texts, num_threads=1))
        want = pa.array(spaced, pa.string()).cast(pa.binary())
        same = pc.and_(pc.equal(self.a.joined(a), want), pc.equal(self.b.joined(b), want))
        kept = pc.and_(same, pa.array([bool(t) for t in texts]))
        empty = pa.scalar([], a.type)
        return pc.if_else(kept, a, empty), pc.if_else(kept, b, empty)

    def aligned(self, texts: list[str]) -> list[pa.Array]:
        """The columns of ``ALIGNED`` for each text."""
        a, b = self.tokens(texts)
        n = len(texts)
        links = self.a.ends(a, "a").join(self.b.ends(b, "b"), keys=["doc", "end"], join_type="inner", use_threads=False)
        links = links.sort_by([("at_a", "ascending"), ("at_b", "ascending")])
        doc, end = links["doc"].to_numpy(), links["end"].to_numpy()
        per_doc = np.bincount(doc, minlength=n)
        # the last link of a byte end closes a group
        last = np.ones(len(doc), bool)
        last[:-1] = (doc[1:] != doc[:-1]) | (end[1:] != end[:-1])
        groups = np.bincount(doc[last], minlength=n)
        names = pc.binary_join_element_wise(
            self.a.groups(a, links["at_a"].to_numpy()[last]), self.b.groups(b, links["at_b"].to_numpy()[last]), "|"
        )
        ends = np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names), ";")
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in whole.to_pylist()]
        codes = links["a"].to_numpy().astype(np.int64) * WIDTH + links["b"].to_numpy()
        starts = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
        return [
            pc.list_value_length(a).cast(pa.int64()), pc.list_value_length(b).cast(pa.int64()),
            pa.array(groups, pa.int64()), pa.array(per_doc, pa.int64()),
            pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(starts), pa.array(codes)),
        ]


@lru_cache(maxsize=1)
def aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def slices(batch: pa.RecordBatch):
    """Parts of a batch with about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    running, start, held = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(running, held + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start, held = stop, running[stop - 1]


def align(docs: DataFrame, vocabulary: str, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Groups and links of every whole text, stored.

    A row per row of ``docs``: key, n_a and n_b (tokens of the byte-level vocabulary over a blank and the text, and of
    the sentence-piece model over the text), n_groups, n_links, groups_sha256, and ``links``, the ids of each link as
    a * 2^32 + b in the order of the text. Texts that are null, empty or not kept byte for byte by a tokenizer have no
    tokens: zeros, '' and no links. A null key stays null, repeated rows are aligned each, other columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        made = aligner(vocabulary, model)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *made.aligned(texts)], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, f"key {kind}, {ALIGNED}")).withColumnRenamed("key", key)


def link_counts(aligned: DataFrame) -> DataFrame:
    """How often each pair of ids is linked: a, b, n, and whether n is the highest of its b (``best``)."""

    def count(batches):
        for batch in batches:
            part = pa.table({"link": batch.column(0).flatten()}).group_by("link", use_threads=False).aggregate([([], "count_all")])
            yield from part.select(["link", "count_all"]).rename_columns(["link", "n"]).to_batches()

    merged = aligned.select("links").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    pairs = merged.select(F.shiftright("link", 32).alias("a"), (F.col("link") % WIDTH).alias("b"), "n")
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def most_pairs(vocabulary: str, model: str) -> int:
    """No more pairs than this can be linked: of two tokens that end together, one is an end of the other."""
    return sum(map(len, byte_entries(vocabulary))) + sum(map(len, byte_pieces(model)))


def scored(aligned: DataFrame, vocabulary: str, model: str, key: str = "doc_id") -> DataFrame:
    """``aligned`` with ``n_best`` (links whose count is the highest of their second id, ties included) and
    ``count_sum`` (sum of the counts of all links)."""
    counts = written(link_counts(aligned))
    bound, found = most_pairs(vocabulary, model), counts.count()
    if found > bound:
        raise ValueError(f"{found} linked pairs, but at most {bound} are possible")
    table = counts.select((F.col("a") * WIDTH + F.col("b")).alias("link"), "n", "best").toArrow().sort_by("link")
    spark = aligned.sparkSession
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("link", "n", "best")))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        link, n, best = known.value
        for batch in batches:
            links = batch.column(batch.num_columns - 1)
            at = np.searchsorted(link, links.flatten().to_numpy())
            starts = links.offsets.to_numpy() - links.offsets[0].as_py()

            def sums(values):
                return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[starts]))

            yield pa.record_batch([*batch.columns[:-1], sums(best[at]), sums(n[at])], ["key", *names, "n_best", "count_sum"])

    kind = aligned.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.select(F.col(key).alias("key"), *names, "links").mapInArrow(run, schema).withColumnRenamed("key", key)


@query()
def op13_token_alignment(spark, sf_dir):
    vocabulary, model = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
    rows = scored(align(documents(spark, sf_dir), vocabulary, model), vocabulary, model)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
