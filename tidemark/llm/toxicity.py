"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Examples are a bounded sample of labelled rows. Their terms (words and beginnings of words) are weighed by IDF over
all documents; the index keeps, for each term, its postings in blocks of examples with the largest weight of each
block. A text's blocks are opened in the order of their upper bounds until no closed one can change the nearest
``k``, so the neighbours are exact. Votes weighted by cosine are calibrated to the share of toxic rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import documents, held_out, list_array, map_rows, query, signed, texts_of
from tidemark.llm.tables import written

#: Bounds of the fit: labelled rows of each class, terms kept, examples of one block; blocks opened at a time.
MOST_EXAMPLES, MOST_TERMS, BLOCK, OPENED = 6_000, 8_192, 64, 8
#: A term tells the classes apart if it is in this many and this share of the toxic examples at least, and its log odds are above this.
LEAST_HELD, LEAST_SHARE, LEAST_ODDS = 4, 0.003, 2.5
#: Lengths in code points of the beginnings of words that are terms beside the words.
STEMS = (4, 5, 6, 7, 8, 9)
#: Nearest examples that vote, and votes of the prior rate that each decision starts from.
NEAREST, PRIOR = 15, 2.0
#: Above this score a text is toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=200_000)
def _terms_of_word(word: str) -> tuple[int, ...]:
    out = [xxhash.xxh3_64_intdigest("=" + word)]
    out += [xxhash.xxh3_64_intdigest("^" + word[:k]) for k in STEMS if len(word) > k]
    return tuple(out)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of a text's terms and how often each occurs."""
    names = [t for w in _WORD.findall(text.lower()) for t in _terms_of_word(w)]
    return np.unique(np.asarray(names, np.uint64), return_counts=True)


def labelled(labels: DataFrame) -> DataFrame:
    """Ids and labels that may be learned from."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
    return rows.where(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & ~held_out("_id")).distinct()


def sample(rows: DataFrame, most: int) -> tuple[DataFrame, float]:
    """At most ``most`` rows of each class, those of the smallest hash of their id, and the share of toxic rows."""
    counts = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30))
    out = rows.limit(0)
    for label, n in sorted(counts.items()):
        # a little above the share wanted, then cut to the bound
        limit = int(min(1.0, 1.1 * most / n + 0.001) * (1 << 30))
        out = out.unionByName(rows.where((F.col("_toxic") == label) & (place < limit)).orderBy(place, "_id").limit(most))
    return out, counts.get(1, 0) / max(1, sum(counts.values()))


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``lo`` to ``hi``, one after the other."""
    size = hi - lo
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Block-max inverted index over examples; a fixed-size object by the bounds of the fit."""

    def __init__(self, names: np.ndarray, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float):
        order = np.argsort(names)
        self.names, self.idf, self.rate = names[order], idf[order], rate
        weighed = [self._weigh(*v) for v in vectors]
        # examples with the same leading terms side by side, so that blocks differ in their maxima
        lead = [tuple(t[np.argsort(-w, kind="stable")[:4]].tolist()) for t, w in weighed]
        place = sorted(range(len(weighed)), key=lambda i: (-1, ) if not lead[i] else lead[i])
        self.labels = np.asarray(labels, np.float64)[place] if len(place) else np.zeros(0)
        weighed = [weighed[i] for i in place]
        self.n, self.blocks = len(weighed), -(-len(weighed) // BLOCK)
        at = np.repeat(np.arange(self.n), [len(t) for t, _ in weighed])
        term = np.concatenate([t for t, _ in weighed]) if weighed else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in weighed]) if weighed else np.zeros(0)
        order = np.lexsort((at, term))
        self.at, self.weight = at[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.names) + 1))
        # a posting block: the postings of one term in one block of examples, with their largest weight
        key = term[order] * max(self.blocks, 1) + self.at // BLOCK
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        self.head = np.append(heads, len(key))
        self.head_block = (self.at[heads] // BLOCK) if len(heads) else heads
        self.head_max = np.maximum.reduceat(self.weight, heads) if len(heads) else np.zeros(0)
        self.head_start = np.searchsorted(heads, self.start)

    def _weigh(self, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights on the unit sphere."""
        if not len(self.names) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        known = self.names[at] == names
        t = at[known].astype(np.int64)
        w = (1 + np.log(counts[known])) * self.idf[t]
        return t, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, names: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Examples of the ``k`` largest cosines above 0, largest first, and the number of blocks opened.

        Ties go to the lower place in the index.
        """
        t, w = self._weigh(names, counts)
        if not len(t):
            return np.zeros(0, np.int64), np.zeros(0), 0
        # posting blocks of all terms, and their bounds added up by block of examples
        h = spans(self.head_start[t], self.head_start[t + 1])
        q = np.repeat(w, self.head_start[t + 1] - self.head_start[t])
        bound = np.bincount(self.head_block[h], q * self.head_max[h], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best_i, best_s, opened = np.zeros(0, np.int64), np.zeros(0), 0
        # blocks are opened a few at a time
        for at in range(0, len(order), OPENED):
            group = order[at : at + OPENED]
            floor = best_s[k - 1] if len(best_s) >= k else 0.0
            group = group[bound[group] >= floor - 1e-12] if floor > 0 else group[bound[group] > 0]
            if not len(group):
                break
            opened += len(group)
            is_open = np.full(self.blocks, -1)
            is_open[group] = np.arange(len(group))
            here = is_open[self.head_block[h]] >= 0
            lo, hi = self.head[h[here]], self.head[h[here] + 1]
            p = spans(lo, hi)
            place = is_open[self.at[p] // BLOCK] * BLOCK + self.at[p] % BLOCK
            score = np.bincount(place, np.repeat(q[here], hi - lo) * self.weight[p], len(group) * BLOCK)
            full = np.flatnonzero(score > 0)
            ids = group[full // BLOCK] * BLOCK + full % BLOCK
            all_i, all_s = np.concatenate([best_i, ids]), np.concatenate([best_s, score[full]])
            keep = np.lexsort((all_i, -np.round(all_s, 12)))[:k]
            best_i, best_s = all_i[keep], all_s[keep]
        return best_i, best_s, opened

    def score(self, text: str) -> tuple[float, int, float, int]:
        """Calibrated share of toxic votes, nearest example, its cosine, blocks opened."""
        near, cosine, opened = self.nearest(*terms(text), NEAREST)
        if not len(near):
            return 0.0, -1, 0.0, 0
        votes = cosine / np.maximum(1e-6, 1.05 - cosine)
        prior = PRIOR * self.rate
        value = ((votes * self.labels[near]).sum() + prior) / (votes.sum() + PRIOR)
        return float(min(1.0, max(0.0, value))), int(near[0]), float(cosine[0]), opened


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Index of a bounded sample; the rate and document frequencies cover all rows."""
    spark = docs.sparkSession
    ids, share = sample(labelled(labels), MOST_EXAMPLES)
    # the ids are bounded, so the texts need no exchange
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(written(ids)), "_id").select("text", "_toxic")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t.decode("utf-8", "replace")) for t in texts_of(batch)]
        return pa.record_batch([list_array([signed(n) for n, _ in found]), list_array([c for _, c in found]), batch.column(1)], ["names", "counts", "label"])

    shape = "names array<long>, counts array<long>, label int"
    chosen = written(map_rows(rows, ["text", "_toxic"], vectors, shape))
    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    held = chosen.select("label", F.explode("names").alias("name")).groupBy("name").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    # terms that tell the classes apart, by the weight of evidence
    gain = odds * (F.col("bad") / max(bad, 1) - F.col("good") / max(good, 1))
    telling = held.where((F.col("bad") >= max(LEAST_HELD, LEAST_SHARE * bad)) & (odds > LEAST_ODDS)).orderBy(gain.desc(), "name").limit(MOST_TERMS)
    names = np.sort(np.asarray([r["name"] for r in telling.select("name").collect()], np.int64).view(np.uint64))

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = np.zeros(len(names) + 1, np.int64)
        for text in texts_of(batch):
            own = terms(text.decode("utf-8", "replace"))[0]
            count[np.flatnonzero(np.isin(names, own, assume_unique=True))] += 1
        count[-1] = batch.num_rows
        some = np.flatnonzero(count)
        return pa.record_batch([pa.array(some), pa.array(count[some])], ["at", "n"])

    docs_with = map_rows(docs.select(F.col("text").cast("string").alias("text")), ["text"], frequencies, "at long, n long")
    df = np.zeros(len(names) + 1, np.int64)
    for r in docs_with.groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5))
    # only the terms kept go to the driver
    kept = spark.sparkContext.broadcast(names)

    def reduce(batches):
        for pdf in batches:
            out = [np.isin(np.asarray(n, np.int64).view(np.uint64), kept.value) for n in pdf["names"]]
            yield pd.DataFrame({"names": [np.asarray(n)[m] for n, m in zip(pdf["names"], out)], "counts": [np.asarray(c)[m] for c, m in zip(pdf["counts"], out)], "label": pdf["label"]})

    examples = chosen.mapInPandas(reduce, shape).collect()
    examples.sort(key=lambda r: (r["label"], r["names"], r["counts"]))
    found = [(np.asarray(r["names"], np.int64).view(np.uint64), np.asarray(r["counts"], np.int64)) for r in examples]
    return Index(names, idf, found, np.asarray([r["label"] for r in examples]), float(share))


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted, the nearest example, its cosine and the blocks opened.

    A null or empty text, and one without a known term, scores 0. Repeated rows are scored each; input columns of the names
    added are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    added = {"score": "double", "example": "long", "cosine": "double", "blocks": "long", "predicted": "int"}
    rows = docs.drop(*added)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t.decode("utf-8", "replace")) for t in texts_of(batch)]
        columns = list(zip(*found)) or [[]] * 4
        made = [pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.float64(), pa.int64()))]
        made.append(pa.array([int(s >= threshold) for s in columns[0]], pa.int32()))
        return pa.record_batch([*batch.columns, *made], [*batch.schema.names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{k} {v}" for k, v in added.items()])
    return map_rows(rows, rows.columns, scored, schema)


@query()
def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, index).select("doc_id", held_out().alias("held_out"), "score", "predicted", "example", "cosine")
