"""Language identification by the nearest of several centroids per language.

Texts are normalised TF-IDF vectors of hashed n-grams of bytes within words. Each language has a few centroids,
clustered on a bounded sample of its labelled rows; document frequencies cover all rows that may be learned from. A
text goes to the language of the centroid of the largest cosine and is rejected where that centroid is farther than
its own members ever are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import documents, held_out, map_rows, query, texts_of

#: Buckets of n-grams, rows of a language that centroids are fitted on, centroids of a language and steps of the fit.
WIDTH, MOST_ROWS, CENTROIDS, STEPS = 4096, 1_000, 4, 12
#: A text is rejected if it is farther from its centroid than this times the farthest member.
REACH = 1.25
#: Cosines this far apart differ by a factor e in the score.
HEAT = 0.02
#: ASCII that is no letter parts words; bytes of other scripts stay.
_PARTED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_BLANKS = re.compile(rb" +")


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed runs of one to three bytes of the lower-cased words."""
    data = _BLANKS.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_PARTED) + b" ")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = (two[:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    two = (two * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    return np.bincount(np.concatenate([b % WIDTH, two % WIDTH, three % WIDTH]), minlength=WIDTH)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """A row of unit length for each text."""
    x = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        c = gram_counts(t)
        some = np.flatnonzero(c)
        x[i, some] = np.log1p(c[some]) * idf[some]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids on the sphere and the largest cosine distance of a member of each."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        # the row farthest from the chosen ones
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(steps):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].mean(axis=0)
                c[j] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    near = x @ c.T
    own = np.argmax(near, axis=1)
    far = np.asarray([1 - near[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(c))])
    return c, far


class Model:
    """Centroids of all languages; its size is bounded by the parameters of the fit."""

    def __init__(self, idf: np.ndarray, langs: list[str], which: np.ndarray, c: np.ndarray, far: np.ndarray):
        self.idf, self.langs, self.which, self.c, self.far = idf, langs, which, c, far

    def predict(self, texts: list[str | None]) -> list[tuple[str, str, float, float, bool]]:
        """Language or ``und``, nearest language, score, cosine distance, whether it is rejected."""
        out = []
        sound = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        found = {}
        if sound and len(self.langs):
            near = vectors([texts[i] for i in sound], self.idf) @ self.c.T
            by_lang = np.stack([near[:, self.which == j].max(axis=1) for j in range(len(self.langs))], axis=1)
            best = np.argmax(near, axis=1)
            share = np.exp((by_lang - by_lang.max(axis=1, keepdims=True)) / HEAT)
            share /= share.sum(axis=1, keepdims=True)
            for r, i in enumerate(sound):
                j, distance = self.which[best[r]], float(1 - near[r, best[r]])
                found[i] = (self.langs[j], float(share[r, j]), distance, distance > REACH * self.far[best[r]])
        for i in range(len(texts)):
            if i in found:
                lang, score, distance, rejected = found[i]
                out.append(("und" if rejected else lang, lang, score, distance, bool(rejected)))
            else:
                out.append(("und", "und", 0.0, 1.0, True))
        return out


def fit(docs: DataFrame) -> Model:
    """Model learned from text and language of the rows that may be learned from; null text or language is left out."""
    spark = docs.sparkSession
    rows = docs.where(~held_out()).select(F.col("text").cast("string").alias("text"), F.col("lang").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(WIDTH + 1, np.int64)
        for t in texts_of(batch):
            n[np.flatnonzero(gram_counts(t.decode("utf-8", "replace")))] += 1
        n[-1] = batch.num_rows
        return pa.record_batch([pa.array(np.arange(WIDTH + 1)), pa.array(n)], ["at", "n"])

    df = np.zeros(WIDTH + 1, np.int64)
    for r in map_rows(rows, ["text"], frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        df[r["at"]] = r["n"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5)).clip(0).astype(np.float32) + np.float32(0.01)

    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    # a little above the share wanted, then cut to the bound in the group
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = rows.join(F.broadcast(counts), "lang").where(place <= (1.2 * MOST_ROWS / F.col("_n") + 0.001) * (1 << 30)).select("lang", "text", place.alias("place"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "text"]).head(MOST_ROWS)
        c, far = centroids(vectors(list(pdf["text"]), idf), CENTROIDS, STEPS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": list(c.astype(np.float64)), "far": far})

    found = sample.groupBy("lang").applyInPandas(fitted, "lang string, c array<double>, far double").orderBy("lang", "far", "c").collect()
    langs = sorted({r["lang"] for r in found})
    which = np.asarray([langs.index(r["lang"]) for r in found], np.int64)
    c = np.asarray([r["c"] for r in found], np.float32).reshape(len(found), WIDTH)
    return Model(idf, langs, which, c, np.asarray([r["far"] for r in found]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, nearest, score, distance, rejected.

    ``lang_pred`` is ``und`` where the text is null, has no letter or is too far from its centroid. ``nearest`` is
    ``und`` in the first two cases only. Repeated rows get a result each; input columns of the names added are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": "string", "nearest": "string", "score": "double", "distance": "double", "rejected": "boolean"}
    rows = docs.drop(*added)

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.predict([t.decode("utf-8", "replace") for t in texts_of(batch)])
        columns = list(zip(*found)) or [[]] * 5
        made = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
        return pa.record_batch([*batch.columns, *made], [*batch.schema.names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{k} {v}" for k, v in added.items()])
    return map_rows(rows, rows.columns, told, schema)


@query()
def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")
