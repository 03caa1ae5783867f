"""Removal of repeated passages by recompression.

Rounds rename a text's words: first runs of one symbol, then pairs of a left and a right symbol, get a name made from the
names they hold. Names depend on content alone, so all texts are named alike without an exchange, and equal passages
get equal symbols but near their ends. How far a symbol's name depends on its surroundings is carried along (its
support); a window takes as anchor the least name among the highest-level symbols whose support lies in it, together with
the words that such a support may cover, so equal windows have equal anchors. Consecutive windows of one anchor are a stretch, the unit of exchange: an anchor of one
stretch is unique, stretches of one name that are all alike repeat as a whole, and only where stretches differ
are their windows compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import WORD, WordIds, documents, factors, map_rows, mixed, query, texts_of
from tidemark.llm.tables import apart, written

#: Words of a window, rounds of renaming and the widest support of an anchor in words.
WINDOW, ROUNDS, SUPPORT = 35, 2, 10
#: Kinds of stretches that share their anchor: repeated as a whole, to be compared by window, and repeated but compared for its like.
REPEATS, DIFFERS, SPEAKS = 0, 1, 2
_NONE = np.uint64(2**64 - 1)
_FAR = np.int64(2**40)
_ROLL = factors(1, 35)[0]
_MARK = factors(3 * 64, 10)


def powers(n: int, base: np.uint64, known: dict[int, np.ndarray]) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    if len(known.get(int(base), ())) <= n:
        size = 1 << max(10, int(n).bit_length())
        known[int(base)] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
    return known[int(base)]


_UNROLL = np.uint64(pow(int(_ROLL), -1, 2**64))


def rolled(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Names of the word sequences from ``lo`` to ``hi``."""
    up, down = powers(len(ids), _ROLL, known), powers(len(ids), _UNROLL, known)
    total = np.concatenate([[np.uint64(0)], np.cumsum(ids * up[: len(ids)], dtype=np.uint64)])
    return mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Symbols:
    """Symbols of one level: names, and the words their names depend on."""

    def __init__(self, name: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.name, self.lo, self.hi = name, lo, hi

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Start of the support to the left of each symbol and end of that to its right; far away where there is none."""
        return np.concatenate([[-_FAR], self.lo[:-1]]), np.concatenate([self.hi[1:], [_FAR]])

    def runs(self, mark: np.uint64) -> "Symbols":
        """Each maximal run as one symbol; that it ends there depends on its neighbours."""
        before, after = self.neighbours()
        head = np.flatnonzero(np.concatenate([[True], self.name[1:] != self.name[:-1]]))
        tail = np.concatenate([head[1:], [len(self.name)]]) - 1
        size = tail - head + 1
        name = np.where(size > 1, mixed(self.name[head] + size.astype(np.uint64) * mark), self.name[head])
        return Symbols(name, np.minimum(self.lo[head], before[head]), np.maximum(self.hi[tail], after[tail]))

    def pairs(self, mark: np.uint64, other: np.uint64) -> "Symbols":
        """Each left symbol joined with the right one behind it; a bit of the name tells the side."""
        before, after = self.neighbours()
        right = (mixed(self.name ^ mark) & np.uint64(1)).astype(bool)
        first = np.concatenate([~right[:-1] & right[1:], [False]])
        second = np.concatenate([[False], first[:-1]])
        following = np.concatenate([self.name[1:], self.name[:1]])
        name = np.where(first, mixed(self.name * mark + following * other), self.name)
        hi = np.where(first, after, np.where(right, self.hi, np.maximum(self.hi, after)))
        lo = np.where(right, np.minimum(self.lo, before), self.lo)
        return Symbols(name[~second], lo[~second], hi[~second])


def levels(ids: np.ndarray, rounds: int) -> list[Symbols]:
    """Symbols of a text from the words upward."""
    at = np.arange(len(ids), dtype=np.int64)
    out = [Symbols(ids, at, at + 1)]
    for r in range(rounds):
        out.append(out[-1].runs(_MARK[3 * r]).pairs(_MARK[3 * r + 1], _MARK[3 * r + 2]))
    return out


def least_places(value: np.ndarray, width: int, n: int) -> np.ndarray:
    """Leftmost place of the least value in ``width`` places from each of the first ``n``."""
    at, size = np.arange(len(value)), 1
    while size * 2 <= width:
        left, right = at[:-size], at[size:]
        at = np.where(value[right] < value[left], right, left)
        size *= 2
    left, right = at[:n], at[width - size : width - size + n]
    return np.where(value[right] < value[left], right, left)


def stretches(ids: np.ndarray, window: int, rounds: int, support: int, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each stretch of a text."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = window - support + 1
    anchor, place, first = np.full(n, _NONE), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for depth, s in reversed(list(enumerate(levels(ids, rounds)))):
        lack = anchor == _NONE
        if not lack.any():
            break
        sound = (s.lo >= 0) & (s.hi - s.lo <= support)
        value = np.full(len(ids), _NONE)
        np.minimum.at(value, s.lo[sound], mixed(s.name[sound] + np.uint64(depth + 1)))
        at = least_places(value, width, n)
        found = lack & (value[at] != _NONE)
        anchor[found] = value[at][found]
        place[found] = at[found] * (rounds + 1) + depth
        first[found] = at[found]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    # all windows of a stretch hold the words that the support may cover; short symbols meet by chance, these words hardly do
    return rolled(ids, first[head], first[head] + support, known), head, np.diff(np.append(head, n))


class Reader:
    """Word names of a task, and powers for rolling names."""

    def __init__(self):
        self.words, self.known = WordIds(), {}

    def ids(self, text: bytes) -> tuple[list[bytes], np.ndarray]:
        words = text.split()
        return words, mixed(self.words.of(words))


def signed_list(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def all_stretches(rows: DataFrame, window: int, rounds: int, support: int) -> DataFrame:
    """(doc_id, hash, anchor, name, start, size) of every stretch of (doc_id, hash, text)."""
    made: dict[str, Reader] = {}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        reader = made.setdefault("reader", Reader())
        anchors, names, starts, sizes, long = [], [], [], [], []
        for text in texts_of(batch):
            _, ids = reader.ids(text)
            anchor, start, size = stretches(ids, window, rounds, support, reader.known)
            anchors.append(anchor)
            names.append(rolled(ids, start, start + size + window - 1, reader.known) if len(start) else anchor)
            starts.append(start)
            sizes.append(size)
            long.append(len(start))
        pick = pa.array(np.repeat(np.arange(batch.num_rows), long))
        return pa.record_batch(
            [batch.column(0).take(pick), batch.column(1).take(pick), signed_list(flat(anchors, np.uint64)), signed_list(flat(names, np.uint64)),
             pa.array(flat(starts, np.int64).astype(np.int32)), pa.array(flat(sizes, np.int64).astype(np.int32))],
            ["doc_id", "hash", "anchor", "name", "start", "size"],
        )

    return map_rows(rows, ["doc_id", "hash", "text"], cut, "doc_id long, hash long, anchor long, name long, start int, size int")


def covered(n: int, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


OUT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def finished(words: list[bytes], gone: np.ndarray) -> tuple[int, int, bytes, list[dict]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    kept = words if not spans else [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), int(gone.sum()), b" ".join(kept), spans


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def drop_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """Texts without passages that repeat: doc_id, n_words, n_removed, kept, spans.

    Each word goes that lies in a window of ``window`` words whose word sequence starts anywhere else too, the same
    document included; ``spans`` are the word ranges removed, ``kept`` the other words joined by one blank. A null text has
    no words. Every row is a document of its own: a repeated row repeats all its windows. A null doc_id stays
    null. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    parts = written(all_stretches(rows, window, rounds, support))
    # an anchor of several stretches: all alike, or of more than one kind
    held = parts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high")).where("n > 1")
    held = apart(held.select("anchor", (F.col("low") != F.col("high")).alias("differ")))
    # a document's id may be null, so it goes by id and hash with null as a value
    shared = parts.join(held, "anchor")
    shared = apart(shared.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), "hash", "start", "size", "anchor", "name", "differ"))
    # of stretches of one name the first speaks for all of them where windows are compared
    place = F.struct("_id", "hash", "start")
    alike = shared.where("differ").groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    named = shared.where("differ").join(alike, ["anchor", "name"], "left")
    kind = F.when(F.col("n").isNull(), DIFFERS).when(F.col("first") == place, SPEAKS).otherwise(REPEATS)
    found = named.select("_id", "hash", F.struct("start", "size", kind.alias("kind")).alias("s"))
    found = found.unionByName(shared.where("NOT differ").select("_id", "hash", F.struct("start", "size", F.lit(REPEATS).alias("kind")).alias("s")))
    lists = found.groupBy("_id", "hash").agg(F.collect_set("s").alias("found"))
    lists = apart(lists.select("_id", "hash", *[F.col(f"found.{c}").alias(c) for c in ("start", "size", "kind")]))
    both = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-1))).join(lists, ["_id", "hash"], "left")

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents whose stretches decide are finished; of the others the text goes on."""
        out = []
        for text, s, z, d in zip(texts_of(batch), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
            words = text.split()
            if s and any(x != REPEATS for x in d):
                out.append((None, None, text, None, s, z, d))
                continue
            gone = covered(len(words), np.asarray(s or [], np.int64), np.asarray(z or [], np.int64), window)
            out.append((*finished(words, gone), None, None, None))
        columns = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.large_binary(), SPAN, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        made[2] = made[2].cast(pa.large_string()).cast(pa.string())
        return pa.record_batch([batch.column(0), batch.column(1), *made], ["doc_id", "hash", "n_words", "n_removed", "kept", "spans", "start", "size", "kind"])

    shape = OUT.replace("doc_id long", "doc_id long, hash long") + ", start array<int>, size array<int>, kind array<int>"
    state = apart(map_rows(both, ["doc_id", "hash", "text", "start", "size", "kind"], first, shape))
    done = state.where("start IS NULL").select("doc_id", "n_words", "n_removed", "kept", "spans")
    open_ = state.where("start IS NOT NULL").select("doc_id", "hash", F.col("kept").alias("text"), "start", "size", "kind")
    made: dict[str, Reader] = {}

    def one_by_one(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Names of the windows of stretches that differ, and of those that speak for their like."""
        reader = made.setdefault("reader", Reader())
        names, places, long = [], [], []
        for text, s, z, d in zip(texts_of(batch), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
            _, ids = reader.ids(text)
            at = np.concatenate([np.arange(a, a + b) for a, b, c in zip(s, z, d) if c != REPEATS])
            names.append(rolled(ids, at, at + window, reader.known))
            places.append(at)
            long.append(len(at))
        pick = pa.array(np.repeat(np.arange(batch.num_rows), long))
        return pa.record_batch([batch.column(0).take(pick), batch.column(1).take(pick), signed_list(flat(names, np.uint64)), pa.array(flat(places, np.int64).astype(np.int32))], ["doc_id", "hash", "name", "at"])

    windows = map_rows(open_, ["doc_id", "hash", "text", "start", "size", "kind"], one_by_one, "doc_id long, hash long, name long, at int")
    again = windows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    hits = apart(windows.join(again, "name").select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), "hash", "at").groupBy("_id", "hash").agg(F.collect_set("at").alias("at")))

    def last(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, s, z, d, at in zip(texts_of(batch), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            words = text.split()
            at = np.asarray(at or [], np.int64)
            s = np.concatenate([np.asarray([a for a, c in zip(s, d) if c != DIFFERS], np.int64), at])
            z = np.concatenate([np.asarray([b for b, c in zip(z, d) if c != DIFFERS], np.int64), np.ones(len(at), np.int64)])
            out.append(finished(words, covered(len(words), s, z, window)))
        columns = list(zip(*out)) or [[]] * 4
        made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.large_binary(), SPAN))]
        made[2] = made[2].cast(pa.large_string()).cast(pa.string())
        return pa.record_batch([batch.column(0), *made], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    rest = open_.withColumn("_id", F.coalesce("doc_id", F.lit(-1))).join(hits, ["_id", "hash"], "left")
    return done.unionByName(map_rows(rest, ["doc_id", "text", "start", "size", "kind", "at"], last, OUT))


REPEATS_SQL = f"""WITH wd AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 wi AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g FROM wd, range(1, len(w) - {WINDOW - 2}) r(i)),
 rp AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM wi WHERE g IN (SELECT g FROM wi GROUP BY g HAVING count(*) > 1)),
 gone AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM rp GROUP BY doc_id),
 ex AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM wd),
 kp AS (SELECT ex.doc_id, string_agg(v, ' ' ORDER BY ex.p) AS kept FROM ex LEFT JOIN rp ON rp.doc_id = ex.doc_id AND rp.p = ex.p WHERE rp.p IS NULL GROUP BY 1)
 SELECT wd.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
 FROM wd LEFT JOIN gone USING (doc_id) LEFT JOIN kp USING (doc_id)"""


@query(sql=REPEATS_SQL)
def op10_substring_dedup(spark, sf_dir):
    rows = drop_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
