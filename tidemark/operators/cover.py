"""Windows of token sequences that cover enough of a passage, for many pairs at a time.

A task holds a block of passages as an inverted index and looks all tokens of a few sequences up in it.  Windows are
found from the places of shared tokens by a running sum, and compared with bit vectors of one bit per passage token:
one step per token of the window for all windows of a slice together.  Nothing is sampled and no window is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = 64
# Fixed values of the search: how much longer than its passage a window is.
WINDOW_SCALE, EXTRA_WINDOW = 1.3, 8
# Hits and pairs looked at together, and words of bit vectors worked together.
HITS, PAIRS, WORDS = 1 << 20, 1 << 16, 1 << 16


class Passages:
    """Passages as entries, one per different token of a passage: its letter there, how often it is in, and its places as bits."""

    def __init__(self, sequences: Sequence[Sequence[str]]):
        self.n = np.array([len(s) for s in sequences], np.int64)
        self.words = np.maximum(1, -(-self.n // WORD))
        self.codes, rows, bits = [], [], []
        for p, sequence in enumerate(sequences):
            letters: dict[str, list[int]] = {}
            for i, t in enumerate(sequence):
                if t is not None:
                    letters.setdefault(t, []).append(i)
            number = {t: k for k, t in enumerate(letters, 1)}
            self.codes.append(np.array([number.get(t, -1) for t in sequence], np.int32))
            width = int(self.words[p])
            for t, places in letters.items():
                rows.append((t, p, number[t], len(places), len(bits)))
                mask = sum(1 << i for i in places)
                bits += [mask >> WORD * j & (1 << WORD) - 1 for j in range(width)]
        columns = list(zip(*rows)) or [()] * 5
        self.tokens = list(columns[0])
        self.passage, self.letter, self.times, self.bits_at = (np.array(c, np.int64) for c in columns[1:])
        self.bits = np.array(bits, np.uint64)

    def window(self, pairs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Length of the search windows."""
        n = self.n[pairs]
        return np.minimum(np.minimum(n + EXTRA_WINDOW, np.floor(n * WINDOW_SCALE).astype(np.int64)), m)


class Index(Passages):
    """Passages by token, to look all of them up at once."""

    def __init__(self, sequences: Sequence[Sequence[str]]):
        super().__init__(sequences)
        known = {t: k for k, t in enumerate(dict.fromkeys(self.tokens))}
        self.vocabulary = pa.array(list(known), pa.string())
        self.token = np.array([known[t] for t in self.tokens], np.int64)

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some of the passages by token, and where those of each token begin."""
        entries = np.flatnonzero((self.passage >= low) & (self.passage < high))
        entries = entries[np.argsort(self.token[entries], kind="stable")]
        counts = np.bincount(self.token[entries], minlength=len(self.vocabulary))
        return entries, np.concatenate([[0], np.cumsum(counts)])


class Pairs:
    """Pairs of a passage and a sequence with the places at which the sequence has a token of the passage.

    ``pair`` and ``place`` are sorted, ``entry`` points to the passage's token; ``passage`` and ``m`` are per pair.
    """

    def __init__(self, book: Passages, passage, m, pair, place, entry):
        self.book, self.passage, self.m = book, passage, m
        self.pair, self.place, self.entry = pair, place, entry
        self.n, self.w = book.n[passage], book.window(passage, m)

    def only(self, keep: np.ndarray) -> tuple[Pairs, np.ndarray]:
        """The pairs of a mask, and their old numbers."""
        hits = keep[self.pair]
        number = np.cumsum(keep) - 1
        old = np.flatnonzero(keep)
        return Pairs(self.book, self.passage[old], self.m[old], number[self.pair[hits]], self.place[hits], self.entry[hits]), old

    def dense(self, coverage: float) -> np.ndarray:
        """Mask of the pairs with as many hits in the length of a window as the bound asks for."""
        # a little less than the share, so that rounding leaves none out
        need = np.maximum(1, np.ceil(self.n * coverage - 1e-9).astype(np.int64))
        last = np.arange(len(self.pair)) + need[self.pair] - 1
        inside = np.flatnonzero(last < len(self.pair))
        last = last[inside]
        mine = self.pair[inside]
        good = (self.pair[last] == mine) & (self.place[last] - self.place[inside] < self.w[mine])
        keep = np.zeros(len(self.passage), bool)
        keep[mine[good]] = True
        return keep & (self.n > 0) & (self.w > 0)

    def windows(self, coverage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, start and overlap of every window that covers enough.

        The k-th place of a token counts for the windows that hold it but not the place ``times`` before it, as a window
        gets no more of a token than the passage has.
        """
        cells = self.m - self.w + 2
        base = np.cumsum(cells) - cells
        group = self.pair * (int(self.book.letter.max(initial=0)) + 1) + self.book.letter[self.entry]
        order = np.argsort(group, kind="stable")
        group, pair, place = group[order], self.pair[order], self.place[order]
        times = self.book.times[self.entry[order]]
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0)) if len(at) else at
        before = at - times
        low = np.maximum(place - self.w[pair] + 1, 0)
        low = np.where(before >= first, np.maximum(low, place[np.maximum(before, 0)] + 1), low)
        high = np.minimum(place, self.m[pair] - self.w[pair])
        fits = low <= high
        total = int(cells.sum())
        change = np.bincount((base[pair] + low)[fits], minlength=total) - np.bincount((base[pair] + high + 1)[fits], minlength=total)
        overlap = np.cumsum(change)
        found = np.flatnonzero((overlap > 0) & (overlap / np.repeat(self.n, cells) >= coverage))
        pair = np.searchsorted(base, found, side="right") - 1
        return pair, found - base[pair], overlap[found]

    def verbatim(self, pairs: np.ndarray) -> np.ndarray:
        """First place of the whole passage in the sequence for each of some pairs, -1 for none."""
        starts, ends = np.searchsorted(self.pair, pairs), np.searchsorted(self.pair, pairs, side="right")
        out = np.full(len(pairs), -1, np.int64)
        for i, (p, a, b) in enumerate(zip(pairs, starts, ends)):
            row = np.zeros(self.m[p], np.int32)
            row[self.place[a:b]] = self.book.letter[self.entry[a:b]]
            text, wanted = row.tobytes(), self.book.codes[self.passage[p]].tobytes()
            at = text.find(wanted)
            while at % 4 and at >= 0:
                at = text.find(wanted, at + 1)
            out[i] = at // 4 if at >= 0 else -1
        return out

    def compare(self, pair: np.ndarray, start: np.ndarray, measure) -> np.ndarray:
        """``measure`` of passages and windows, slice by slice; windows are dealt by the length of their passage's bits."""
        out = np.zeros(len(pair), np.int64)
        words = self.book.words[self.passage]
        for width in np.unique(words[pair]):
            of = np.flatnonzero(words[pair] == width)
            mine = np.flatnonzero(words == width)
            number = np.zeros(len(words), np.int64)
            number[mine] = np.arange(len(mine))
            base = np.cumsum(self.m[mine]) - self.m[mine]
            hits = np.flatnonzero(words[self.pair] == width)
            bits = np.zeros((width, int(self.m[mine].sum())), np.uint64)
            bits[:, base[number[self.pair[hits]]] + self.place[hits]] = self.book.bits[
                self.book.bits_at[self.entry[hits]] + np.arange(width)[:, None]
            ]
            of = of[np.argsort(-self.w[pair[of]], kind="stable")]
            step = max(1, WORDS // int(width))
            for a in range(0, len(of), step):
                part = of[a : a + step]
                out[part] = measure(bits, base[number[pair[part]]] + start[part], self.w[pair[part]], self.n[pair[part]])
        return out


def _active(w: np.ndarray) -> Iterator[tuple[int, int]]:
    """Step and number of windows that are that long, for falling lengths."""
    for k in range(int(w.max(initial=0))):
        yield k, int(np.searchsorted(-w, -k, side="left"))


def _ones(n: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``n`` bits of vectors of ``width`` words."""
    left = np.clip(n - WORD * np.arange(width)[:, None], 0, WORD)
    full = left == WORD
    return np.where(full, ~np.uint64(0), (np.uint64(1) << np.where(full, 0, left).astype(np.uint64)) - np.uint64(1))


def common(bits: np.ndarray, at: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Longest common subsequences, one bit per passage token: a cleared bit is a token that counts."""
    rows = _ones(n, len(bits))
    full = rows.copy()
    for k, some in _active(w):
        carry = np.zeros(some, np.uint64)
        for j in range(len(bits)):
            row = rows[j, :some]
            hit = row & bits[j, at[:some] + k]
            one = row + hit
            both = one + carry
            carry = (one < row).astype(np.uint64) | (both < one)
            rows[j, :some] = both | (row - hit)
    return n - np.bitwise_count(rows & full).sum(axis=0, dtype=np.int64)


def edits(bits: np.ndarray, at: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances by bit vectors of the differences along a column (Myers)."""
    one, top = np.uint64(1), np.uint64(WORD - 1)
    width = len(bits)
    up, down = np.full((width, len(n)), ~np.uint64(0)), np.zeros((width, len(n)), np.uint64)
    score, end = n.copy(), ((n - 1) % WORD).astype(np.uint64)
    for k, some in _active(w):
        plus, minus = np.ones(some, np.uint64), np.zeros(some, np.uint64)
        for j in range(width):
            pv, mv = up[j, :some], down[j, :some]
            eq = bits[j, at[:some] + k]
            xv = eq | mv
            eq = eq | minus
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if j == width - 1:
                last = end[:some]
                score[:some] += (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
            out_plus, out_minus = ph >> top, mh >> top
            ph, mh = ph << one | plus, mh << one | minus
            up[j, :some], down[j, :some] = mh | ~(xv | ph), ph & xv
            plus, minus = out_plus, out_minus
    return score


def _kept(pair: np.ndarray, start: np.ndarray, approx: np.ndarray, share: float, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of pair, distance and start, cut to the first of each pair; and the place of each in its pair."""
    order = np.lexsort((start, approx, pair))
    ids = pair[order]
    begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(ids)])
    rank = np.arange(len(ids)) - np.repeat(begin, count)
    keep = rank < np.repeat(np.maximum(at_least, np.floor(count * share).astype(np.int64)), count)
    return order[keep], rank[keep]


class Found:
    """What is found in some pairs: windows, then verbatim places, ranked windows and the best one."""

    def __init__(self, pairs: Pairs, coverage: float):
        self.pairs, self.old = pairs.only(pairs.dense(coverage))
        self.pair, self.start, self.overlap = self.pairs.windows(coverage)
        self.whole = np.unique(self.pair[self.overlap == self.pairs.n[self.pair]])

    def only(self, starts: list[list[int] | None]) -> None:
        """Leave no windows but those at known starts of each pair."""
        known = np.array([self._name(i, x) for i, p in enumerate(self.old) for x in starts[p] or ()], np.int64)
        keep = np.isin(self._name(self.pair, self.start), known)
        self.pair, self.start, self.overlap = self.pair[keep], self.start[keep], self.overlap[keep]

    def _name(self, pair, start):
        return pair * (int(self.pairs.m.max(initial=0)) + 1) + start

    def rows(self, exact_first: bool) -> None:
        """Find the verbatim places; windows of such pairs are left out."""
        self.place = np.full(len(self.old), -1, np.int64)
        self.place[self.whole] = self.pairs.verbatim(self.whole)
        if exact_first:
            near = self.place[self.pair] < 0
            self.pair, self.start, self.overlap = self.pair[near], self.start[near], self.overlap[near]

    def rank(self, share: float, at_least: int) -> None:
        self.rows(True)
        n, w = self.pairs.n[self.pair], self.pairs.w[self.pair]
        approx = n + w - 2 * self.pairs.compare(self.pair, self.start, common)
        keep, self.place_in = _kept(self.pair, self.start, approx, share, at_least)
        self.pair, self.start, self.overlap, self.approx = self.pair[keep], self.start[keep], self.overlap[keep], approx[keep]

    def best(self, share: float, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pair, start, end, distance and whether it is verbatim, for every pair with a place."""
        self.rank(share, at_least)
        n, w = self.pairs.n[self.pair], self.pairs.w[self.pair]
        lead = np.flatnonzero(self.place_in == 0)
        distance = np.full(len(self.pair), np.iinfo(np.int64).max)
        distance[lead] = self.pairs.compare(self.pair[lead], self.start[lead], edits)
        bound = np.zeros(len(self.old), np.int64)
        bound[self.pair[lead]] = distance[lead]
        # a window needs the longer size less the common part at least; a later one must be below the first to win
        least = np.maximum(n, w) - (n + w - self.approx) // 2
        rest = np.flatnonzero((self.place_in > 0) & (least < bound[self.pair]))
        distance[rest] = self.pairs.compare(self.pair[rest], self.start[rest], edits)
        order = np.lexsort((self.place_in, distance, self.pair))
        ids = self.pair[order]
        win = order[np.r_[True, ids[1:] != ids[:-1]]] if len(ids) else order
        exact = np.flatnonzero(self.place >= 0)
        pair = np.r_[self.pair[win], exact]
        start = np.r_[self.start[win], self.place[exact]]
        size = np.r_[w[win], self.pairs.n[exact]]
        return pair, start, start + size, np.r_[distance[win], np.zeros(len(exact), np.int64)], np.r_[np.zeros(len(win), bool), np.ones(len(exact), bool)]


def all_pairs(index: Index, tokens: pa.ListArray) -> Iterator[tuple[Pairs, np.ndarray]]:
    """The pairs of all passages with the sequences of a batch, a bounded number of hits at a time, and their sequences' numbers."""
    count = len(index.n)
    if not count or not len(tokens):
        return
    flat, offsets = tokens.flatten(), np.r_[0, np.cumsum(np.array(pc.fill_null(pc.list_value_length(tokens), 0), np.int64))]
    ids = np.array(pc.fill_null(pc.index_in(flat, value_set=index.vocabulary), -1), np.int64)
    whole = index.part(0, count)
    held = np.diff(whole[1])
    each = np.where(ids >= 0, held[ids], 0) if len(held) else np.zeros(len(ids), np.int64)
    hits = np.r_[0, np.cumsum(each)][offsets]
    a = 0
    while a < len(tokens):
        b = max(a + 1, min(a + PAIRS // count, int(np.searchsorted(hits, hits[a] + HITS, side="right")) - 1))
        parts = -(-int(hits[b] - hits[a]) // (4 * HITS)) or 1
        edges = np.linspace(0, count, min(parts, count) + 1).astype(np.int64)
        for low, high in zip(edges[:-1], edges[1:]):
            entries, begin = whole if len(edges) == 2 else index.part(low, high)
            yield _hits(index, ids, offsets, a, b, entries, begin, int(low), int(high))
        a = b


def _hits(index: Index, ids, offsets, a: int, b: int, entries, begin, low: int, high: int) -> tuple[Pairs, np.ndarray]:
    held = np.diff(begin)
    at = np.flatnonzero(ids[offsets[a] : offsets[b]] >= 0) + offsets[a]
    counts = held[ids[at]]
    skip = np.cumsum(counts) - counts
    entry = entries[np.arange(int(counts.sum())) + np.repeat(begin[ids[at]] - skip, counts)]
    sequence = np.searchsorted(offsets, at, side="right") - 1
    place = np.repeat(at - offsets[sequence], counts)
    pair = np.repeat(sequence - a, counts) * (high - low) + index.passage[entry] - low
    # the small type is sorted by counting
    order = np.argsort(pair.astype(np.uint16) if (b - a) * (high - low) <= PAIRS else pair, kind="stable")
    numbers = np.arange((b - a) * (high - low))
    rows = a + numbers // (high - low)
    m = (offsets[1:] - offsets[:-1])[rows]
    return Pairs(index, low + numbers % (high - low), m, pair[order], place[order], entry[order]), rows


def own_pairs(passages: pa.ListArray, sequences: pa.ListArray) -> Iterator[tuple[Pairs, np.ndarray]]:
    """Each passage of a batch with the sequence of its own row, and the numbers of the rows."""
    lengths = np.array(pc.fill_null(pc.list_value_length(sequences), 0), np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]
    flat = sequences.flatten()
    a = 0
    while a < len(sequences):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + HITS, side="right")) - 1)
        book = Passages([x or [] for x in passages.slice(a, b - a).to_pylist()])
        words = pa.array(list(dict.fromkeys(book.tokens)), pa.string())
        token = np.array(pc.fill_null(pc.index_in(pa.array(book.tokens, pa.string()), value_set=words), -1), np.int64)
        ids = np.array(pc.fill_null(pc.index_in(flat.slice(offsets[a], offsets[b] - offsets[a]), value_set=words), -1), np.int64)
        pair = np.repeat(np.arange(b - a), lengths[a:b])
        place = np.arange(len(ids)) - np.repeat(offsets[a:b] - offsets[a], lengths[a:b])
        known = book.passage * (len(words) + 1) + token
        order = np.argsort(known)
        wanted = pair * (len(words) + 1) + ids
        to = np.searchsorted(known, wanted, sorter=order)
        entry = order[np.minimum(to, len(order) - 1)] if len(order) else to
        hit = np.flatnonzero((ids >= 0) & (known[entry] == wanted)) if len(order) else np.zeros(0, np.int64)
        yield Pairs(book, np.arange(b - a), lengths[a:b], pair[hit], place[hit], entry[hit]), np.arange(a, b)
        a = b
