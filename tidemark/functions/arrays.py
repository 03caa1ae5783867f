"""Functions over array columns: masks, normalised scores, padding, collapsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.grid import _c


def array_total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v.cast("double"))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def softmax(x) -> Column:
    top = F.array_max(_c(x)).cast("double")
    powers = F.transform(_c(x), lambda v: F.exp(v.cast("double") - top))
    return F.transform(powers, lambda v: v / array_total(powers))


def log_softmax(x) -> Column:
    top = F.array_max(_c(x)).cast("double")
    total = F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top))
    return F.transform(_c(x), lambda v: v.cast("double") - top - F.log(total))


def argmax(x) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def argmin(x) -> Column:
    return (F.array_position(_c(x), F.array_min(_c(x))) - 1).cast("int")


def pad(x, size, value=0.0) -> Column:
    """Pad an array with ``value`` on the right to ``size`` elements."""
    missing = F.greatest(F.lit(0), _c(size) - F.size(_c(x)))
    return F.concat(_c(x), F.array_repeat(F.lit(value), missing))


def pad_mask(x, size) -> Column:
    """1 for real elements, 0 for padding."""
    return F.transform(F.sequence(F.lit(1), _c(size)), lambda i: (i <= F.size(_c(x))).cast("int"))


def compact(mask: Column, **columns: Column) -> Column:
    """Array of structs of the parallel arrays where ``mask`` is true."""
    zipped = F.arrays_zip(mask.alias("keep"), *[c.alias(n) for n, c in columns.items()])
    kept = F.filter(zipped, lambda z: z.getField("keep"))
    return F.transform(kept, lambda z: F.struct(*[z.getField(n).alias(n) for n in columns]))


def collapse_repeats(ids, blank) -> Column:
    """Drop repeats of the previous id and then blanks from an id array."""
    x = _c(ids)
    kept = F.filter(x, lambda v, i: (v != _c(blank)) & ((i == 0) | (v != F.get(x, i - 1))))
    return kept


def difference_count(a, b) -> Column:
    """Positions that differ plus the difference in length."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, v: s + v
    )


def multiset_overlap(a, b) -> Column:
    """Size of the multiset intersection of two token arrays."""
    x, y = _c(a), _c(b)

    def times(arr, t):
        return F.size(F.filter(arr, lambda v: v == t))

    return F.aggregate(
        F.transform(F.array_intersect(x, y), lambda t: F.least(times(x, t), times(y, t))),
        F.lit(0),
        lambda s, v: s + v,
    )


def is_subset(a, b) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two token arrays."""
    x, y = _c(a), _c(b)
    zero = F.transform(y, lambda _: F.lit(0))

    def next_row(row, token):
        start = F.struct(F.lit(0).alias("diag"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("row"))
        cells = F.arrays_zip(y.alias("t"), row.alias("up"))
        return F.aggregate(
            cells,
            start,
            lambda s, c: F.struct(
                c.getField("up").alias("diag"),
                F.when(c.getField("t") == token, s.getField("diag") + 1)
                .otherwise(F.greatest(c.getField("up"), s.getField("left")))
                .alias("left"),
                F.array_append(
                    s.getField("row"),
                    F.when(c.getField("t") == token, s.getField("diag") + 1).otherwise(
                        F.greatest(c.getField("up"), s.getField("left"))
                    ),
                ).alias("row"),
            ),
            lambda s: s.getField("row"),
        )

    last = F.aggregate(x, zero, next_row)
    return F.coalesce(F.element_at(F.when(F.size(last) > 0, last), -1), F.lit(0))


# Fixed value: first code point used to stand for a token.
CODE_BASE = 0x4E00


def code_point(number) -> Column:
    """One character for a number from 0 to about a million; the range of surrogates is left out."""
    n = _c(number) + CODE_BASE
    n = F.when(n >= 0xD800, n + 0x800).otherwise(n)
    # a byte order mark would be taken as one
    n = F.when(n >= 0xFEFF, n + 1).otherwise(n)
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def edit_distance(a, b) -> Column:
    """Edit distance of two token arrays.

    Each distinct token of the pair stands for one code point, so the built-in
    string distance counts whole tokens.
    """
    x, y = _c(a), _c(b)
    tokens = F.array_distinct(F.concat(x, y))

    def encode(arr):
        return F.array_join(
            F.transform(
                arr,
                lambda t: code_point(F.array_position(tokens, t) - 1),
            ),
            "",
        )

    return F.levenshtein(encode(x), encode(y))
