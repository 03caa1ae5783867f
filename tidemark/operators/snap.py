"""Snapping interval series to a time grid.

All modes take ``onset`` and ``offset`` in seconds, work in ticks and return the
input rows with both replaced.  ``order`` breaks ties of equal onsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.chain import call_bucket, map_series, run_slices
from tidemark.fold import Fold, Ride
from tidemark.functions import grid as G
from tidemark.operators.islands import gap_or_cap_segments, tied_phrases
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, with_blocks
from tidemark.session import stage
from tidemark.shortest import cheapest_states

# Weights of the cost terms and of early and late moves.
WEIGHTS = {"start": 0.08971, "end": 0.025064, "gap": 0.235416, "length": 0.038973, "grid120": 0.580321, "grid480": 0.030516}
PHRASE_SIDES = {"start_early": 2.0, "start_late": 0.5, "end_early": 1.5, "end_late": 0.75, "gap": 0.75}
PRIOR_SIDES = {"start_early": 1.4, "start_late": 0.65, "end_early": 1.3, "end_late": 0.9, "gap": 0.75}
# Lengths tried by the chain mode and by the priors, and their jump cost.
LENGTH_MULTIPLES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
GAP_MULTIPLES = (0, 1, 2, 3, 4, 6, 8)
JUMP_COST = 0.08
INNER_GRID = 30
# Segment centres of the phrase mode.
FINE_CENTRES = (0, 60, 120)
CENTRE_WEIGHT, SWITCH_COST, SECOND_ORDER = 0.02, 1.0, 0.08
TIE_BONUS, TOUCH_BONUS, LONG_BONUS, LONG_TICKS = 0.4, 0.3, 0.2, 240
# Limits of the prior mode.
PRIOR_CAP, PRIOR_MIN_COUNT, PRIOR_LENGTH_WEIGHT, PRIOR_CENTRE_WEIGHT, LATE_WEIGHT = 48, 6, 0.05, 0.03, 0.08
PREFERRED_WEIGHT = 0.015


def _pairs(df: DataFrame, series, order, tempo: float, rows_per_block: int) -> DataFrame:
    """Raw ticks per row, numbered by onset."""
    rows = df.withColumn("_on", G.ticks("onset", tempo)).withColumn("_off", G.ticks("offset", tempo))
    rows = with_blocks(rows, series, "onset", rows_per_block)
    return Scan(rows, series, ["onset", *order]).row_number("_i").columns()


def _back(rows: DataFrame, df: DataFrame, start: Column, end: Column, tempo: float) -> DataFrame:
    replaced = {"onset": G.seconds(start, tempo), "offset": G.seconds(end, tempo)}
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns])


def snap_simple(
    df: DataFrame, series: Sequence[str], order: Sequence[str], tempo: float, step: int, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Nearest grid points with strictly increasing starts and ends of at least one step.

    Ends that touch the next start follow it, and no end passes the next start.
    """
    if step <= 0:
        return df
    rows = _pairs(df, series, order, tempo, rows_per_block)
    place = ["onset", *order]
    shifted = G.snap("_on", step) - F.col("_i") * step
    rows = Scan(rows, series, place).running_max("_m", shifted).lead("_raw_next", "onset").columns()
    rows = rows.withColumn("_start", F.col("_m") + F.col("_i") * step)
    rows = Scan(rows, series, place).lead("_next", "_start").columns()
    touching = F.coalesce(F.abs(F.col("offset") - F.col("_raw_next")) < 1e-3, F.lit(False))
    end = F.when(touching, F.col("_next")).otherwise(G.snap("_off", step))
    end = F.when(end <= F.col("_start"), F.col("_start") + step).otherwise(end)
    return _back(rows, df, F.col("_start"), F.least(end, F.col("_next")), tempo)


def length_candidates(step: int, longest: Column) -> Column:
    cap = F.greatest(F.lit(step), (F.ceil(longest / step) * step).cast("bigint") + 2 * step)
    values = F.array(*[F.lit(m * step).cast("bigint") for m in LENGTH_MULTIPLES])
    return F.filter(values, lambda v: (v <= cap) | (v == step))


def gap_candidates(step: int, widest: Column) -> Column:
    cap = F.greatest(F.lit(2 * step), (F.ceil(widest / step) * step).cast("bigint") + step)
    values = F.array(*[F.lit(m * step).cast("bigint") for m in GAP_MULTIPLES])
    return F.filter(values, lambda v: v <= cap)


def snap_chain(
    df: DataFrame, series: Sequence[str], order: Sequence[str], tempo: float, step: int, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Lengths from a fixed lattice by the cheapest chain; starts follow from lengths and rests."""
    if step <= 0:
        return df
    place = ["onset", *order]
    rows = _pairs(df, series, order, tempo, rows_per_block)
    rows = rows.withColumn("_raw", F.greatest(F.lit(1).cast("bigint"), F.col("_off") - F.col("_on")))
    rows = Scan(rows, series, place).maximum("_longest", "_raw").lead("_next_on", "_on").columns()
    rows = rows.withColumn("_lengths", length_candidates(step, F.col("_longest")))
    common = [m * step for m in (1, 2, 4, 8, 16)]
    rows = rows.withColumn(
        "_costs",
        F.transform(
            "_lengths",
            lambda c: F.abs(F.col("_raw") - c).cast("double") + F.when(c.isin(common), 0.0).otherwise(0.08 * step),
        ),
    )

    def moves(pdf: pd.DataFrame, i: int) -> np.ndarray:
        c = np.array(pdf["_lengths"].iat[0], dtype=float)
        return np.abs(c[:, None] - c[None, :]) * JUMP_COST

    rows = cheapest_states(rows, series, "_i", "_costs", moves, name="_k")
    length = F.get("_lengths", F.col("_k").cast("int"))
    rest = F.greatest(F.lit(0), F.col("_next_on") - F.col("_off"))
    rest = F.when(rest < step * 0.5, F.lit(0)).otherwise(G.snap(rest, step))
    rows = rows.withColumn("_len", length).withColumn("_advance", length + F.coalesce(rest, F.lit(0)))
    rows = (
        Scan(rows, series, place)
        .running_sum("_sum", "_advance")
        .last_valid("_origin", F.when(F.col("_i") == 1, G.snap("_on", step)))
        .columns()
    )
    start = F.col("_origin") + F.col("_sum") - F.col("_advance")
    return _back(rows, df, start, start + F.col("_len"), tempo)


def _distance(x: np.ndarray, step: int) -> np.ndarray:
    return np.minimum(x % step, (step - x % step) % step)


class _Candidates:
    """Start and end pairs of one row around its raw ticks, in sorted order."""

    def __init__(self, start: int, end: int, step: int):
        self.raw_start, self.raw_end, self.raw_length = start, end, max(1, end - start)
        around = np.arange(-3, 4)
        s = (int(np.rint(start / step)) + around) * step
        e = (int(np.rint(end / step)) + around) * step
        ss, ee = (g.ravel() for g in np.meshgrid(s, e, indexing="ij"))
        self.s, self.e = ss[ee > ss], ee[ee > ss]

    def keep(self, rows: np.ndarray) -> None:
        self.s, self.e = self.s[rows], self.e[rows]

    def cost(self, sides: dict, before: tuple[np.ndarray, int] | None) -> np.ndarray:
        """Cost per candidate, or per candidate before and candidate."""
        ds, de = self.s - self.raw_start, self.e - self.raw_end
        total = WEIGHTS["start"] * (sides["start_early"] * np.maximum(-ds, 0) + sides["start_late"] * np.maximum(ds, 0))
        total = total + WEIGHTS["end"] * (sides["end_early"] * np.maximum(-de, 0) + sides["end_late"] * np.maximum(de, 0))
        if before is not None:
            ends, raw_end = before
            gap = self.s[None, :] - ends[:, None]
            total = total + WEIGHTS["gap"] * sides["gap"] * np.abs(gap - (self.raw_start - raw_end))
        total = total + WEIGHTS["length"] * np.abs(self.e - self.s - self.raw_length)
        total = total + WEIGHTS["grid120"] * _distance(self.s, 120)
        return total + WEIGHTS["grid480"] * _distance(self.s, 480)


def _decode(rows: list[_Candidates], local, own=lambda i: 0.0) -> tuple[list[tuple[int, int]], float]:
    """Cheapest candidate per row.

    ``local(i, before)`` is the cost matrix into row ``i``, ``own(i)`` a cost per
    candidate that does not depend on the row before.
    """
    now, back = local(0, None) + own(0), []
    for i in range(1, len(rows)):
        step = now[:, None] + local(i, rows[i - 1]) + own(i)
        back.append(step.argmin(axis=0))
        now = step.min(axis=0)
    k = int(now.argmin())
    total, chosen = float(now[k]), []
    for i in range(len(rows) - 1, -1, -1):
        chosen.append((int(rows[i].s[k]), int(rows[i].e[k])))
        k = int(back[i - 1][k]) if i else k
    return chosen[::-1], total


def _centres(step: int) -> tuple[int, ...]:
    return FINE_CENTRES if step <= INNER_GRID else tuple(sorted({0, step // 4, step // 2}))


def snap_phrases(
    df: DataFrame, series: Sequence[str], order: Sequence[str], tempo: float, step: int, label: str = "lyric",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Phrase by phrase: the cheapest grid places around one common shift per phrase.

    Phrases are decoded in parallel for each possible shift; the shifts are then
    chosen along the chain of phrases of a series.
    """
    keys, grid = list(series), step if step and step > 0 else INNER_GRID
    place = ["onset", *order]
    rows = _pairs(df, keys, order, tempo, rows_per_block)
    rows = rows.withColumn("_off", F.greatest(F.col("_off"), F.col("_on") + 1))
    rows = tied_phrases(rows, keys, "_on", "_off", label, ["_i"], grid, rows_per_block=rows_per_block)
    centres = _centres(grid)

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        raw = list(zip(pdf["_on"].tolist(), pdf["_off"].tolist()))
        tied = (pdf["_tie"] != 0).tolist()
        out = pdf[[*keys, "seg_id", "_i"]].copy()
        done = [decode_one(raw[s], tied[s]) for s in run_slices(pdf["seg_id"].to_numpy())]
        for k, c in enumerate(("_s", "_e", "_costs")):
            out[c] = [row for part in done for row in part[k]]
        return out

    def decode_one(raw: list, tied: list):
        cands = [_Candidates(a, b, grid) for a, b in raw]
        ways, costs = [], []
        for centre in centres:

            def local(i, before):
                return cands[i].cost(PHRASE_SIDES, None if before is None else (before.e, before.raw_end))

            def own(i):
                c, bonus = cands[i], 0.0
                if centre > 0:
                    gap = c.raw_start - cands[i - 1].raw_end if i else 0
                    bonus = TIE_BONUS * tied[i] + TOUCH_BONUS * (gap == 0) + LONG_BONUS * (c.raw_length >= LONG_TICKS)
                    bonus = bonus * 1.15 if centre >= 120 else bonus
                return CENTRE_WEIGHT * np.abs(c.s - c.raw_start - centre) - bonus

            way, cost = _decode(cands, local, own)
            ways.append(way)
            costs.append(cost)
        n = range(len(raw))
        return [[w[i][0] for w in ways] for i in n], [[w[i][1] for w in ways] for i in n], [costs for _ in n]

    types = dict(rows.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in [*keys, "seg_id", "_i"])
    shape += ", _s array<bigint>, _e array<bigint>, _costs array<double>"
    small = rows.select(*keys, "seg_id", "_i", "_on", "_off", (F.coalesce(F.col(label), F.lit("")) == "-").cast("int").alias("_tie"))
    ways = stage(map_series(small.withColumn("_call", call_bucket("seg_id")), [*keys, "_call"], "_i", decode, shape))
    heads = ways.groupBy(*keys, "seg_id").agg(F.first("_costs").alias("_costs"))
    heads = with_blocks(heads.withColumn("_n", F.col("seg_id") + 1), keys, "_n", block_limit(rows, rows_per_block))

    def moves(pdf: pd.DataFrame, i: int) -> np.ndarray:
        c = np.array(centres, dtype=float)
        apart = np.abs(c[:, None] - c[None, :])
        return np.where(apart == 0, 0.0, SWITCH_COST) + (SECOND_ORDER * apart if i >= 3 else 0.0)

    chosen = cheapest_states(heads, keys, "_n", "_costs", moves, cost_first=True, name="_k").select(*keys, "seg_id", "_k")
    k = F.col("_k").cast("int")
    placed = ways.join(chosen, [*keys, "seg_id"]).select(
        *keys, "_i", F.get("_s", k).alias("_start"), F.get("_e", k).alias("_end")
    )
    rows = rows.drop("seg_id").join(placed, [*keys, "_i"])
    # all ticks lie on one grid, so repairing overlaps is a running maximum
    least = F.greatest(F.col("_end"), F.col("_start") + grid) - F.col("_i") * grid
    rows = Scan(rows, keys, place).running_max("_m", least).columns().withColumn("_fixed", F.col("_m") + F.col("_i") * grid)
    rows = Scan(rows, keys, place).lag("_before", "_fixed").columns()
    return _back(rows, df, F.greatest("_start", "_before"), F.col("_fixed"), tempo)


def phase_centre(df: DataFrame, group: Sequence[str], raw_start: str, step: int) -> DataFrame:
    """Typical shift of a bounded group to the grid and its weight: ``(group, centre, weight)``."""
    x = F.col(raw_start)
    shift = (F.rint(x / step) * step - x).cast("double")
    phase = F.pmod(x, F.lit(step)).cast("double")
    stats = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.median(shift).alias("_ms"), F.collect_list(shift).alias("_s"),
        F.median(phase).alias("_mp"), F.collect_list(phase).alias("_p"),
    )

    def spread(values: str, middle: str) -> Column:
        far = F.transform(values, lambda v: F.abs(v - F.col(middle)))
        return F.aggregate(far, F.lit(0.0), lambda a, v: a + v) / F.col("_n")

    def strength(s: Column, share: float) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - F.least(s / F.lit(max(step * share, 1.0)), F.lit(1.0)))

    own = strength(spread("_s", "_ms"), 0.4)
    around = spread("_p", "_mp")
    late = (F.col("_n") >= 4) & (F.col("_mp") >= step * 0.5) & (around <= step * 0.5)
    return stats.select(
        *group,
        F.when(late, -F.col("_mp")).otherwise(F.col("_ms")).alias("centre"),
        F.when(late, LATE_WEIGHT * F.greatest(own, strength(around, 0.35))).otherwise(PRIOR_CENTRE_WEIGHT * own).alias("weight"),
    )


def frequent_patterns(
    df: DataFrame, series: Sequence[str], raw_start: str, length: str, gap: str, tie: str, step: int,
    at_least: int = PRIOR_MIN_COUNT,
) -> DataFrame:
    """Length and gap patterns seen ``at_least`` times, with their typical values.

    The medians run over at most one step of distinct ticks per pattern.
    """
    keys = list(series)
    ends = df.groupBy(*keys).agg(F.max(length).alias("_longest"), F.max(gap).alias("_widest"))
    pattern = [
        F.greatest(F.lit(1), F.rint(F.col(length) / step).cast("bigint")).alias("length_multiple"),
        F.rint(F.col(gap) / step).cast("bigint").alias("gap_multiple"),
        F.col(tie).alias("tie"),
    ]
    found = (
        df.groupBy(*keys, *pattern)
        .agg(
            F.count(F.lit(1)).alias("n"), F.median(length).alias("_l"), F.median(gap).alias("_g"),
            F.median(F.pmod(F.col(raw_start), F.lit(G.BEAT_TICKS))).alias("_p"),
        )
        .filter(F.col("n") >= at_least)
        .join(ends, keys)
    )
    phases = F.array(*[F.lit(p).cast("bigint") for p in range(0, G.BEAT_TICKS, step)])
    return found.select(
        *keys, "length_multiple", "gap_multiple", "tie", "n",
        F.least(F.lit(0.65), 0.18 + 0.12 * (F.col("n") - at_least)).alias("strength"),
        G.nearest_candidate("_l", length_candidates(step, F.col("_longest"))).alias("preferred_length"),
        G.nearest_candidate("_g", gap_candidates(step, F.col("_widest"))).alias("preferred_gap"),
        G.nearest_candidate("_p", phases).alias("preferred_phase"),
    )


def _position_cost(s: np.ndarray, step: int) -> np.ndarray:
    at = s % G.BEAT_TICKS
    fine = 0.2 if step <= 60 else 0.42
    finest = 0.3 if step <= 30 else 0.42
    share = np.select([at == 0, at % 240 == 0, at % 120 == 0, at % 60 == 0, at % 30 == 0], [0.0, 0.04, 0.1, fine, finest], 0.42)
    return share * step


def _length_cost(d: np.ndarray, step: int) -> np.ndarray:
    multiple = np.maximum(1, np.rint(d / step).astype(int))
    share = np.where(np.isin(multiple, (1, 2, 4, 8, 16, 32)), 0.0, np.where(np.isin(multiple, (3, 6, 12, 24)), 0.05, 0.16))
    return share * step


def _prior_candidates(start: int, end: int, step: int) -> _Candidates:
    """Candidates of the prior mode: a finer grid for short rows, near moves only."""
    fine = max(30, step // 2) if step > 30 else step
    short = max(1, end - start) <= max(1, int(np.rint(step * 0.375)))
    c = _Candidates(start, end, fine if fine < step and short else step)
    limit = np.rint(step * 1.0)
    near = (np.abs(c.s - start) <= min(180, max(60, limit))) & (np.abs(c.e - end) <= min(240, max(90, limit)))
    if near.any():
        c.keep(np.flatnonzero(near))
    else:
        off = np.abs(c.s - start) + np.abs(c.e - end)
        c.keep(np.lexsort((np.abs(c.e - c.s - c.raw_length), off))[:1])
    return c


def snap_prior(
    df: DataFrame, series: Sequence[str], order: Sequence[str], tempo: float, step: int, label: str = "lyric",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Grid places weighed by metrical position, usual lengths and the patterns of the series."""
    if step <= 0:
        return df
    keys, place = list(series), ["onset", *order]
    rows = _pairs(df, keys, order, tempo, rows_per_block)
    rows = rows.withColumn("_off", F.greatest(F.col("_off"), F.col("_on") + 1))
    rows = Scan(rows, keys, place).lag("_prev_off", "_off").columns()
    rows = rows.select(
        *[c for c in rows.columns if c != "_prev_off"],
        F.greatest(F.lit(1), F.col("_off") - F.col("_on")).cast("bigint").alias("_len"),
        F.coalesce(F.greatest(F.lit(0), F.col("_on") - F.col("_prev_off")), F.lit(0)).cast("bigint").alias("_gap"),
        (F.coalesce(F.col(label), F.lit("")) == "-").alias("_tie"),
    )
    rows = gap_or_cap_segments(rows, keys, "_on", "_off", ["_i"], max(step * 3, 240), PRIOR_CAP, rows_per_block)
    patterns = frequent_patterns(rows, keys, "_on", "_len", "_gap", "_tie", step).select(
        *keys, F.col("length_multiple").alias("_lm"), F.col("gap_multiple").alias("_gm"), F.col("tie").alias("_tie"),
        "strength", "preferred_length",
    )
    centres = phase_centre(rows, [*keys, "seg_id"], "_on", step)
    small = rows.select(
        *keys, "seg_id", "_i", "_on", "_off", "_tie", G.preferred_length("_len", step).alias("_usual"),
        F.greatest(F.lit(1), F.rint(F.col("_len") / step).cast("bigint")).alias("_lm"),
        F.rint(F.col("_gap") / step).cast("bigint").alias("_gm"),
    )
    small = small.join(patterns, [*keys, "_lm", "_gm", "_tie"], "left").join(centres, [*keys, "seg_id"])

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        columns = [pdf[c].to_numpy(dtype=float) for c in ("centre", "weight", "_usual", "strength", "preferred_length")]
        on, off = pdf["_on"].tolist(), pdf["_off"].tolist()
        way = []
        for s in run_slices(pdf["seg_id"].to_numpy()):
            way += decode_one(on[s], off[s], *[c[s] for c in columns])
        out = pdf[[*keys, "_i"]].copy()
        out["_start"], out["_end"] = [w[0] for w in way], [w[1] for w in way]
        return out

    def decode_one(on, off, centres, weights, usual, strength, wanted):
        cands = [_prior_candidates(a, b, step) for a, b in zip(on, off)]
        centre, weight = centres[0], weights[0]

        def local(i, before):
            c = cands[i]
            d = c.e - c.s
            cost = c.cost(PRIOR_SIDES, None if before is None else (before.e, before.raw_end))
            cost = cost + _position_cost(c.s, step) + 0.3 * _length_cost(d, step)
            if not np.isnan(usual[i]):
                cost = cost + PREFERRED_WEIGHT * np.abs(d - usual[i])
            if weight > 0.0:
                cost = cost + weight * np.abs(c.s - c.raw_start - centre)
            if strength[i] > 0.0:
                cost = cost + strength[i] * PRIOR_LENGTH_WEIGHT * np.abs(d - wanted[i])
            if before is not None:
                after = c.s[None, :] >= before.e[:, None]
                cost = np.where(after | ~after.any(axis=0), cost, np.inf)
            return cost

        return _decode(cands, local)[0]

    types = dict(small.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in [*keys, "_i"]) + ", _start bigint, _end bigint"
    placed = map_series(small.withColumn("_call", call_bucket("seg_id")), [*keys, "_call"], "_i", decode, shape)
    limit = block_limit(rows, rows_per_block)
    placed = placed if limit is None else stage(placed)
    fixed = repair_overlaps(placed, keys, "_i", "_start", "_end", step, limit)
    rows = rows.join(fixed, [*keys, "_i"])
    return _back(rows, df, F.col("_start"), F.col("_end"), tempo)


def repair_overlaps(
    df: DataFrame, series: Sequence[str], index: str, start: str, end: str, step: int,
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """Move starts to the end before and give empty intervals one step."""
    keys, names = list(series), df.columns
    rows = with_blocks(df, keys, index, rows_per_block)
    seen = {"_s": F.col(start).cast("double"), "_e": F.col(end).cast("double"), "_first": F.lit(False)}
    rows = Fold(_Push(step), keys, [index], ["_s", "_e"], "_first").states(rows.withColumns(seen), "_after", block_limit(rows, rows_per_block))
    rows = rows if BLOCK not in rows.columns else stage(rows)
    rows = Scan(rows, keys, [index]).lag("_before", "_after").columns()
    types = dict(df.dtypes)
    new = {start: F.greatest("_s", "_before"), end: F.col("_after")}
    return rows.select(*[new[c].cast(types[c]).alias(c) if c in new else F.col(c) for c in names])


class _Push(Ride):
    """The end of an interval that starts no earlier than the one before ended and lasts one step at least."""

    def __init__(self, step: float):
        self.step = step

    def fresh(self, start, end):
        return end if end > start else start + self.step

    def next(self, state, start, end):
        start = max(start, state)
        return end if end > start else start + self.step

    def limits(self, start, end):
        return np.maximum(start, end), np.full(len(start), np.inf)

    def sides(self, states, start, end):
        return np.where((states < start) | (end > states), -1, 0)

    def broken(self, side, start, end):
        return self.fresh(start, end)


def snap_timeline(
    df: DataFrame, series: Sequence[str], order: Sequence[str], tempo: float, step: int, mode: str | None = "simple",
    label: str = "lyric", rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Snap by mode name: smart, bayes, dp, and simple for anything else."""
    name = (mode or "simple").lower()
    if name == "smart":
        return snap_chain(df, series, order, tempo, step, rows_per_block)
    if name == "bayes":
        return snap_prior(df, series, order, tempo, step, label, rows_per_block)
    if name == "dp":
        return snap_phrases(df, series, order, tempo, step, label, rows_per_block)
    return snap_simple(df, series, order, tempo, step, rows_per_block)


__all__ = [
    "BLOCK", "frequent_patterns", "phase_centre", "repair_overlaps", "snap_chain", "snap_phrases", "snap_prior",
    "snap_simple", "snap_timeline",
]
