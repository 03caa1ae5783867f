"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Four transformed statistics describe a document. For each language and source the minimum covariance determinant is
approached by concentration steps: start from medians and median deviations, then again and again take the share of
rows nearest by Mahalanobis distance and compute their mean and covariance. Distances are cut on a fixed grid of bins,
so the share is found from counts of bins: no group is sorted or gathered, and every step is one small aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SPACE, documents, query
from tidemark.llm.line_dedup import lines_of
from tidemark.llm.tables import written
from tidemark.scan import salted_join

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Share of rows of a group that the estimates rest on.
SHARE = 0.75
#: Median of the chi-square law with four degrees of freedom; the estimates are scaled to it.
CHI_MEDIAN = 3.356694
#: Squared distance beyond which a document goes: the 0.99 quantile of the chi-square law with four degrees of freedom.
CUT = 13.2767
#: Added standard deviation of each transformed statistic, as most are 0 in clean texts; with ``CUT`` each can still decide alone.
FLOORS = {"x1": 0.15, "x2": 0.35, "x3": 0.12, "x4": 0.12}
NAMES = tuple(FLOORS)
#: Steps of distance bins for each doubling of the squared distance.
BINS = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; null is no word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_h", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    # names of all five-word windows, by the names of their words
    window = F.transform(F.sequence(F.lit(1), F.size("_h") - 4), lambda i: F.xxhash64(*[F.element_at("_h", (i + k).cast("int")) for k in range(5)]))
    rows = rows.withColumn("_w", F.when(F.size("_h") >= 5, window).otherwise(F.expr("cast(array() as array<bigint>)")))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    # windows by name and place; one beside its like is found twice or more
    by_name = F.array_sort(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(some, by_name))
    n = F.size("_s")
    twice = F.filter(
        F.transform("_s", lambda s, i: F.when(
            ((i > 0) & (F.get("_s", i - 1)["w"] == s["w"])) | ((i < n - 1) & (F.get("_s", i + 1)["w"] == s["w"])), s["i"])),
        lambda p: p.isNotNull(),
    )
    rows = rows.withColumn("_p", F.when(some, F.array_sort(twice)))
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_p", i + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    line_words = F.filter(lines_of(F.col("text")), lambda s: F.btrim(s, F.lit("\x20\x09\x0a\x0b\x0c\x0d")) != "")
    return rows.withColumns({
        "n_words": F.size("_h").cast("long"),
        "word_chars": F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(line_words) - F.size(F.array_distinct(line_words))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "_lines": F.size(line_words).cast("long"),
    }).drop("_h", "_w", "_s", "_p")


def transformed() -> dict[str, Column]:
    """Statistic vector: word length, symbols, repeated lines and repeated words, each on a scale where texts spread alike."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x2": F.sqrt(F.col("n_symbols") / words * 4),
        "x3": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))))),
        "x4": F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / words))),
    }


def precision(table: DataFrame, *keep: str) -> DataFrame:
    """Inverse of the covariance c_*_* as columns p_*_*, by two-row minors; means are carried along."""
    c = {(a, b): F.col(f"c_{a}_{b}" if NAMES.index(a) <= NAMES.index(b) else f"c_{b}_{a}") for a in NAMES for b in NAMES}
    m = [[c[a, b] for b in NAMES] for a in NAMES]

    def minor(rows: tuple[int, int], i: int, j: int) -> Column:
        return m[rows[0]][i] * m[rows[1]][j] - m[rows[1]][i] * m[rows[0]][j]

    cuts = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    upper, lower = {x: minor((0, 1), *x) for x in cuts}, {x: minor((2, 3), *x) for x in cuts}
    # expansion of the determinant along the first two rows
    det = sum(((-1) ** (i + j + 1) * upper[i, j] * lower[tuple(sorted({0, 1, 2, 3} - {i, j}))] for i, j in cuts), F.lit(0.0))
    out = {}
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[i:], i):
            # cofactor of (i, j): the other row of the same half against minors of the other half
            pair, half = (i ^ 1), (lower if i < 2 else upper)
            columns = [k for k in range(4) if k != j]
            rows = [r for r in range(4) if r != i]
            terms = []
            for at, k in enumerate(columns):
                u, v = [x for x in columns if x != k]
                sign = (-1) ** (i + j + rows.index(pair) + at)
                terms.append(sign * m[pair][k] * half[u, v])
            out[f"p_{a}_{b}"] = sum(terms[1:], terms[0]) / det
    return table.select(*keep, *[f"m_{a}" for a in NAMES], *[v.alias(k) for k, v in out.items()])


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2`` from columns m_*, p_*_* and the vector."""
    away = {a: F.col(a) - F.col(f"m_{a}") for a in NAMES}
    terms = [away[a] * away[b] * F.col(f"p_{a}_{b}") * (1 if a == b else 2) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    return rows.withColumn("d2", sum(terms[1:], terms[0]))


def estimates(rows: DataFrame) -> DataFrame:
    """Mean and floored covariance of each group."""
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    sums = rows.groupBy("g").agg(F.count("*").alias("_n"), *[F.sum(a).alias(f"s_{a}") for a in NAMES], *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs])
    m = {a: F.col(f"s_{a}") / F.col("_n") for a in NAMES}
    cov = {(a, b): F.col(f"s_{a}_{b}") / F.col("_n") - m[a] * m[b] + (F.lit(FLOORS[a] ** 2) if a == b else 0) for a, b in pairs}
    return sums.select("g", *[x.alias(f"m_{a}") for a, x in m.items()], *[x.alias(f"c_{a}_{b}") for (a, b), x in cov.items()])


def binned() -> Column:
    """Bin of the squared distance on a grid fixed in advance."""
    return F.floor(F.log2(F.greatest(F.col("d2"), F.lit(0.0)) + 1e-6) * BINS).cast("int")


def nearest_share(bins: DataFrame, share: float) -> DataFrame:
    """For each group the bin within which ``share`` of its rows lie; a bin goes whole."""
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("g"))
    return bins.withColumns({"_upto": upto, "_total": total}).where(F.col("_upto") >= share * F.col("_total")).groupBy("g").agg(F.min("bin").alias("limit"))


def bin_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g", "bin").agg(F.count("*").alias("n"))


def quality(docs: DataFrame, share: float = SHARE, steps: int = 3, cut: float = CUT, least_group: int = 60) -> DataFrame:
    """Base statistics, base verdict, squared robust distance ``d2`` and ``kept`` for every row of ``docs``.

    Groups are language and source; a group of fewer than ``least_group`` rows that passed the base rule is estimated
    with all such groups of its language. Null language or source is a value like any other. Rows that failed the base rule
    (no or few words, many repeats; null and empty texts among them) are not kept and take no part in the estimates.
    Repeated rows count each. Other columns are carried along, input columns of the names added here are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    carried = [c for c in docs.columns if c not in (*made, "text")]
    # other columns travel together, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(c) for c in carried]).alias("_carried") if carried else F.lit(0).alias("_carried"), "text", "lang", "source")
    rows = base_statistics(rows).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lang, source = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("")), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = written(rows.withColumns({"base_failed": failed, "_lang": lang, "_source": source} | transformed()))
    sound = ~F.col("base_failed")
    sizes = rows.where(sound).groupBy("_lang", "_source").agg(F.count("*").alias("_size"))
    named = sizes.select("_lang", "_source", F.when(F.col("_size") >= least_group, F.struct("_lang", "_source")).otherwise(F.struct("_lang", F.lit(None).cast("string").alias("_source"))).alias("_g"))
    groups = named.select("_lang", "_source", F.to_json("_g").alias("g"))
    # rows of a large group are spread over salts wherever they meet the figures of their group
    vectors = salted_join(rows.where(sound).withColumn("_r", F.monotonically_increasing_id()), groups, ["_lang", "_source"], ["_r"]).select("g", "_r", *NAMES)

    def beside(table: DataFrame, figures: DataFrame) -> DataFrame:
        return salted_join(table, figures, ["g"], ["_r"])

    # medians and deviations from counts of values on a fixed grid
    now = first_estimates(vectors)
    for _ in range(steps):
        far = with_distance(beside(vectors, now)).withColumn("bin", binned()).select("g", "_r", *NAMES, "bin")
        limits = nearest_share(bin_counts(far), share)
        now = written(precision(estimates(beside(far, limits).where(F.col("bin") <= F.col("limit"))), "g"))
    # scale so that the median distance is that of the chi-square law
    far = with_distance(beside(vectors, now)).withColumn("bin", binned())
    middle = nearest_share(bin_counts(far), 0.5).select("g", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("limit") + 1) / BINS) / CHI_MEDIAN).alias("_scale"))
    final = groups.join(now, "g", "left").join(middle, "g", "left")
    out = with_distance(rows.join(written(final), ["_lang", "_source"], "left"))
    out = out.withColumn("d2", F.col("d2") / F.col("_scale"))
    verdict = sound & F.coalesce(F.col("d2") <= cut, F.lit(True))
    return out.withColumn("kept", verdict).select(*[F.col("_carried")[c].alias(c) for c in carried], *made)


def first_estimates(vectors: DataFrame) -> DataFrame:
    """Medians and median deviations of each statistic and group, from counts on a grid of hundredths."""
    rows = vectors.select("g", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.round(F.col(a) * 100).cast("int").alias("v")) for a in NAMES])).alias("e")).select("g", "e.name", "e.v")
    counts = written(rows.groupBy("g", "name", "v").agg(F.count("*").alias("n")))
    def middle(value: str, table: DataFrame) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy(value))
        total = F.sum("n").over(Window.partitionBy("g", "name"))
        return table.withColumns({"_upto": upto, "_total": total}).where(2 * F.col("_upto") >= F.col("_total")).groupBy("g", "name").agg(F.min(value).alias("mid"))

    medians = middle("v", counts)
    away = counts.join(medians, ["g", "name"]).groupBy("g", "name", "mid", F.abs(F.col("v") - F.col("mid")).alias("dev")).agg(F.sum("n").alias("n"))
    spread = middle("dev", away).withColumnRenamed("mid", "mad")
    both = medians.join(spread, ["g", "name"])
    values = []
    for i, a in enumerate(NAMES):
        values.append(F.max(F.when(F.col("name") == a, F.col("mid") / 100)).alias(f"m_{a}"))
        values.append(F.max(F.when(F.col("name") == a, F.pow(F.col("mad") / 100 * 1.4826, 2) + FLOORS[a] ** 2)).alias(f"c_{a}_{a}"))
        values += [F.lit(0.0).alias(f"c_{a}_{b}") for b in NAMES[i + 1 :]]
    return written(precision(both.groupBy("g").agg(*values), "g"))


@query()
def op3_quality_rules(spark, sf_dir):
    rows = quality(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
