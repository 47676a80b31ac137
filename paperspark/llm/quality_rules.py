"""Quality rules: robust multivariate outliers, with Spark expressions only.

Documents of one language and source share a minimum-covariance-determinant
estimate of centre and scatter of a transformed statistic vector. It starts
from medians and median absolute deviations; each concentration step then
keeps the part of the documents nearest by Mahalanobis distance and estimates
again from them. A document far from its group's estimate is rejected.

Quantiles are exact ones of rounded values, so their state is bounded by the
number of distinct rounded values and a group may hold any share of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperspark.llm.common import SPACE_CHARS, UPPER, staged, word_array

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Share of a group that a concentration step keeps, and number of steps.
KEEP_SHARE = 0.75
STEPS = 3
# Least standard deviation of each transformed statistic: differences below
# it say nothing about quality (a few repeated lines are no fault in
# themselves). It also keeps every scatter matrix regular.
FLOORS = {"x_length": 0.12, "x_symbols": 0.35, "x_upper": 0.40, "x_stutter": 0.60,
          "x_lines": 1.50, "x_repeats": 1.50}
# Groups whose estimates (some 50 numbers each) may be broadcast.
MOST_GROUPS = 1 << 15
# Squared distance above which a document is rejected: the 0.9999 quantile of
# chi squared with six degrees of freedom.
CUTOFF = 27.86
# The kept part's scatter is smaller than the group's by this factor (chi
# squared, six degrees of freedom, the nearest three quarters).
CONSISTENCY = 1.362


def chars_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words covered by word windows that occur at least twice in a text."""
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))))
    return F.sort_array(windows)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    carry: list[str] = []) -> DataFrame:
    """One row per document: the carried columns and integer statistics of
    its whole text (null: no words)."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("__text"))
    rows = rows.select("doc_id", *carry, "__text", word_array(F.col("__text")).alias("__words"))
    word_lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    rows = rows.select(
        "doc_id", *carry,
        F.size("__words").cast("long").alias("n_words"),
        chars_without(text, SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length(text) - chars_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - chars_without(text, UPPER)).cast("long").alias("n_upper"),
        F.length(text).cast("long").alias("n_chars"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        (F.length(text) - chars_without(text, "0123456789")).cast("long").alias("n_digits"),
        (F.length(text) - chars_without(text, PUNCTUATION)).cast("long").alias("n_marks"),
        word_lines.alias("__lines"),
        # Words equal to the one before.
        F.size(F.filter("__words", lambda w, i: (F.get("__words", i - 1) == w).eqNullSafe(True)))
        .cast("long").alias("n_stutters"),
        repeated_words(F.col("__words")).alias("__windows"))
    # Sorted by hash, equal windows are neighbours.
    twice = F.filter("__windows", lambda w, k: (
        (F.get("__windows", k - 1)["h"] == w["h"]) | (F.get("__windows", k + 1)["h"] == w["h"])).eqNullSafe(True))
    rows = rows.select(
        *[c for c in rows.columns if not c.startswith("__")],
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(twice, lambda w: w["i"])).alias("__at"))
    covered = F.aggregate(
        F.transform("__at", lambda i, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get("__at", k + 1), i + WINDOW) - i)),
        F.lit(0), lambda a, b: a + b)
    return rows.select(*[c for c in rows.columns if c != "__at"],
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def transformed() -> dict[str, Column]:
    """The statistic vector: near-symmetric for ordinary prose."""
    def share(a: Column, b: Column) -> Column:
        return F.log1p(100.0 * a / F.greatest(b, F.lit(1)))

    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_length": F.log(F.greatest(chars, F.lit(1)) / F.greatest(n, F.lit(1))),
        "x_symbols": share(F.col("n_symbols"), chars),
        "x_upper": share(F.col("n_upper"), chars),
        "x_stutter": share(F.col("n_stutters"), n),
        "x_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "x_repeats": share(F.col("n_repeat_words"), n),
    }


def cholesky(params: DataFrame, p: int) -> DataFrame:
    """``params`` with the lower factor l_i_j of the scatter c_i_j."""
    for j in range(p):
        diagonal = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{j}"))
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(diagonal))
        params = params.withColumns({f"l_{i}_{j}": reduce(
            lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}")
        ) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)})
    return params


def join_groups(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with the staged values of their group. Up to ``MOST_GROUPS``
    groups (counted) these are broadcast, so that rows of a large group stay
    where they are; beyond, both sides are shuffled."""
    return rows.join(F.broadcast(params) if params.count() <= MOST_GROUPS else params, "grp")


def distances(rows: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance to its group."""
    p = len(names)
    out = join_groups(rows, staged(cholesky(params, p), "rule-factors"))
    for i in range(p):  # forward substitution
        z = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"z_{k}"), range(i),
                   F.col(names[i]) - F.col(f"m_{i}")) / F.col(f"l_{i}_{i}")
        out = out.withColumn(f"z_{i}", z)
    d2 = reduce(lambda a, b: a + b, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(p)])
    return out.select(*rows.columns, d2.alias("d2"))


def first_estimate(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Medians, and a diagonal scatter from median absolute deviations."""
    rounded = {n: F.round(n, 2) for n in names}
    middle = rows.groupBy("grp").agg(*[F.percentile(rounded[n], 0.5).alias(f"m_{i}") for i, n in enumerate(names)])
    spread = join_groups(rows, staged(middle, "rule-medians")).groupBy("grp").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(names))],
        *[(1.4826 * F.percentile(F.round(F.abs(F.col(n) - F.col(f"m_{i}")), 2), 0.5)).alias(f"s_{i}")
          for i, n in enumerate(names)])
    scatter = {f"c_{i}_{j}": (F.pow(F.col(f"s_{i}"), 2) + floors[i] ** 2 if i == j else F.lit(0.0))
               for i in range(len(names)) for j in range(i + 1)}
    return spread.withColumns(scatter).drop(*[f"s_{i}" for i in range(len(names))])


def concentrate(rows: DataFrame, params: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """One concentration step: estimate from the nearest part of each group.
    All documents at the limiting rounded distance are kept, so ties do not
    depend on any order."""
    p = len(names)
    near = distances(rows, params, names).withColumn("u", F.round(F.log(F.col("d2") + 1e-6), 2))
    limits = near.groupBy("grp").agg(F.percentile("u", KEEP_SHARE).alias("limit"))
    inner = join_groups(near, staged(limits, "rule-limits")).where(F.col("u") <= F.col("limit"))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    sums = inner.groupBy("grp").agg(
        F.count("*").alias("n"),
        *[F.avg(names[i]).alias(f"m_{i}") for i in range(p)],
        *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    return sums.select(
        "grp", *[f"m_{i}" for i in range(p)],
        *[(CONSISTENCY * F.col(f"c_{i}_{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}")
          for i, j in pairs])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          group_cols: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: statistics, ``base_failed``, ``d2`` and ``kept``.

    A null text has no words and fails the base rule. Null group values form
    groups of their own. Repeated rows are judged one by one and all count; a
    group of few documents leans on the floors of the scatter, and a lone
    document is its own centre. Other columns are ignored. The estimates use
    documents that pass the base rule; an empty table gives no rows.
    """
    names = list(FLOORS)
    floors = [FLOORS[n] for n in names]
    group = F.to_json(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]))
    source = docs.select(F.col(id_col), F.col(text_col), group.alias("grp"))
    rows = base_statistics(source, id_col, text_col, ["grp"]).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) |
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = staged(rows.withColumns(transformed()), "rule-statistics")
    passed = rows.where(~F.col("base_failed"))
    params = staged(first_estimate(passed, names, floors), "rule-start")
    for step in range(STEPS):
        params = staged(concentrate(passed, params, names, floors), f"rule-step{step}")
    judged = distances(passed, params, names).unionByName(
        rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return judged.withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(False))).drop("grp")
