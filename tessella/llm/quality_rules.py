"""Quality rules: plain limits, then robust multivariate outliers, in DataFrame operations only.

Every text gets counts (words, their code points, symbols, repeated lines, words under repeated
5-word windows). Texts that fail the plain limits are out. The others become vectors of p = 4
transformed statistics, and each language and source gets a minimum-covariance-determinant
estimate of their centre and scatter:

1. start from the coordinate-wise medians and median absolute deviations;
2. C-steps: keep the share ALPHA of the rows that lie nearest by Mahalanobis distance, take their
   mean and covariance (with the factor that makes it consistent at the normal distribution) and
   repeat, which never raises the determinant, until no group's determinant changes by more than the share
   SETTLED (or STEPS times, which the quantile sketches' noise may take);
3. reweight: the moments of the rows within the 0.975 chi-square quantile are the final estimate.

A row is rejected when its squared distance is beyond the CUT quantile of chi-square with p degrees.

Scale. The texts are read once, without a shuffle; the counts go to the checkpoint folder and
all steps read only them. Medians and the nearest share come from mergeable quantile sketches,
moments from partial sums, so a source that holds a third of all rows is no group in one task.
The estimates are a table of one row a group; it is broadcast while there are at most
BROADCAST_GROUPS groups, else joined by shuffle. Distances are forward substitutions with the
Cholesky factor, written out as SQL expressions.

Groups of fewer than MIN_ROWS rows are pooled by language, then over all languages; where even
that pool is too small, its rows are kept.

Edge cases: a null text has no words and fails the plain limits, as an empty one does. Null
languages and sources are groups of their own. Ties at the nearest share are all kept. Repeated
rows are judged alike. With an empty table the result is empty. Constant statistics get a
variance floor (RIDGE). A very long text is one row like any other. Columns named like the results are replaced;
all others but the text pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as P

WINDOW = 5
STEPS = 12
SETTLED = 0.01
ALPHA = 0.75
CUT = 1 - 1e-6
MIN_ROWS = 50
RIDGE = 0.005
BROADCAST_GROUPS = 20_000
SKETCH = 2000
VECTOR = ("x0", "x1", "x2", "x3")
SPACE = r"[\x20\x09-\x0D]+"


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    term, total = 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < q else (low, middle)
    return low


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs twice or more. hashes: of the windows, in order."""

    def places(ordered: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return F.coalesce(x.h == F.get(ordered, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(ordered, i + 1).h, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, repeated), lambda x: x.at))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, at: F.struct((a.n + (at + WINDOW - F.greatest(a.end, at))).alias("n"), (at + WINDOW).alias("end"))
    some = F.aggregate(_bound(ordered, places), start, step, lambda a: a.n)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(some)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    rest = [c for c in docs.columns if c != text and c not in made]
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", ""))
    cut = docs.select(*rest, words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    counted = cut.select(
        *rest,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    return counted.select(*rest, *made[:-1], _bound(F.col("hashes"), _covered).alias("n_repeat_words"))


def _root(part: Column, whole: Column, rate: float, weight: float) -> Column:
    """Square root of a share, drawn to `rate` with the weight of so many units in short texts; the
    root steadies the variance of small shares."""
    return F.sqrt((part + rate * weight) / (whole + weight))


def _vectors(counts: DataFrame) -> DataFrame:
    x = {
        "x0": F.log((F.col("word_chars") + 6.0 * 30) / (F.col("n_words") + 30)),
        "x1": 2 * _root(F.col("n_symbols"), F.col("word_chars"), 0.002, 100),
        "x2": _root(F.col("n_dup_lines"), F.col("n_lines"), 0.02, 8),
        "x3": _root(F.col("n_repeat_words"), F.col("n_words"), 0.01, 60),
    }
    return counts.withColumns(x)


def _grouped(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """rows with `gid`, the estimation group, and `usable` (false where the pool is too small)."""
    sizes = rows.groupBy(F.col(lang).alias("gl"), F.col(source).alias("gs")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    small = F.when(F.col("n") < MIN_ROWS, F.col("n")).otherwise(0)
    by_lang = F.sum(small).over(Window.partitionBy("gl"))
    level = F.when(F.col("n") >= MIN_ROWS, 0).when(by_lang >= MIN_ROWS, 1).otherwise(2)
    sizes = sizes.withColumn("level", level)
    key = [F.when(F.col("level") < 2, F.col("gl")), F.when(F.col("level") < 1, F.col("gs"))]
    gid = F.xxhash64("level", *[y for k in key for y in (k.isNull(), k)])
    sizes = sizes.select("gl", "gs", gid.alias("gid"))
    return rows.join(sizes, F.col(lang).eqNullSafe(F.col("gl")) & F.col(source).eqNullSafe(F.col("gs"))).drop("gl", "gs")


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """gid, n, the mean m0.. and the Cholesky factor l00, l10, l11, .. of the covariance of the vectors."""
    p = range(len(VECTOR))
    sums = [F.avg(VECTOR[i]).alias(f"m{i}") for i in p] + [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in p for j in range(i + 1)]
    out = rows.groupBy("gid").agg(F.count("*").alias("n"), *sums)
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") * factor + (RIDGE if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(RIDGE / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.drop(*[f"c{i}{j}" for i in p for j in range(i + 1)])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations as a first diagonal estimate."""
    p = range(len(VECTOR))
    centre = rows.groupBy("gid").agg(*[F.percentile_approx(VECTOR[i], 0.5, SKETCH).alias(f"m{i}") for i in p])
    away = _join(rows, centre).select("gid", *[F.abs(F.col(VECTOR[i]) - F.col(f"m{i}")).alias(f"a{i}") for i in p])
    spread = away.groupBy("gid").agg(F.count("*").alias("n"), *[F.percentile_approx(f"a{i}", 0.5, SKETCH).alias(f"s{i}") for i in p])
    out = spread.join(centre, "gid")
    diagonal = {f"l{i}{j}": F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + RIDGE) if i == j else F.lit(0.0) for i in p for j in range(i + 1)}
    return out.withColumns(diagonal).drop(*[f"s{i}" for i in p])


def _join(rows: DataFrame, groups: DataFrame) -> DataFrame:
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "gid")


def _distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the mean and factor of their group and d2, the squared Mahalanobis distance."""
    out = _join(rows, groups)
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        z = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") ** 2
    return out.withColumn("d2", total)


def robust_groups(rows: DataFrame, steps: int = STEPS, alpha: float = ALPHA) -> DataFrame:
    """The MCD estimate of each gid, from its rows' vectors."""
    p = len(VECTOR)
    factor = alpha / chi_square_cdf(chi_square_quantile(alpha, p), p + 2)
    groups = P.durable(_start(rows))
    volume = sum((F.log(f"l{i}{i}") for i in range(p)), F.lit(0.0))  # half the logarithm of the determinant
    for _ in range(steps):
        before = groups.select("gid", volume.alias("before"))
        measured = _distance(rows, groups).select("gid", "d2", *VECTOR)
        near = P.durable(measured.groupBy("gid").agg(F.percentile_approx("d2", alpha, SKETCH).alias("limit")))
        groups = P.durable(_moments(_join(measured, near).where("d2 <= limit"), factor))
        change = groups.select("gid", volume.alias("now")).join(before, "gid").agg(F.max(F.abs(2 * (F.col("now") - F.col("before"))))).first()[0]
        if change is None or change <= SETTLED:
            break
    inner = 0.975
    factor = inner / chi_square_cdf(chi_square_quantile(inner, p), p + 2)
    measured = _distance(rows, groups).where(F.col("d2") <= chi_square_quantile(inner, p))
    return P.durable(_moments(measured.select("gid", *VECTOR), factor))


def quality_rules(docs: DataFrame, cut: float = CUT, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the text, with the counts, base_failed, distance (null if base_failed or not
    judged) and kept."""
    named = {lang: "group_lang", source: "group_source"}
    kept = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"), *[F.col(a).alias(b) for a, b in named.items()])
    counts = P.durable(text_counts(packed))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    rows = _grouped(_vectors(counts.where("NOT base_failed")), "group_lang", "group_source")
    rows = P.durable(rows)
    groups = robust_groups(rows.select("gid", *VECTOR)).where(F.col("n") >= MIN_ROWS // 2)
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    known = rows.join(F.broadcast(groups) if few else groups, "gid", "left_semi")
    judged = _distance(known, groups)
    limit = chi_square_quantile(cut, len(VECTOR))
    beyond = F.col("d2") > limit
    columns = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    none = F.lit(None).cast("double")
    parts = [
        judged.select(*columns, F.sqrt("d2").alias("distance"), (~beyond).alias("kept")),
        rows.join(F.broadcast(groups) if few else groups, "gid", "left_anti").select(*columns, none.alias("distance"), F.lit(True).alias("kept")),
        counts.where("base_failed").select(*columns, none.alias("distance"), F.lit(False).alias("kept")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    made = [*columns[1:], "distance", "kept"]
    return out.select(*[F.col("row")[c].alias(c) for c in kept if c not in made], *made)
