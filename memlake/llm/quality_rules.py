"""Quality rules: fixed counts per text, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch, packed, unpacked

#: Share of clean texts that the cutoff would keep if their statistics were normal.
KEPT = 1 - 1e-6
#: Share of a group's rows that the determinant is minimised over.
CORE = 0.75
#: A group's scatter weighs its own rows against the scatter within all groups as if that were of so many rows.
BORROWED = 30
#: Statistics are held as whole numbers of this many units, so that sums are exact in any order.
UNITS = 256
#: Standard deviation, in units, of what counts as no difference; its square is added to each variance once.
FLOORS = (64.0, 16.0, 12.0, 24.0, 24.0, 12.0)
#: log length, log mean word length, and roots of the shares of symbols, repeated lines, repeated words, capitals.
STATS = (
    "ln(1.0 + n_words)",
    "ln(1.0 + CAST(word_chars AS DOUBLE) / greatest(n_words, 1))",
    "sqrt(CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1))",
    "sqrt(CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1))",
    "sqrt(CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1))",
    "sqrt(CAST(n_upper AS DOUBLE) / greatest(word_chars, 1))",
)
P = len(STATS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < share else (low, middle)
    return high


#: Squared robust distance beyond which a text is rejected.
CUTOFF = round(chi_square_quantile(KEPT, P), 4)
#: What the covariance of the innermost CORE of normal rows is to be multiplied by to be that of all.
CONSISTENCY = round(CORE / chi_square_cdf(chi_square_quantile(CORE, P), P + 2), 6)
GAPS = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """How many words stand in a five-word window that the text has at least twice."""

    def spread(starts: Column) -> Column:
        following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1) + 5))
        return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(5))), F.lit(0), lambda s, x: s + x)

    def repeated(windows: Column) -> Column:
        """windows: sorted (text, position)."""
        n = F.size(windows)
        flagged = F.filter(windows, lambda x, k: ((k > 0) & (F.get(windows, k - 1)["w"] == x["w"])) | ((k < n - 1) & (F.get(windows, k + 1)["w"] == x["w"])))
        return let(F.sort_array(F.transform(flagged, lambda x: x["p"])), lambda s: F.when(F.size(s) > 0, spread(s)).otherwise(0))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, 5)).alias("w"), i.alias("p")))

    return let(F.sort_array(windows(words)), repeated)


def _mixed(rows: DataFrame, out: str, first: str, skip: int, second: str) -> DataFrame:
    """Hashes of longer windows, from those of two shorter ones that lie skip words apart."""
    return rows.withColumn(out, F.zip_with(F.slice(first, 1, F.greatest(F.size(second) - skip, F.lit(0))), F.slice(second, skip + 1, F.size(second)), lambda a, b: F.shiftleft(a, 2 if skip == 2 else 1).bitwiseXOR(b)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts per row, in one narrow pass over whole texts. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", GAPS), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    # windows are compared as text only in the texts where two of them have the same hash
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (("h2", "h1", 1, "h1"), ("h4", "h2", 2, "h2"), ("h5", "h4", 4, "h1")):
        rows = _mixed(rows, *step)
    rows = rows.withColumn("alike", F.size("h5") > F.size(F.array_distinct("h5")))
    long = lambda c: c.cast("long")
    return rows.select(
        "id", "text_hash", *[f"k{n}" for n in range(len(keys))],
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.col("alike"), _covered(F.col("words"))).otherwise(0)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    ).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


MOMENTS = [f"m{i}" for i in range(P)] + [f"c{i}_{j}" for i, j in PAIRS]
FACTORS = [f"l{i}_{j}" for i, j in PAIRS]
#: Distances as whole numbers: an exact percentile then needs a bounded table of counts.
RANK = "CAST(floor(16 * sqrt(least(d, 1e6))) AS BIGINT)"
DETERMINANT = " * ".join(f"l{i}_{i}" for i in range(P))


def distance_sql() -> str:
    """Squared distance of x0.. from the mean m0.., by Cholesky's factor l0_0.. of the covariance."""
    return " + ".join(f"z{i} * z{i}" for i in range(P))


def forward_sql(i: int) -> str:
    return f"(x{i} - m{i}" + "".join(f" - l{i}_{j} * z{j}" for j in range(i)) + f") / l{i}_{i}"


def factor_sql(i: int, j: int, scale: float = 1.0) -> str:
    if i == j:
        return f"sqrt({scale} * c{i}_{i} + {FLOORS[i] ** 2}" + "".join(f" - l{i}_{k} * l{i}_{k}" for k in range(i)) + ")"
    return f"({scale} * c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j)) + f") / l{j}_{j}"


def sum_sql(i: int, j: int | None = None) -> str:
    return f"CAST(sum(x{i}) AS DOUBLE) / count(*)" if j is None else f"CAST(sum(x{i} * x{j}) AS DOUBLE) / count(*)"


#: What n rows with mean a0.. and mean products a0_0.. give alone, by their numbers.
OWN_MEAN, OWN_COVARIANCE = "a{0}", "a{0}_{1} - a{0} * a{1}"
#: What they give with the scatter w0_0.. within all groups and one borrowed row of mean t0.. and scatter t0_0.. from all rows.
SHARES = f"CAST(n AS DOUBLE) / (n + {BORROWED}) AS share, CAST(1 AS DOUBLE) / (n + 1) AS part"
MEAN = "(1 - part) * a{0} + part * t{0}"
COVARIANCE = "(1 - part) * (share * (a{0}_{1} - a{0} * a{1}) + (1 - share) * w{0}_{1}) + part * t{0}_{1}"


#: In Spark an estimate is three arrays: m, the mean; c, the covariance, and l, its factor, row by row up to the diagonal.
_ROWS, _COLUMNS, _FLOORS = (f"array({', '.join(map(str, v))})" for v in ([i for i, _ in PAIRS], [j for _, j in PAIRS], [f"{f * f}D" for f in FLOORS]))
_AT = "int({0} * ({0} + 1) / 2 + {1})"


def _factor(scale: float = 1.0) -> Column:
    """Cholesky's factor of scale times c with the floors on its diagonal."""
    rest = f"""aggregate(filter(sequence(0, {P - 1}), t -> t < p.j), {scale}D * c[{_AT.format("p.i", "p.j")}] + IF(p.i = p.j, {_FLOORS}[p.i], 0D),
      (rest, t) -> rest - l[{_AT.format("p.i", "t")}] * l[{_AT.format("p.j", "t")}])"""
    places = f"transform({_ROWS}, (i, k) -> struct(i AS i, {_COLUMNS}[k] AS j))"
    return F.expr(f"aggregate({places}, CAST(array() AS array<double>), (l, p) -> array_append(l, IF(p.i = p.j, sqrt({rest}), {rest} / l[{_AT.format('p.j', 'p.j')}])))")


_DETERMINANT = f"aggregate(sequence(1, {P - 1}), l[0], (d, i) -> d * l[{_AT.format('i', 'i')}])"


def _distances(df: DataFrame) -> DataFrame:
    """df (x0.., m, l) with d, the squared distance; the same steps as forward_sql() and distance_sql()."""
    z = [f"(x{i} - m[{i}]" + "".join(f" - l[{i * (i + 1) // 2 + j}] * z{j}" for j in range(i)) + f") / l[{i * (i + 1) // 2 + i}] AS z{i}" for i in range(P)]
    return df.selectExpr("*", *z, f"{distance_sql()} AS d")


def _sums() -> list[Column]:
    """Count n, mean a, and mean products aa of a group's rows."""
    return [F.count(F.lit(1)).alias("n"), F.array(*[F.expr(sum_sql(i)) for i in range(P)]).alias("a"), F.array(*[F.expr(sum_sql(i, j)) for i, j in PAIRS]).alias("aa")]


def _medians(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(F.array(*[F.expr(f"CAST(floor(percentile(x{i}, 0.5)) AS DOUBLE)") for i in range(P)]).alias("m"))


def _starts(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """(g, start, m, c) of rows (g, x0..) around their medians m: the squares of scaled median deviations, without covariance."""
    spread = rows.join(middle, "g").groupBy("g").agg(F.array(*[F.expr(f"percentile(abs(x{i} - m[{i}]), 0.5)") for i in range(P)]).alias("s"))
    squares = f"transform({_ROWS}, (i, k) -> IF(i = {_COLUMNS}[k], 1.4826D * s[i] * (1.4826D * s[i]), 0D))"
    return middle.join(spread, "g").select("g", F.lit(0).alias("start"), "m", F.expr(squares).alias("c"))


def _concentrated(rows: DataFrame, starts: DataFrame, scratch: Scratch, mean: str, covariance: str, **borrowed: list[float]) -> DataFrame:
    """(g, m, c) of rows (g, x0..), by steps from starts (g, start, m, c).

    A step keeps the rows of the CORE smallest distances, with all ties, takes their mean and covariance, and counts if
    the determinant falls. After the first the better start goes on; a group's steps end when its determinant no longer
    falls, which it can't do for ever, as a group has but so many subsets. Only sums per group are shuffled, so that a
    hot group costs a reducer no more.
    """
    now, first = scratch.saved(starts.select("g", "start", "m", "c", _factor().alias("l"), F.lit(1e300).alias("det"), F.lit(True).alias("fell")), "estimates"), True
    while not now.filter("fell").isEmpty():
        moving = now.filter("fell").select("g", "start", "m", "l")
        ranked = _distances(rows.join(moving, "g")).select("g", "start", *X, F.expr(RANK).alias("r"))
        limit = scratch.saved(ranked.groupBy("g", "start").agg(F.expr(f"percentile(r, {CORE})").alias("most")), "limits")
        sums = ranked.join(limit, ["g", "start"]).filter("r <= most").groupBy("g", "start").agg(*_sums())
        sums = sums.withColumns({k: F.array(*map(F.lit, v)) for k, v in borrowed.items()}).selectExpr("*", *SHARES.split(", "))
        tried = sums.select("g", "start", F.expr(mean).alias("m"), F.expr(covariance).alias("c")).withColumn("l", _factor()).withColumn("det", F.expr(_DETERMINANT))
        both = now.select("g", "start", F.struct("m", "c", "l", "det").alias("o")).join(tried.select("g", "start", F.struct("m", "c", "l", "det").alias("t")), ["g", "start"], "left")
        fell = F.coalesce(F.col("t.det") < F.col("o.det"), F.lit(False))
        after = both.select("g", "start", F.when(fell, F.col("t")).otherwise(F.col("o")).alias("e"), fell.alias("fell"))
        if first:
            after = after.groupBy("g").agg(F.min_by(F.struct("e", "fell"), F.struct("e.det", "start")).alias("b")).select("g", F.lit(0).alias("start"), "b.*")
        before, now, first = now, scratch.saved(after.select("g", "start", "e.*", "fell"), "estimates"), False
        scratch.drop(before, limit)
    return now.select("g", "m", "c")


#: MEAN and COVARIANCE of arrays: a and aa of sums, w within groups, t and tt of all rows.
_OWN = "a", f"transform(aa, (x, k) -> x - a[{_ROWS}[k]] * a[{_COLUMNS}[k]])"
_BORROWING = "zip_with(a, t, (x, y) -> (1 - part) * x + part * y)", f"transform(aa, (x, k) -> (1 - part) * (share * (x - a[{_ROWS}[k]] * a[{_COLUMNS}[k]]) + (1 - share) * w[k]) + part * tt[k])"


def robust_estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k0, k1, m, l): the minimum-covariance-determinant location and factored scatter of each language and source of rows (k0, k1, x0..).

    A group's scatter borrows from the scatter within groups, an estimate over all rows that are centred on their own
    group's medians, as if from BORROWED rows: what sets groups apart doesn't widen it. One row more is borrowed from an
    estimate over all rows as they are, so that a group of a row or two has an estimate too. An estimate is sought from
    the medians of a group with two scatters, that of its rows and the one within all groups.
    """
    named = rows.withColumn("g", F.to_json(F.struct("k0", "k1")))
    keys = scratch.saved(named.select("g", "k0", "k1").distinct(), "groups")
    rows = named.select("g", *X)
    middle = scratch.saved(_medians(rows), "medians")
    centred = rows.join(middle, "g").select(F.lit("within").alias("g"), *[F.expr(f"CAST(x{i} - m[{i}] AS LONG) AS x{i}") for i in range(P)])
    wide = centred.unionByName(rows.withColumn("g", F.lit("all")))
    wider = {r.g: r for r in _concentrated(wide, _starts(wide, scratch.saved(_medians(wide), "medians")), scratch, *_OWN).collect()}
    if not wider:
        return keys.select("k0", "k1", F.array().cast("array<double>").alias("m"), F.array().cast("array<double>").alias("l"))
    within, every = wider["within"], wider["all"]
    starts = _starts(rows, middle).unionByName(middle.select("g", F.lit(1).alias("start"), "m", F.array(*map(F.lit, within.c)).alias("c")))
    found = _concentrated(rows, starts, scratch, *_BORROWING, w=within.c, t=every.m, tt=every.c)
    return scratch.saved(keys.join(found.select("g", "m", _factor(CONSISTENCY).alias("l")), "g").select("k0", "k1", "m", "l"), "estimates")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: id_col, text_hash, n_words, the base counts, base_failed, distance, kept.

    A row goes if base_failed or if its statistics lie further than cutoff from the minimum-covariance-determinant
    estimate of its language and source; the cutoff is a quantile of the chi-square law. Rows that failed the base rule
    are left out of the estimates and have a null distance. A null language or source is a value of its own. Groups
    borrow from all rows, so that every row that passes the base rule has a distance. Null and empty
    texts have no words and fail the base rule. Repeated rows each get a verdict. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.saved(base_counts(docs, id_col, text_col, keys).withColumns({f"x{i}": F.expr(f"CAST(floor({UNITS} * ({s})) AS BIGINT)") for i, s in enumerate(STATS)}), "counts")
    estimates = robust_estimates(counted.filter("NOT base_failed").select("k0", "k1", *X), scratch).withColumnsRenamed({"k0": "g0", "k1": "g1"})
    df = counted.join(estimates, F.col("k0").eqNullSafe(F.col("g0")) & F.col("k1").eqNullSafe(F.col("g1")), "left")
    df = _distances(df).withColumn("distance", F.when(~F.col("base_failed"), F.col("d")))
    return df.select(
        F.col("id").alias(id_col), "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        F.coalesce(F.col("distance") <= cutoff, F.lit(False)).alias("kept"),
    )


def keep_good_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that pass quality_verdicts(), with all their columns; rows that repeat an id and its text pass together."""
    bad = quality_verdicts(docs, id_col, text_col, **options).filter("NOT kept").select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = packed(docs, id=docs[id_col], hash=F.xxhash64(docs[text_col]))
    return unpacked(rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti"), docs.columns)
