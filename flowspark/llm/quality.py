"""Quality rules: base limits, and robust multivariate outliers for each language and source. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
GRAM = 5
#: A document fails the base rules below this many words, or if repeats cover more than this share of them.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Share of a group over which the determinant is made small, and by how much a normal cloud's covariance is larger than
#: that of its nearest such share: share / P(chi2 with 7 degrees < its 5-degree quantile of the share).
SUBSET, CONSISTENCY = 0.75, 1.4124
#: Squared distance within which documents make the final estimate (5-degree chi2: 97.5 %), and the factor that goes with it.
REWEIGHT, REWEIGHT_CONSISTENCY = 12.8325, 1.0550
#: Statistics whose robust spread is less than this (most documents of a group agree) are held to have this standard
#: deviation: log words, log word length, root symbol share, root repeat share, root duplicate line share.
FLOORS = (0.5, 0.1, 0.05, 0.1, 0.05)
#: Squared Mahalanobis distance beyond which a document goes; 5-degree chi2 exceeds 25.7 once in 10,000.
CUTOFF = 25.745
#: Documents that an estimate needs, five for each statistic. Groups with fewer are judged by their language's, else by that of all; the column fit says which.
MIN_GROUP = 25
#: Concentration steps from every start, and further ones from the best.
STEPS, MORE_STEPS = 3, 3
STARTS = ("deviations", "signs", "tanh", "quadrants")
_DIM = len(FLOORS)
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the array, first occurrences included.

    Windows are compared by a 64-bit hash. Only texts that repeat one sort their windows: equal neighbours give the
    repeated places, and each place covers up to 5 words that the one before it didn't.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(GRAM))))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(places(g)))

    def places(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, k: F.coalesce(F.get(s, k)["x"] == a, F.lit(False))
            found = F.filter(F.transform(s, lambda e, k: F.when(same(e["x"], k - 1) | same(e["x"], k + 1), e["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(GRAM), i - acc["last"])).alias("n"))
            return F.aggregate(F.sort_array(found), start, step, lambda acc: acc["n"])

        return let(ranked, twice)

    return F.when(F.size(words) < GRAM, F.lit(0)).otherwise(let(hashes, of))


def base_statistics(text: Column) -> Column:
    """Struct of the base statistics of a whole text, as longs; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.regexp_count(text, F.lit(SYMBOLS))

    def of(w: Column) -> Column:
        values = (F.size(w), F.length(F.array_join(w, "")), symbols, dup_lines, repeat_words(w))
        return F.struct(*(v.cast("long").alias(n) for n, v in zip(_BASE, values, strict=True)))

    return let(words, of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def vector(s: Column) -> list[Column]:
    """The transformed statistics; meant for documents that pass the base rules, so no division is by zero."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return [F.ln(words), F.ln(chars / words), F.sqrt(s["n_symbols"] / chars), F.sqrt(s["n_repeat_words"] / words), F.sqrt(s["n_dup_lines"] / words)]


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance from the columns m0.. and i00.. (the inverse of the covariance's Cholesky factor)."""
    z = [sum((F.col(f"i{r}{c}") * (x[c] - F.col(f"m{c}")) for c in range(r + 1)), F.lit(0.0)) for r in range(_DIM)]
    return sum((a * a for a in z), F.lit(0.0))


def _estimate(frame: DataFrame, mean: list[Column], cov: list[list[Column]]) -> DataFrame:
    """Columns m, i and logdet from those of means and covariances: the Cholesky factor, then its inverse, entry by entry."""
    d, by = range(_DIM), ["group", "start"]
    frame = frame.select(*by, *(mean[r].alias(f"m{r}") for r in d), *(cov[r][c].alias(f"c{r}{c}") for r in d for c in d if c <= r))
    less = lambda r, c: F.col(f"c{r}{c}") - sum((F.col(f"l{r}{k}") * F.col(f"l{c}{k}") for k in range(c)), F.lit(0.0))
    for c in d:
        # statistics that depend on each other leave rounding errors only; those are no spread
        frame = frame.withColumn(f"l{c}{c}", F.sqrt(F.greatest(less(c, c), 1e-6 * F.col(f"c{c}{c}"))))
        if c + 1 < _DIM:
            frame = frame.withColumns({f"l{r}{c}": less(r, c) / F.col(f"l{c}{c}") for r in range(c + 1, _DIM)})
    frame = frame.withColumns({f"i{r}{r}": 1 / F.col(f"l{r}{r}") for r in d})
    for gap in range(1, _DIM):
        rest = lambda r, c: sum((F.col(f"l{r}{k}") * F.col(f"i{k}{c}") for k in range(c, r)), F.lit(0.0))
        frame = frame.withColumns({f"i{c + gap}{c}": -rest(c + gap, c) / F.col(f"l{c + gap}{c + gap}") for c in range(_DIM - gap)})
    logdet = sum((2 * F.ln(f"l{r}{r}") for r in d), F.lit(0.0)).alias("logdet")
    return frame.select(*by, logdet, *(f"m{r}" for r in d), *(f"i{r}{c}" for r in d for c in d if c <= r))


_PAIRS = [(r, c) for r in range(_DIM) for c in range(r + 1)]


def _sums(x: list[Column]) -> dict[str, Column]:
    return {"n": F.lit(1)} | {f"a{k}": x[k] for k in range(_DIM)} | {f"p{r}{c}": x[r] * x[c] for r, c in _PAIRS}


def _moments(sums: DataFrame, factor: float) -> DataFrame:
    """The estimate from sums over documents; a variance below its floor is lifted to it."""
    mean = [F.col(f"a{k}") / F.col("n") for k in range(_DIM)]
    raw = lambda r, c: factor * (F.col(f"p{r}{c}") / F.col("n") - mean[r] * mean[c])
    cov = [[F.greatest(raw(r, r), F.lit(FLOORS[r] ** 2)) if r == c else raw(r, c) if c <= r else None for c in range(_DIM)] for r in range(_DIM)]
    return _estimate(sums, mean, cov)


def _starts(rows: DataFrame, x: list[Column]) -> DataFrame:
    """An estimate for each group and start, from medians and median absolute deviations and, in units of those, from spatial signs, tanh scores and quadrants."""
    fine = lambda v: F.floor(v * 1000).cast("int")
    middle = rows.groupBy("group").agg(*((F.percentile(fine(v), F.lit(0.5)) / 1000).alias(f"med{k}") for k, v in enumerate(x)))
    spread = rows.join(written(middle, "medians"), "group")
    spread = spread.groupBy("group").agg(*(F.first(f"med{k}").alias(f"med{k}") for k in range(_DIM)), *(F.percentile(fine(F.abs(v - F.col(f"med{k}"))), F.lit(0.5)).alias(f"mad{k}") for k, v in enumerate(x)))
    scale = {f"u{k}": F.greatest(1.4826 * F.col(f"mad{k}") / 1000, F.lit(FLOORS[k])) for k in range(_DIM)}
    units = written(spread.withColumns(scale).drop(*(f"mad{k}" for k in range(_DIM))), "units")
    z = rows.join(units, "group").select("group", *(((v - F.col(f"med{k}")) / F.col(f"u{k}")).alias(f"z{k}") for k, v in enumerate(x)))
    z = z.withColumn("far", sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(_DIM)), F.lit(0.0)))
    pair = {
        "signs": lambda r, c: F.when(F.col("far") > 0, F.col(f"z{r}") * F.col(f"z{c}") / F.col("far")).otherwise(0.0),
        "tanh": lambda r, c: F.tanh(f"z{r}") * F.tanh(f"z{c}"),
        "quadrants": lambda r, c: F.signum(f"z{r}") * F.signum(f"z{c}"),
    }
    means = z.groupBy("group").agg(*(F.avg(f(r, c)).alias(f"{k}{r}{c}") for k, f in pair.items() for r, c in _PAIRS)).join(units, "group")

    def shape(start, r, c):
        if start == "deviations":
            return F.lit(1.0 if r == c else 0.0)
        return F.col(f"{start}{r}{c}") + (0.05 if r == c else 0.0)  # which keeps it regular

    out = []
    for start in STARTS:
        cov = [[shape(start, r, c) * F.col(f"u{r}") * F.col(f"u{c}") if c <= r else None for c in range(_DIM)] for r in range(_DIM)]
        out.append(_estimate(means.withColumn("start", F.lit(start)), [F.col(f"med{k}") for k in range(_DIM)], cov))
    return written(reduce(DataFrame.union, out), "starts")


def _concentrated(rows: DataFrame, x: list[Column], now: DataFrame) -> DataFrame:
    """A concentration step: mean and covariance of the SUBSET share of documents nearest to each estimate.

    Distances are counted in fine bins, with sums for each; of the bin in which the share ends, that part of its sums is
    taken that is still missing.
    """
    place = F.floor(256 * F.log2(1 + _distance(x))).cast("int")
    names = list(_sums(x))
    bins = rows.join(now, "group").groupBy("group", "start", place.alias("place")).agg(*(F.sum(v).alias(k) for k, v in _sums(x).items()))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(Window.partitionBy("group", "start"))
    near = bins.withColumn("part", F.least(F.lit(1.0), (F.ceil(SUBSET * every) - before) / F.col("n"))).filter("part > 0")
    sums = near.groupBy("group", "start").agg(*(F.sum(F.col(k) * F.col("part")).alias(k) for k in names))
    return written(_moments(sums, CONSISTENCY), "estimate")


def _best(estimates: DataFrame) -> DataFrame:
    """Of each group's estimates that with the least determinant; of equals the first by name of start."""
    rank = F.struct("logdet", "start")
    return estimates.groupBy("group").agg(*(F.min_by(c, rank).alias(c) for c in estimates.columns if c != "group"))


def fit(stats: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates from rows (lang, source, s): for each language and source fit_lang, fit_source, fit, logdet, mean m and inverse factor i.

    Documents that fail the base rules aren't used. From each of the STARTS, STEPS concentration steps lead to a share of
    documents whose covariance has a small determinant; from the start with the least, MORE_STEPS follow, and of all
    estimates on the way the one with the least determinant is kept. Its mean and covariance are taken once more over
    the documents within REWEIGHT. Medians and nearness are counted in fine bins, so a quantile needs a bounded table of
    counts, is the same in every run, and needs no group in one task; a step is one pass, which sums up each bin. FLOORS
    apply where nearly all documents of a group agree in a statistic, which leaves no spread to measure.

    fit is "source" for groups of MIN_GROUP documents and more. Smaller ones get the estimate of all documents of their
    language (fit "language") or, if these are fewer as well, of all documents ("all"); if even those are fewer, no row.
    """
    slim = stats.filter(~base_failed(F.col("s"))).select(_key(F.col("lang")).alias("lang"), _key(F.col("source")).alias("source"), *(v.alias(f"x{k}") for k, v in enumerate(vector(F.col("s")))))
    sizes = slim.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang, every = Window.partitionBy("lang"), Window.partitionBy()  # over a row for each language and source
    level = F.when(F.col("n") >= MIN_GROUP, "source").when(F.col("n_lang") >= MIN_GROUP, "language").when(F.col("n_all") >= MIN_GROUP, "all")
    groups = {"source": F.concat(F.lit("s"), F.hex("lang"), F.lit("/"), F.hex("source")), "language": F.concat(F.lit("l"), F.hex("lang")), "all": F.lit("a")}
    name = F.when(F.col("fit") == "source", groups["source"]).when(F.col("fit") == "language", groups["language"]).otherwise(groups["all"])
    sizes = sizes.withColumns({"n_lang": F.sum("n").over(by_lang), "least": F.min("n").over(by_lang), "n_all": F.sum("n").over(every)})
    named = sizes.withColumn("fit", level).withColumn("group", name)
    # what documents of a language and source are counted in: their own estimate, and those that smaller groups need
    pools = F.array(F.when(F.col("n") >= MIN_GROUP, groups["source"]), F.when((F.col("least") < MIN_GROUP) & (F.col("n_lang") >= MIN_GROUP), groups["language"]))
    pools = F.when(F.max(F.col("fit") == "all").over(every), F.concat(F.array_compact(pools), F.array(groups["all"]))).otherwise(F.array_compact(pools))
    names = written(named.withColumn("pools", pools).select("lang", "source", "fit", "group", "pools"), "groups")
    into = names.select("lang", "source", F.explode("pools").alias("group"))
    x = [F.col(f"x{k}") for k in range(_DIM)]
    rows = written(slim.join(into, ["lang", "source"]).select("group", *x), "vectors")

    now, seen = _starts(rows, x), []
    for _ in range(STEPS):
        now = _concentrated(rows, x, now)
        seen.append(now)
    now = _best(now)
    for _ in range(MORE_STEPS):
        now = _concentrated(rows, x, now)
        seen.append(now)
    best = written(_best(reduce(DataFrame.union, seen)), "estimate")
    near = rows.join(best, "group").filter(_distance(x) <= REWEIGHT).groupBy("group", "start").agg(*(F.sum(v).alias(k) for k, v in _sums(x).items()))
    last = _moments(near, REWEIGHT_CONSISTENCY).drop("logdet").join(best.select("group", "logdet"), "group")
    return written(names.drop("pools").join(last, "group").drop("group").withColumnsRenamed({"lang": "fit_lang", "source": "fit_source"}), "fit")


def judged(frame: DataFrame, fitted: DataFrame, lang: Column, source: Column, s: Column) -> DataFrame:
    """frame with the columns kept and fit added; its rows are joined to the estimate of their language and source."""
    keyed = frame.join(fitted, (_key(lang) == F.col("fit_lang")) & (_key(source) == F.col("fit_source")), "left")
    far = F.coalesce(_distance(vector(s)) > CUTOFF, F.lit(False))
    kept = F.greatest(base_failed(s).cast("int"), far.cast("int")) == 0  # one term: a filter on it must not be pushed below the statistics in parts
    return keyed.select(*(frame[c] for c in frame.columns), kept.alias("kept"), F.when(~base_failed(s), F.coalesce("fit", F.lit("none"))).alias("fit"))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics and verdict of each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, fit.

    base_failed: fewer than MIN_WORDS words, or repeated windows cover over MAX_REPEAT_PERCENT of them. A document that
    passes is kept unless its transformed statistics lie further than CUTOFF from the robust centre of its language and
    source; fit says whose estimate that was ("source", "language", "all", see ``fit``), or "none" where all documents
    together are too few for one, and it is kept; it is null for documents that failed.

    A row for each input row. Null text counts as empty and fails; null languages and sources are groups of their own;
    ids may be null or repeat. Other columns aren't read.
    """
    stats = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[source_col].alias("source"), base_statistics(docs[text_col]).alias("s"))
    stats = written(stats, "statistics")
    out = judged(stats, fit(stats), F.col("lang"), F.col("source"), F.col("s"))
    return out.select("doc_id", *(f"s.{n}" for n in _BASE), base_failed(F.col("s")).alias("base_failed"), "kept", "fit")


def filtered(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents, with all their columns, that ``quality`` keeps. They are written with their statistics beside them, which are so taken once, and stay where they are."""
    names = {c: f"d{k}" for k, c in enumerate(docs.columns)}
    beside = written(docs.select(*(docs[c].alias(n) for c, n in names.items()), base_statistics(docs[text_col]).alias("s")), "documents")
    fitted = fit(beside.select(F.col(names[lang_col]).alias("lang"), F.col(names[source_col]).alias("source"), "s"))
    out = judged(beside, fitted, F.col(names[lang_col]), F.col(names[source_col]), F.col("s")).filter("kept")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))
