"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

The verdict is a minimum-covariance-determinant one.  Each group of documents - a (language, source), a language, and
all documents - gets the centre and scatter of the ``coverage`` share of its documents whose covariance has the least
determinant.  The search is that of the deterministic MCD (Hubert, Rousseeuw, Verdonck 2012): several starts (medians
with quartile scales, moments of robustly squashed values, classical moments), concentration steps from each, the
start of least determinant goes on until its determinant stops falling.  A step is two pre-aggregated passes: counts
per logarithmic distance bucket tell how far the nearest share reaches, sums of values and products of just those rows
are the new moments.  No group is ever gathered, sorted or sampled, and the tables of groups are the only thing that
is joined to the rows.

Small groups lean on their parent: the moments of a (language, source) with n documents are ``n / (n + prior)`` its
own and the rest its language's, and those of a language lean on all documents' alike, so that there is no size at
which the rule changes.  A document is rejected where its squared Mahalanobis distance exceeds the point that a
chi-squared variable exceeds with probability ``tail``; documents with few words, whose shares are noisy, are held to
a distance shrunk by ``n_words / (n_words + 50)``.  Scatter has a floor, as a statistic may be constant in a group:
a small one for the statistics that vary, and for repeated lines and words, which nine in ten documents lack
altogether, the spread that clean documents show.

The vectors are transformed: log of the mean word length, square roots of the shares of capitals, punctuation and
symbols among the characters, of repeated lines among the lines and of repeated words among the words.

Defined results: null text counts as empty, has no words and fails the base rules; null language or source is a
value like any other; repeated rows are judged alike; texts of any length are counted whole; extra columns, whatever
their names, are ignored (``drop_low_quality`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, drop_chars, drop_rows, pick, stage, value_key

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = "!\"'(),-./:;?@[]\\^_`{}~"
#: Statistic and the least standard deviation that it is given.
STATISTICS = {"x0": 0.03, "x1": 0.02, "x2": 0.02, "x3": 0.015, "x4": 0.12, "x5": 0.12}
WINDOW = 8
_D, _FLOORS, _SALTS = len(STATISTICS), list(STATISTICS.values()), 64


def _repeats(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows of eight words that occur at least twice, the first one included.

    Windows are hashed by doubling (2, 4, 8 words), so that each costs three hashes; only texts with an equal pair
    of window hashes sort them, with positions, to add up what the repeated windows cover.
    """
    pair = lambda a, b: F.xxhash64(a, b)
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        rows = rows.withColumn("h", F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), pair))
    rows = rows.withColumn("h", F.slice("h", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    by_hash = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(twice, by_hash))
    same = lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("p", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])))
    gaps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(WINDOW), b - a), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "s", "p")


def _row_key(*columns: str) -> Column:
    """Key of text, language and source, on which alone a verdict depends."""
    return value_key(*[F.col(c) for c in columns])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key and counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text", "lang", "source").withColumn("row_key", _row_key("text", "lang", "source"))
    rows = rows.withColumn("text", text)
    trimmed = F.trim(F.col("text"), F.lit(SPACE_CHARS))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = _repeats(rows.withColumn("lines", lines))
    n_chars = F.char_length("text")
    less = lambda chars: (n_chars - F.char_length(drop_chars(F.col("text"), chars))).cast("long")
    return rows.select(
        "doc_id", "lang", "source", "row_key",
        F.size("words").cast("long").alias("n_words"),
        (n_chars - less(SPACE_CHARS)).cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        less(CAPITALS).alias("n_capitals"),
        less(PUNCTUATION).alias("n_punctuation"),
    )


def _vector(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    mean_len = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    pairs = [("n_capitals", "word_chars"), ("n_punctuation", "word_chars"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words")]
    return rows.withColumns({"x0": mean_len} | {f"x{k + 1}": share(*p) for k, p in enumerate(pairs)})


def _chi2(x: float, d: int) -> float:
    """Distribution function of chi-squared with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(d // 2))


def chi2_point(p: float) -> float:
    """The point below which chi-squared, with a degree of freedom for each statistic, lies with probability ``p``."""
    lo, hi = 0.0, 1e3
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, _D) < p else (lo, mid)
    return lo


def _consistency(coverage: float) -> float:
    """Factor that makes the scatter of the nearest share of a normal sample that of the whole."""
    return coverage / _chi2(chi2_point(coverage), _D + 2)


# The moments of a group are an array: count, sums, sums of products (the lower triangle by rows).
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]
_AT = {p: 1 + _D + k for k, p in enumerate(_PAIRS)}
_SIZE = 1 + _D + len(_PAIRS)
_COEFS = [f"w{k}" for k in range(_SIZE)]


def _moments(rows: DataFrame, *keys: str, values: list[Column] | None = None) -> DataFrame:
    """(keys, s): the moment array of x0.., or of ``values``, for each key.  The sums are rows, not columns, so that
    the code of the aggregate stays small."""
    x = values or [F.col(f"x{i}") for i in range(_D)]
    parts = F.array(F.lit(1.0), *x, *[x[i] * x[j] for i, j in _PAIRS])
    sums = rows.select(*keys, F.posexplode(parts).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    entries = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("e"))  # _SIZE entries
    return entries.select(*keys, F.transform("e", lambda e: e["v"]).alias("s"))


def _inverse(a: Column) -> Column:
    """(a, logdet): minus the inverse of a symmetric matrix, an array by rows, and the log of its determinant, by
    sweeping each diagonal element."""

    def sweep(acc: Column, k: Column) -> Column:
        d = F.greatest(F.get(acc["a"], k * (_D + 1)), F.lit(1e-12))

        def cell(v: Column, at: Column) -> Column:
            i, j = F.floor(at / _D).cast("int"), at % _D
            rest = v - F.get(acc["a"], i * _D + k) * F.get(acc["a"], k * _D + j) / d
            return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d).otherwise(rest)

        return F.struct(F.transform(acc["a"], cell).alias("a"), (acc["logdet"] + F.log(d)).alias("logdet"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_D - 1)), F.struct(a.alias("a"), F.lit(0.0).alias("logdet")), sweep)


def _fitted(groups: DataFrame, *keep: str, factor: float = 1.0) -> DataFrame:
    """(keep, logdet, w0..): from moment arrays s, the log of the determinant of the scatter and the coefficients that
    make the squared distance of a row the product of w with (1, x0.., products)."""
    at = lambda i, j: _AT[max(i, j), min(i, j)]
    s = lambda k: F.get("s", F.lit(k)) / F.get("s", F.lit(0))
    groups = groups.withColumn("m", F.array(*[s(1 + i) for i in range(_D)]))
    m = lambda i: F.get("m", F.lit(i))
    cells = [(s(at(i, j)) - m(i) * m(j)) * factor + (_FLOORS[i] ** 2 if i == j else 0.0) for i in range(_D) for j in range(_D)]
    groups = groups.withColumn("c", F.array(*cells))
    groups = groups.withColumn("q", _inverse(F.col("c")))
    # Plain columns from here on, computed once: q.a is minus the inverse.
    groups = groups.withColumn("p", F.transform(F.col("q")["a"], lambda v: -v))
    line = lambda i: F.aggregate(F.zip_with(F.slice("p", i * _D + 1, _D), F.col("m"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    groups = groups.withColumn("pm", F.transform(F.sequence(F.lit(0), F.lit(_D - 1)), line))
    zero = F.aggregate(F.zip_with("pm", "m", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    w = [zero, *[-2 * F.get("pm", F.lit(i)) for i in range(_D)], *[F.get("p", F.lit(i * _D + j)) * (1 if i == j else 2) for i, j in _PAIRS]]
    return groups.select(*keep, F.col("q")["logdet"].alias("logdet"), *[c.alias(n) for c, n in zip(w, _COEFS)])


def _with_distance(rows: DataFrame) -> DataFrame:
    """Add d2, the squared distance, from x0.. and w0.., and drop the latter."""
    x = [F.col(f"x{i}") for i in range(_D)]
    terms = [F.col("w0"), *[F.col(f"w{1 + i}") * x[i] for i in range(_D)], *[F.col(f"w{_AT[i, j]}") * x[i] * x[j] for i, j in _PAIRS]]
    return rows.withColumn("d2", F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))).drop(*_COEFS)


def _with_groups(rows: DataFrame, groups: DataFrame, n_groups: int, on: str, broadcast_groups: int = 20_000) -> DataFrame:
    """Join a table of ``n_groups`` groups to the rows by ``on``, in both an array of groups or one name.

    Up to ``broadcast_groups`` rows of some 30 numbers are broadcast (5 MB); a larger table is repeated for every salt
    and merged, as a group may hold a third of all rows.
    """
    groups = groups.withColumnRenamed(on, "__g")
    if n_groups <= broadcast_groups:
        return rows.join(F.broadcast(groups), F.col(on) == F.col("__g")).drop("__g")
    spread = groups.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.join(spread.hint("merge"), (F.col(on) == F.col("__g")) & (F.col("salt") == F.col("__s"))).drop("__g", "__s")


def _bucket(d2: Column) -> Column:
    """Eight logarithmic buckets to the factor of two, 320 at most."""
    return F.greatest(F.lit(-80), F.least(F.lit(240), F.floor(F.log2(d2 + 1e-9) * 8))).cast("int")


def _step(rows: DataFrame, fits: DataFrame, n: int, coverage: float, name: str) -> DataFrame:
    """One concentration step for each (group, start): moments of the nearest share, and their fit."""
    near = _with_distance(_with_groups(rows, fits.drop("logdet", "s"), n, "group")).withColumn("bucket", _bucket(F.col("d2")))
    counts = near.groupBy("group", "start", "bucket").agg(F.count("*").alias("n"))
    of, upto = Window.partitionBy("group", "start"), Window.partitionBy("group", "start").orderBy("bucket")
    counts = counts.select("group", "start", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(of).alias("all"))
    reach = counts.filter(F.col("upto") >= F.ceil(F.col("all") * coverage)).groupBy("group", "start").agg(F.min("bucket").alias("reach"))
    reach = stage(reach, "mcd-reach")
    limits = reach.join(fits.drop("logdet", "s"), ["group", "start"])
    inside = _with_distance(_with_groups(rows, limits, n, "group")).filter(_bucket(F.col("d2")) <= F.col("reach"))
    sums = stage(_moments(inside, "group", "start"), "mcd-moments")
    return stage(_fitted(sums, "group", "start", "s", factor=_consistency(coverage)), f"mcd-{name}")


def robust_moments(rows: DataFrame, coverage: float = 0.75, max_steps: int = 12) -> DataFrame:
    """(group, s): the moment array of the share of least determinant for each group of (group, salt, x0..)."""
    quart = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(_D)]
    mid = stage(rows.groupBy("group").agg(*quart), "mcd-quartiles")
    n = mid.count()
    if not n:
        return rows.select("group", F.array(F.lit(0.0)).alias("s"))
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(_FLOORS[i])) for i in range(_D)]
    centre = [F.col(f"q{i}")[1] for i in range(_D)]
    mid = stage(mid.select("group", *[c.alias(f"c{i}") for i, c in enumerate(centre)], *[c.alias(f"d{i}") for i, c in enumerate(scale)]), "mcd-scales")
    # Moments of a sample of one with the medians as means and the quartile scales as deviations.
    c, d = [F.col(f"c{i}") for i in range(_D)], [F.col(f"d{i}") for i in range(_D)]
    diagonal = F.array(F.lit(1.0), *c, *[c[i] * c[j] + (d[i] * d[i] if i == j else 0.0) for i, j in _PAIRS])
    squashed = [c[i] + d[i] * F.tanh((F.col(f"x{i}") - c[i]) / d[i]) for i in range(_D)]
    starts = mid.select("group", F.lit(0).alias("start"), diagonal.alias("s"))
    starts = starts.unionByName(_moments(_with_groups(rows, mid, n, "group"), "group", values=squashed).withColumn("start", F.lit(1)))
    starts = starts.unionByName(_moments(rows, "group").withColumn("start", F.lit(2)))
    fits = stage(_fitted(starts, "group", "start", "s"), "mcd-starts")
    for _ in range(2):
        fits = _step(rows, fits, 3 * n, coverage, "start")
    names = fits.columns
    fits = stage(fits.groupBy("group").agg(F.min(F.struct("logdet", *[c for c in names if c != "logdet"])).alias("b")).select(*[F.col("b")[c].alias(c) for c in names]), "mcd-best")
    for _ in range(max_steps):
        new = _step(rows, fits, n, coverage, "step").select("group", *[F.col(c).alias(f"n_{c}") for c in names if c != "group"])
        both = fits.join(new, "group", "left")
        falls = F.col("n_logdet") < F.col("logdet") - 1e-6
        fits = stage(both.select("group", *[F.when(falls, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in names if c != "group"], falls.alias("fell")), "mcd-kept")
        more = not fits.filter("fell").isEmpty()
        fits = fits.drop("fell")
        if not more:
            break
    return fits.select("group", "s")


def _name(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _centred(s: str, sign: int) -> Column:
    """Mean moments with products about the mean (``sign`` -1) from those about zero, or back (+1)."""
    at = lambda k: F.get(s, F.lit(k))
    return F.array(*[at(k) for k in range(1 + _D)], *[at(_AT[i, j]) + sign * at(1 + i) * at(1 + j) for i, j in _PAIRS])


def _shrunk(robust: DataFrame, rows: DataFrame, prior: float) -> DataFrame:
    """(group, s): mean moments of every (lang, source), leaning on its language's, which lean on all documents'.

    Centres lean on centres and scatters on scatters; how far the centres lie apart is no scatter, or a document that
    is alone in its source would excuse itself.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = robust.select(F.col("group").alias("g"), F.transform("s", lambda v: v / F.get("s", F.lit(0))).alias("s"))
    own = own.select("g", _centred("s", -1).alias("s"))
    sizes = sizes.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang")))
    for name, key in (("own", _name("lang", "source")), ("of_lang", _name("lang")), ("of_all", F.lit("*"))):
        sizes = sizes.withColumn("__g", key).join(own.select(F.col("g").alias("__g"), F.col("s").alias(name)), "__g").drop("__g")
    lean = lambda a, b, n: F.zip_with(a, b, lambda x, y: (x * F.col(n) + y * prior) / (F.col(n) + prior))
    sizes = sizes.withColumn("of_lang", lean("of_lang", "of_all", "n_lang")).withColumn("c", lean("own", "of_lang", "n"))
    return sizes.select(_name("lang", "source").alias("group"), _centred("c", 1).alias("s"))


def _verdicts(docs: DataFrame, tail: float, coverage: float, prior: float, max_steps: int) -> DataFrame:
    """The columns of :func:`quality_rules`, and row_key."""
    rows = _vector(text_statistics(docs))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    salt = F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(_SALTS)).cast("int")
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "row_key"]
    rows = stage(rows.withColumn("base_failed", failed).withColumn("salt", salt).select(*out, "lang", "source", "salt", *STATISTICS), "quality-rows")
    rest = rows.filter("not base_failed")
    levels = F.array(_name("lang", "source"), _name("lang"), F.lit("*"))
    robust = robust_moments(rest.select(F.explode(levels).alias("group"), "salt", *STATISTICS), coverage, max_steps)
    groups = stage(_shrunk(robust, rest, prior), "quality-groups")
    fits = stage(_fitted(groups, "group", factor=_consistency(coverage)), "quality-fits")
    judged = _with_distance(_with_groups(rest.withColumn("group", _name("lang", "source")), fits.drop("logdet"), fits.count(), "group"))
    judged = judged.withColumn("distance", F.col("d2") * F.col("n_words") / (F.col("n_words") + 50))
    judged = judged.select(*out, (F.col("distance") <= chi2_point(1 - tail)).alias("kept"), "distance")
    base = rows.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(base)


def quality_rules(docs: DataFrame, tail: float = 1e-6, coverage: float = 0.75, prior: float = 40.0, max_steps: int = 12) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance (squared, null where the base rules decide)."""
    return _verdicts(docs, tail, coverage, prior, max_steps).drop("row_key")


def drop_low_quality(docs: DataFrame, tail: float = 1e-6, coverage: float = 0.75, prior: float = 40.0, max_steps: int = 12) -> DataFrame:
    """``docs`` without the rows that :func:`quality_rules` rejects, all columns unchanged.

    A row goes by its own verdict, whatever other rows have its doc_id, or none.
    """
    at = [f"__c{docs.columns.index(c)}" for c in ("text", "lang", "source")]
    keyed = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))]).withColumn("row_key", _row_key(*at))
    names = [*[f"__c{i}" for i in range(len(docs.columns))], "__row_key"]
    names[docs.columns.index("doc_id")] = "doc_id"
    failed = _verdicts(docs, tail, coverage, prior, max_steps).filter("not kept")
    failed = failed.select(F.col("row_key").alias("__row_key"), "doc_id")
    return drop_rows(keyed.toDF(*names), failed, "__row_key", "doc_id").drop("__row_key").toDF(*docs.columns)
