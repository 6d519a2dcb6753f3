"""Quality rules with adaptive thresholds [native].

Every cutoff comes from the corpus itself: a mergeable quantile sketch per (lang, source)
replaces fixed cutoffs, and a join puts each document beside its group's fences.

The sketch is a log-linear histogram (the integer form of a relative-error quantile
sketch): a value below 64 has a bucket of its own, a larger one shares a bucket with those
that agree in their top six bits, so a quantile is off by 1/32 at most. Two sketches merge
by adding counts, which makes the result independent of partitioning and order: partial
aggregation counts on the map side and only bucket counts are shuffled. Groups with fewer
than ``min_docs`` documents use the merged sketch of their language, and languages with
too few the merged sketch of all.

Rates are counts over units (symbols per character, say). A fence stands where an exponential
tail through a group's upper quartile and ninetieth percentile (or lower quartile and tenth)
leaves one document in ten thousand, so a group's own spread decides, on either side. A
document is out when its count is beyond what the fence lets its units have by more than
chance explains (DEVIATIONS of a Poisson count and one): where a rate is mostly zero, and so
is its fence, a single symbol or repeated line is no reason, many are.

Plan: scan -> features -> bucket counts (one small shuffle) -> thresholds (a row per group, written
to the shared folder) -> features beside the thresholds. Where texts are wanted, features are
computed in either pass: a table of texts and features would take the input's size on disk. A
caller that needs the numbers only writes those once. The join is a broadcast only if the
counted thresholds are few, so texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, broadcast_if_small, table, without

#: Counts that every document gets.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Fenced rates, in thousandths: what is counted, over what.
RATES = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "__lines"), "repeat_rate": ("n_repeat_words", "n_words"), "upper_rate": ("__upper", "__letters"), "word_length": ("word_chars", "n_words")}
ADDED = (*COUNTS, *RATES, "base_failed", "kept", "failed_rules")

#: Fixed values of the base rule: fewest words, most per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Percentiles that a tail runs through, on either side, and half the number of their distances from the outer one
#: to the fence: ln(0.1 / 0.0001) / ln(0.25 / 0.1) is 7.5.
QUANTILES, HALF_TAILS = {"q10": 10, "q25": 25, "q75": 75, "q90": 90}, 15
DEVIATIONS = 3
#: A group with fewer documents takes the fences of its language, and that of all if it has too few.
MIN_DOCS = 30


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add COUNTS, RATES and what they are over, for the whole of ``text`` (null counts as no text).

    n_repeat_words is the number of word positions covered by 3-word windows that occur
    twice or more: repeated windows are found by sorting 64-bit window hashes, and their
    sorted positions p give the covered length as the sum of min(3, next p - p).
    """
    df = without(df, *ADDED)
    columns = [F.col(f"`{c}`") for c in df.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__w": F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), "__l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))})
    n = F.size("__w")
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    df = df.withColumn("__h", F.when(n >= 3, F.transform(F.slice("__w", 1, F.greatest(n - 2, F.lit(0))), lambda _, i: window(i))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__s", F.sort_array("__h"))
    df = df.withColumn("__d", F.array_distinct(F.filter("__s", lambda x, i: (i > 0) & (x == F.get("__s", i - 1)))))
    # few repeated hashes: look each window up; many: sort windows with their positions
    looked_up = F.filter(F.transform("__h", lambda x, i: F.when(F.array_contains(F.col("__d"), x), i)), lambda i: i.isNotNull())
    df = df.withColumn("__z", F.when(F.size("__d") > 64, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    neighbour = lambda x, k: F.coalesce(F.get("__z", k)["h"] == x["h"], F.lit(False))
    sorted_out = F.sort_array(F.transform(F.filter("__z", lambda x, k: neighbour(x, k + 1) | (F.when(k > 0, neighbour(x, k - 1)).otherwise(False))), lambda x: x["i"]))
    df = df.withColumn("__p", F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(F.size("__d") <= 64, looked_up).otherwise(sorted_out))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    chars = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
    lower = F.length(F.regexp_replace(t, r"[^a-z]+", ""))
    upper = F.length(F.regexp_replace(t, r"[^A-Z]+", ""))
    counts = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": covered, "__lines": F.size("__l"), "__upper": upper, "__letters": upper + lower,
    }
    # inline() of one struct: filters on the counts stop here, and so never copy the expressions above
    df = df.select(*columns, F.inline(F.array(F.struct(*[c.cast("long").alias(k) for k, c in counts.items()]))))
    return df.withColumns({r: F.expr(f"{k} * 1000 div greatest({n}, 1)") for r, (k, n) in RATES.items()})


def bucket(v: Column) -> Column:
    """Bucket of a non-negative integer in the log-linear sketch."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest value of a bucket."""
    e = F.greatest(F.floor(b / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - e * 32 + 1).cast("long"), e) - 1


def sketch(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Bucket counts (keys, rule, b, n) of each value column; sketches merge by summing n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("rule"), bucket(F.col(v)).alias("b")) for v in values]))
    return df.select(*keys, pairs.alias("x")).groupBy(*keys, "x.rule", "x.b").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "rule", "b").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], qs: dict[str, int]) -> DataFrame:
    """One row (keys, rule, docs, a column per quantile given in per cent). A window holds the
    buckets of one sketch: a few hundred rows, however many documents they count."""
    w = Window.partitionBy(*keys, "rule")
    cum = sketches.withColumns({"__cum": F.sum("n").over(w.orderBy("b")), "docs": F.sum("n").over(w)})
    at = lambda q: bucket_top(F.min(F.when(F.col("__cum") * 100 >= F.col("docs") * q, F.col("b"))))
    return cum.groupBy(*keys, "rule").agg(F.first("docs").alias("docs"), *[at(q).alias(name) for name, q in qs.items()])


def thresholds(cells: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row (lang, source, a <rate>_hi and a <rate>_lo per rate) from the sketches (lang, source, rule, b, n)."""
    hi = F.expr(f"q90 + {HALF_TAILS} * (q90 - q75) div 2")
    lo = F.expr(f"greatest(q10 - {HALF_TAILS} * (q25 - q10) div 2, 0)")
    level = lambda keys, name, least: quantiles(merge(cells, keys), keys, QUANTILES).select(*keys, "rule", F.when(F.col("docs") >= least, F.struct(hi.alias("hi"), lo.alias("lo"))).alias(name))
    a, b, c = level(["lang", "source"], "f2", min_docs), level(["lang"], "f1", min_docs), level([], "f0", 0)
    b, c = b.withColumnsRenamed({"lang": "l1", "rule": "r1"}), c.withColumnRenamed("rule", "r0")
    got = a.join(b, a["lang"].eqNullSafe(b["l1"]) & (a["rule"] == b["r1"]), "left").join(c, a["rule"] == c["r0"], "left")
    got = got.withColumn("f", F.coalesce("f2", "f1", "f0"))
    return got.groupBy("lang", "source").pivot("rule", list(RATES)).agg(F.first("f.hi").alias("hi"), F.first("f.lo").alias("lo"))


def outside(rate: str) -> Column:
    """Whether a rate is beyond a fence by more than chance; without fences it isn't."""
    k, n = (F.col(c).cast("double") for c in RATES[rate])
    n = F.greatest(n, F.lit(1.0))
    hi, lo = (F.col(f"{rate}_{side}").cast("double") for side in ("hi", "lo"))
    chance = lambda f: DEVIATIONS * DEVIATIONS * 1000 * (n * f + 1000)
    over, under = 1000 * k - n * hi, n * lo - 1000 * k
    return F.coalesce((over > 0) & (over * over > chance(hi)) | (under > 0) & (under * under > chance(lo)), F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def judged(counted: DataFrame, scratch: Scratch, lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of ``with_counts`` with base_failed, failed_rules and kept. ``counted`` is computed twice, if it
    isn't a written table."""
    # documents that fail the base rule take no part in the sketches
    cells = sketch(counted.filter(~base_failed()), [lang, source], list(RATES)).withColumnsRenamed({lang: "lang", source: "source"})
    fences = scratch.keep(thresholds(scratch.keep(cells, "sketches"), min_docs), "fences")
    small = broadcast_if_small(fences.withColumnsRenamed({"lang": "__lang", "source": "__source"}), fences.count())
    got = counted.join(small, counted[lang].eqNullSafe(small["__lang"]) & counted[source].eqNullSafe(small["__source"]), "left")
    failed = F.filter(F.array(*[F.when(outside(r), F.lit(r)) for r in RATES]), lambda x: x.isNotNull())
    got = got.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return got.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__lang", "__source", "__lines", "__upper", "__letters", *[f"{r}_{side}" for r in RATES for side in ("hi", "lo")])


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``df`` with ADDED: counts, rates, base_failed, failed_rules, kept.

    Input columns of those names are replaced. A null text counts as empty and fails the base
    rule; null lang or source are groups of their own; an empty table gives an empty result;
    repeated rows are judged each for itself, and equal documents alike within a group; a value
    on a fence is within it; long texts are counted whole.
    """
    scratch = Scratch(df.sparkSession)
    return judged(with_counts(df, text), scratch, lang, source, min_docs)


def op2(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    counted = with_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return judged(scratch.keep(counted, "counted"), scratch).select("doc_id", *COUNTS, "base_failed", "kept")


#: The rates' counts and units in the oracle.
_SQL = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "upper_rate": ("upper_n", "upper_n + lower_n"), "word_length": ("word_chars", "n_words")}


def oracle_sql() -> str:
    """The same rows in DuckDB: exact window strings instead of hashes; exact quantiles of the rates,
    rounded up to what a bucket holds (six leading bits), instead of sketches; the verdict in integers."""
    word = r"[^\x20\x09-\x0D]+"
    pairs = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{r}' AS rule, ({k})::HUGEINT AS k, greatest({n}, 1)::HUGEINT AS n FROM r" for r, (k, n) in _SQL.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper_n, length(regexp_replace(text, '[^a-z]+', '', 'g')) AS lower_n
  FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed FROM c),
u AS ({pairs}),
q AS (
  SELECT lang, source, rule, grouping(lang, source) AS g, count(*) AS docs, {", ".join(f"quantile_disc((1000 * k // n)::BIGINT, {p / 100}) AS {name}" for name, p in QUANTILES.items())}
  FROM u WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, rule), (lang, rule), (rule))),
t AS (SELECT lang, source, rule, g, docs, {", ".join(f"CASE WHEN {name} < 64 THEN {name} ELSE ({name} // (2 ** (floor(log2(greatest({name}, 1))) - 5))::BIGINT + 1) * (2 ** (floor(log2(greatest({name}, 1))) - 5))::BIGINT - 1 END AS {name}" for name in QUANTILES)} FROM q),
f AS (SELECT lang, source, rule, g, docs, q90 + floor({HALF_TAILS / 2} * (q90 - q75))::BIGINT AS hi, greatest(q10 - floor({HALF_TAILS / 2} * (q25 - q10))::BIGINT, 0) AS lo FROM t),
x AS (
  SELECT u.rid, u.k, u.n, CASE WHEN f2.docs >= {MIN_DOCS} THEN f2.hi WHEN f1.docs >= {MIN_DOCS} THEN f1.hi ELSE f0.hi END AS hi,
    CASE WHEN f2.docs >= {MIN_DOCS} THEN f2.lo WHEN f1.docs >= {MIN_DOCS} THEN f1.lo ELSE f0.lo END AS lo
  FROM u LEFT JOIN f f2 ON f2.g = 0 AND f2.rule = u.rule AND f2.lang IS NOT DISTINCT FROM u.lang AND f2.source IS NOT DISTINCT FROM u.source
  LEFT JOIN f f1 ON f1.g = 1 AND f1.rule = u.rule AND f1.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN f f0 ON f0.g = 3 AND f0.rule = u.rule WHERE f2.rule IS NOT NULL),
j AS (SELECT rid, bool_or(greatest(1000 * k - n * hi, 0) ** 2 > 1000 * {DEVIATIONS**2} * (n * hi + 1000) OR greatest(n * lo - 1000 * k, 0) ** 2 > 1000 * {DEVIATIONS**2} * (n * lo + 1000)) AS bad FROM x GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(bad, false)) AS kept FROM r LEFT JOIN j USING (rid)
"""
