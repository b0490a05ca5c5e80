"""Quality rules: base rules, then robust multivariate outliers by language and source. DataFrame functions only.

Each text gets a vector of transformed statistics. Per group, the minimum-covariance-determinant estimate is sought from
several starts (all rows, and small hashed subsets): each concentration step takes the share H of rows with the least
Mahalanobis distances, in bins of the distance's logarithm, and estimates mean and covariance from them. After the first step the starts with
the least determinants go on, BEST of them; after the last the least is kept, reweighted, and rows beyond a chi-squared cutoff are rejected.
Ties of distance lie in one bin and are taken or left together; ties of determinants go to the first start.

A group is a language and source; those under LEAST rows are pooled by language, and then all together; a pool under LEAST
rows rejects nothing. Groups are aggregated before they are shuffled: what moves is sums and histograms, so
a source with a third of all rows is no burden to one task.

Texts may be as long as Spark's strings; columns with other names are left behind; an empty table gives no rows. Nulls: a null text has no words (base_failed); null languages and sources are groups of their own; a null doc_id
and repeated rows are kept, one result row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackwise.llm.common import checkpointed, stored, table

H = 0.75
LEAST = 50
STARTS = 7
SUBSET = 12
STEPS = 3
BEST = 2
#: Rows rejected by chance where the vectors are normal.
CHANCE = 1e-6
#: (name, least standard deviation): where most rows of a group agree exactly, differences below these are none.
FEATURES = (("log_words", 0.5), ("word_length", 0.25), ("symbol_share", 0.01), ("dup_line_share", 0.1), ("repeat_share", 0.12))
P = len(FEATURES)
SPACE = r"[\x20\x09-\x0D]+"


def chi2_cdf(x: float, k: int) -> float:
    """For odd k, by recurrence from one degree of freedom."""
    total, term_k = math.erf(math.sqrt(x / 2)), 1
    while term_k < k:
        total -= (x / 2) ** (term_k / 2) * math.exp(-x / 2) / math.gamma(term_k / 2 + 1)
        term_k += 2
    return total


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def window_hashes(words: Column) -> Column:
    """64-bit hashes of a text's windows of 3 words, in order."""
    n = F.size(words)
    return F.when(n >= 3, F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(1))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) for each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = split.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        window_hashes(F.col("words")).alias("grams"),
    )
    # Places of windows that occur again: neighbours in the order of (hash, place) with the same hash.
    again = counted.withColumn("again", F.size("grams") > F.size(F.array_distinct("grams")))
    pairs = again.withColumn("pairs", F.when(F.col("again"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda p, j: F.get("pairs", j)["h"] == p["h"]
    places = pairs.withColumn("places", F.sort_array(F.transform(F.filter("pairs", lambda p, j: F.coalesce((j > 0) & same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False))), lambda p: p["i"])))
    # Each place covers three words, less those that the next place covers.
    covered = F.aggregate(F.transform("places", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return places.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(F.when(F.col("again"), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """stats with base_failed and the transformed statistics."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with `grp`: the row's own language and source, or the pool it falls to, or null."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    rows = rows.withColumn("l", name("lang")).withColumn("s", name("source"))
    by_source = rows.filter("NOT base_failed").groupBy("l", "s").agg(F.count("*").alias("n"))
    small = by_source.withColumn("rest", F.when(F.col("n") < LEAST, F.col("n")).otherwise(0))
    small = small.withColumn("n_lang", F.sum("rest").over(Window.partitionBy("l")))
    small = small.withColumn("rest_all", F.when((F.col("n") < LEAST) & (F.col("n_lang") < LEAST), F.col("n")).otherwise(0))
    total = small.agg(F.sum("rest_all").alias("n_all"))
    grp = F.when(F.col("n") >= LEAST, F.concat_ws("|", F.lit("source"), "l", "s")).when(F.col("n_lang") >= LEAST, F.concat_ws("|", F.lit("lang"), "l")).when(F.col("n_all") >= LEAST, F.lit("all"))
    known = small.crossJoin(F.broadcast(total)).select("l", "s", grp.alias("grp"))  # total is one row
    return rows.join(known, ["l", "s"], "left").drop("l", "s")


NAMES = [f for f, _ in FEATURES]
FACTOR = [(i, j) for i in range(P) for j in range(i + 1)]


def estimate(rows: DataFrame, by: list[str], scale: float) -> DataFrame:
    """by, the means m_i, the Cholesky factor l_i_j of the covariance times `scale` with the least deviations added, log_det. The expressions
    are SQL text: there are hundreds of terms."""
    e = F.expr
    sums = [e("count(*) AS n"), *[e(f"sum({c}) AS s_{i}") for i, c in enumerate(NAMES)], *[e(f"sum({NAMES[i]} * {NAMES[j]}) AS q_{i}_{j}") for i, j in FACTOR]]
    out = rows.groupBy(*by).agg(*sums).select(*by, "n", *[e(f"s_{i} / n AS m_{i}") for i in range(P)], *[f"q_{i}_{j}" for i, j in FACTOR])

    def covariance(i: int, j: int) -> str:
        """Less what the factor's columns before j explain."""
        own = f"{scale!r}D * (q_{i}_{j} / n - m_{i} * m_{j}) + {FEATURES[i][1] ** 2 if i == j else 0.0!r}D"
        return own + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))

    for j in range(P):
        root = f"sqrt(greatest({covariance(j, j)}, 1e-12D))"
        out = out.select("*", e(f"{root} AS l_{j}_{j}"), *[e(f"({covariance(i, j)}) / {root} AS l_{i}_{j}") for i in range(j + 1, P)])
    det = " + ".join(f"ln(l_{i}_{i})" for i in range(P))
    return out.select(*by, *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in FACTOR], e(f"{det} AS log_det"))


def with_distance(rows: DataFrame, params: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance: a forward substitution through the Cholesky factor; and the params' start, where they have one."""
    z: list[str] = []
    for i in range(P):
        z.append(f"(({NAMES[i]} - m_{i}" + "".join(f" - l_{i}_{k} * {z[k]}" for k in range(i)) + f") / l_{i}_{i})")
    own = [c for c in ("start",) if c in params.columns and c not in by]
    return rows.join(params, by, how).select(*rows.columns, *own, F.expr(" + ".join(f"{x} * {x}" for x in z) + " AS d2"))


def mcd_distances(rows: DataFrame) -> DataFrame:
    """rows (grp, base_failed, the features) with d2 by the reweighted estimate of their group; null where there is none."""
    fit = rows.filter("NOT base_failed AND grp IS NOT NULL").select("doc_id", "grp", *NAMES)
    sizes = fit.groupBy("grp").agg(F.count("*").alias("size"))
    starts = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start"))
    # Start 0 has all rows; each other start has about SUBSET rows of a group, by hash of id and values.
    pick = F.pmod(F.xxhash64("start", "doc_id", *NAMES), F.greatest(F.lit(1), (F.col("size") / SUBSET).cast("long")))
    first = starts.join(sizes, "grp").filter((F.col("start") == 0) | (pick == 0))
    by = ["grp", "start"]
    scale = H / chi2_cdf(chi2_quantile(H, P), P + 2)
    params = checkpointed(estimate(first, by, 1.0))

    def best(params: DataFrame, n: int) -> DataFrame:
        """Each group's n starts of the least determinants."""
        return params.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "start"))).filter(F.col("place") <= n).drop("place")

    for step in range(STEPS):
        if step == 1:
            params = best(params, BEST)
        far = with_distance(fit, params, ["grp"]).withColumn("bin", F.floor(16 * F.log2(F.col("d2") + 1e-9)))
        bins = far.groupBy(*by, "bin").agg(F.count("*").alias("n"))
        w = Window.partitionBy(*by)
        upto = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("size", F.sum("n").over(w))
        edge = upto.filter(F.col("upto") >= H * F.col("size")).groupBy(*by).agg(F.min("bin").alias("edge"))
        params = checkpointed(estimate(far.join(edge, by).filter("bin <= edge"), by, scale))
    near = with_distance(fit, best(params, 1).drop("start"), ["grp"]).filter(F.col("d2") <= chi2_quantile(0.975, P))
    final = checkpointed(estimate(near, ["grp"], 1.0 / (chi2_cdf(chi2_quantile(0.975, P), P + 2) / 0.975)).drop("log_det"))
    return with_distance(rows, final, ["grp"], "left")


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) for each row of
    docs(doc_id, text, lang, source)."""
    rows = stored(vectors(statistics(docs)))
    found = mcd_distances(_grouped(rows))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - CHANCE, P))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
