"""Quality rules: base statistics of every text, and robust outliers by language and source.

``statistics`` counts words, symbols, repeated lines and repeated five-word windows of whole texts.
``verdicts`` turns the counts into a vector of ``DIMS`` shares and estimates, for each pair of
language and source, the centre and scatter of the three quarters of the documents that lie
together most closely (minimum covariance determinant): from the medians on, ``STEPS`` times, the
documents with the smallest Mahalanobis distances give the next mean and covariance. A document
whose distance to the final estimate exceeds ``CUTOFF`` is rejected.

All documents take part; distances are ranked by counts over fixed classes of their logarithm, so the
subset is cut at a class edge and no task sorts or holds a group. ``FLOOR`` is added to each
standard deviation: counts that are nearly always zero have no scatter of their own, and differences
below it are of no interest. The logarithm and the shares are taken with a few words or lines added,
since short texts scatter more.

Documents that fail the base rules take no part in the estimate. Groups of fewer than ``LEAST``
documents are too small for one: their documents are judged by the estimate of all documents of their
language, and by that of all documents if the language has fewer than ``LEAST`` too, so every document
gets a distance. Null languages and sources are groups of their own. Null texts have no words. Repeated rows count each. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.functions.arrays import let
from relloom.session import materialise

SPACES = " \t\n\x0b\x0c\r"
SHINGLE = 5
DIMS = ("len", "symbols", "lines", "repeats")
#: Standard deviations below these tell nothing, for each of DIMS.
FLOOR = (0.04, 0.04, 0.12, 0.12)
#: Share of a group that must lie close together, and chi-square factor that makes the scatter of
#: that share consistent for four dimensions: 0.75 / P(chi2(6) <= q), q the 0.75 quantile of chi2(4).
SHARE = 0.75
CONSISTENT = 1.485
STEPS = 4
CUTOFF = 25.0
LEAST = 20
#: Classes of a distance's logarithm per unit, and of a coordinate in the first median.
CLASSES = 32
MEDIAN_CLASSES = 100


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in an array of words."""

    def marked(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            keyed,
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False))
                            | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False)),
                        ),
                        lambda e: e["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(
                        at, lambda p, k: F.least(F.lit(SHINGLE), F.coalesce(F.get(at, k + 1) - p, F.lit(SHINGLE)))
                    ),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE)))
    )
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))
    return F.when(F.size(words) >= SHINGLE, counted).otherwise(F.lit(0)).cast("long")


def counts(text: Column) -> Column:
    """Struct of the base counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long")
    return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    whole: bool = False,
) -> DataFrame:
    """Written table (doc_id, lang, source, base counts, n_lines, base_failed), one row per row; ``whole``: and the row itself."""
    row = [F.struct(*docs.columns).alias("whole")] if whole else []
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        counts(F.col(text_col)).alias("c"), *row,
    )
    flat = counted.select("doc_id", "lang", "source", "c.w.*", "c.l.*", "c.n_symbols", *["whole"] * len(row))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return materialise(flat.withColumn("base_failed", failed))


def _vector() -> dict[str, Column]:
    def share(part: str, whole: str, more: float) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(whole) + F.lit(more)))))

    return {
        "len": F.log((F.col("word_chars") + 500.0) / (F.col("n_words") + 100.0)),
        "symbols": share("n_symbols", "word_chars", 500.0),
        "lines": share("n_dup_lines", "n_lines", 10.0),
        "repeats": share("n_repeat_words", "n_words", 100.0),
    }


def _group() -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("lang", "source")]
    return F.concat(parts[0], F.lit("\x1f"), parts[1])


def _language() -> Column:
    return F.concat(F.lit("L"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")))


def _factors(estimate: DataFrame) -> DataFrame:
    """(g, m_i, l_ij, d_i): centre, and the factors L D L' of the scatter c_ij, floors added."""
    for j, x in enumerate(DIMS):
        d = F.col(f"c_{x}_{x}") * CONSISTENT + FLOOR[j] ** 2
        for k in DIMS[:j]:
            d = d - F.col(f"l_{x}_{k}") * F.col(f"l_{x}_{k}") * F.col(f"d_{k}")
        estimate = estimate.withColumn(f"d_{x}", d)
        for y in DIMS[j + 1 :]:
            v = F.col(f"c_{x}_{y}") * CONSISTENT
            for k in DIMS[:j]:
                v = v - F.col(f"l_{y}_{k}") * F.col(f"l_{x}_{k}") * F.col(f"d_{k}")
            estimate = estimate.withColumn(f"l_{y}_{x}", v / F.col(f"d_{x}"))
    return estimate


def _distances(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """``rows`` with ``dist``, the squared Mahalanobis distance to their group's centre."""
    out = rows.join(factors, "g")
    total = F.lit(0.0)
    for j, x in enumerate(DIMS):
        v = F.col(x) - F.col(f"m_{x}")
        for k in DIMS[:j]:
            v = v - F.col(f"l_{x}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{x}", v)
        total = total + F.col(f"y_{x}") * F.col(f"y_{x}") / F.col(f"d_{x}")
    return out.withColumn("dist", total).select(*rows.columns, "dist")


def _first(rows: DataFrame) -> DataFrame:
    """Medians as centres and the floors alone as scatter."""
    cells = rows.select(
        "g", F.explode(F.array(*[F.struct(F.lit(x).alias("dim"), F.col(x).alias("v")) for x in DIMS])).alias("e")
    ).select("g", "e.dim", F.floor(F.col("e.v") * MEDIAN_CLASSES).alias("cell"))
    counted = cells.groupBy("g", "dim", "cell").agg(F.count("*").alias("n"))
    ordered = W.partitionBy("g", "dim").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("g", "dim")
    placed = counted.select(
        "g", "dim", "cell", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(whole).alias("size")
    )
    middle = placed.where(F.col("upto") * 2 >= F.col("size")).groupBy("g", "dim", "size").agg(F.min("cell").alias("cell"))
    value = (F.col("cell") + 0.5) / MEDIAN_CLASSES
    first = middle.groupBy("g", "size").agg(
        *[F.max(F.when(F.col("dim") == x, value)).alias(f"m_{x}") for x in DIMS]
    )
    zero = {f"c_{x}_{y}": F.lit(0.0) for i, x in enumerate(DIMS) for y in DIMS[i:]}
    return materialise(_factors(first.withColumns(zero)).drop(*zero))


def _closer(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """The next estimate: mean and covariance of the closest SHARE of each group."""
    placed = _distances(rows, factors.drop("size")).withColumn(
        "cell", F.floor(F.log(F.col("dist") + 1e-9) * CLASSES)
    )
    counted = placed.groupBy("g", "cell").agg(F.count("*").alias("n"))
    ordered = W.partitionBy("g").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("g")
    upto = counted.select("g", "cell", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(whole).alias("size"))
    edge = materialise(
        upto.where(F.col("upto") >= F.col("size") * SHARE).groupBy("g", "size").agg(F.min("cell").alias("edge"))
    )
    near = placed.join(edge, "g").where("cell <= edge")
    sums = near.groupBy("g", "size").agg(
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s_{x}") for x in DIMS],
        *[F.sum(F.col(x) * F.col(y)).alias(f"s_{x}_{y}") for i, x in enumerate(DIMS) for y in DIMS[i:]],
    )
    means = sums.withColumns({f"m_{x}": F.col(f"s_{x}") / F.col("n") for x in DIMS})
    scatter = {
        f"c_{x}_{y}": F.col(f"s_{x}_{y}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}")
        for i, x in enumerate(DIMS)
        for y in DIMS[i:]
    }
    factors = _factors(means.withColumns(scatter))
    return materialise(
        factors.select("g", "size", *[c for c in factors.columns if c[:2] in ("m_", "l_", "d_")])
    )


def _pools(keyed: DataFrame) -> DataFrame:
    """Written table (g, used, pools): the key of the estimate that judges each group of language and
    source, and the keys of all estimates that its documents take part in."""
    groups = keyed.groupBy("g", "lg").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    by_lang = groups.groupBy("lg").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    placed = materialise(
        groups.join(by_lang, "lg").withColumn(
            "used", F.when(F.col("n") >= LEAST, F.col("g")).when(F.col("n_lang") >= LEAST, F.col("lg")).otherwise(F.lit(EVERY))
        )
    )
    every = placed.where(F.col("used") == EVERY).limit(1).count() > 0
    pools = F.array(
        F.when(F.col("n") >= LEAST, F.col("g")),
        F.when((F.col("least") < LEAST) & (F.col("n_lang") >= LEAST), F.col("lg")),
        F.when(F.lit(every), F.lit(EVERY)),
    )
    return materialise(placed.select("g", "used", F.filter(pools, lambda x: x.isNotNull()).alias("pools")))


#: Key of the pool of all rows; keys of groups begin with "=" or "-", those of languages with "L".
EVERY = "A"


def verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` with ``dist`` and ``kept``."""
    keyed = stats.withColumns({"g": _group(), "lg": _language(), **_vector()})
    pools = _pools(keyed)
    keyed = keyed.join(pools, "g", "left")
    rows = keyed.where(~F.col("base_failed")).select(F.explode("pools").alias("g"), *DIMS)
    estimate = _first(rows)
    for _ in range(STEPS):
        estimate = _closer(rows, estimate)
    estimate = estimate.drop("size").withColumnRenamed("g", "used")
    out = keyed.join(estimate, "used", "left")
    total = F.lit(0.0)
    for j, x in enumerate(DIMS):
        v = F.col(x) - F.col(f"m_{x}")
        for k in DIMS[:j]:
            v = v - F.col(f"l_{x}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{x}", v)
        total = total + F.col(f"y_{x}") * F.col(f"y_{x}") / F.col(f"d_{x}")
    out = out.withColumn("dist", total)
    kept = ~F.col("base_failed") & F.coalesce(F.col("dist") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept).select(*stats.columns, "dist", "kept")


def quality(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, base counts, base_failed, dist, kept) for every document."""
    return verdicts(statistics(docs, **columns)).select("doc_id", *COUNTS, "base_failed", "dist", "kept")


def good_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by its own text, whatever its id.

    Rows are written beside their counts, so the verdicts, for which groups are joined to rows, need no join by row.
    """
    return verdicts(statistics(docs, whole=True)).where("kept").select("whole.*")
