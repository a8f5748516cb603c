"""Corpus profiling: counts, shares, crosstabs, lengths, histograms, token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom import rules
from relloom.functions.arrays import explode_once
from relloom.operators.ranking import ranked, running_totals
from relloom.session import lookup


def profile(df: DataFrame, distinct: tuple[str, ...] = ()) -> DataFrame:
    """One row: row count, nulls per column, and distinct values of the asked columns."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns],
        *[F.countDistinct(c).alias(f"{c}_distinct") for c in distinct],
    )


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), *keys)


def value_shares(df: DataFrame, *keys: str) -> DataFrame:
    """Counts with their percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") * 100.0 / total)


def bucket_share(df: DataFrame, column: str = "label", needle: str = "per") -> DataFrame:
    """Rows whose value holds ``needle`` against all others, with percentages."""
    hit = F.count_if(F.col(column).contains(needle))
    rows = F.count(F.lit(1))
    return df.agg(
        hit.alias("n_hit"),
        (rows - hit).alias("n_rest"),
        (hit * 100.0 / rows).alias("share_hit"),
        ((rows - hit) * 100.0 / rows).alias("share_rest"),
    )


def type_pair(df: DataFrame) -> DataFrame:
    return df.withColumn("sub_obj_type", F.concat_ws("_", "subject_type", "object_type"))


def _coverage(df: DataFrame, by: str, values: str) -> DataFrame:
    # Distinct pairs first, so that no task collects the rows of a frequent key.
    pairs = df.select(by, values).distinct()
    seen = pairs.select(F.countDistinct(values).alias("seen")).scalar()
    listed = pairs.groupBy(by).agg(F.sort_array(F.collect_list(values)).alias("values"))
    return listed.withColumns(
        {"n_values": F.size("values"), "coverage": F.size("values") * 100.0 / seen}
    )


def pairs_by_label(df: DataFrame) -> DataFrame:
    """Type pairs seen per label, and their share of all pairs."""
    return _coverage(type_pair(df), "label", "sub_obj_type")


def labels_by_pair(df: DataFrame) -> DataFrame:
    """Labels seen per type pair, and their share of all labels."""
    return _coverage(type_pair(df), "sub_obj_type", "label")


def crosstab(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of value combinations, in long form."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Two-way counts with one column per listed value."""
    wide = df.groupBy(rows).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.na.fill(0, values)


def with_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one table, column ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True
    )


def pair_counts(df: DataFrame, max_label_rows: int = 500) -> DataFrame:
    """Counts of (subject, object) per label, for labels with fewer rows than the limit.

    The rare labels are found first, so only their few rows are counted by pair.
    """
    totals = df.groupBy("label").agg(F.count(F.lit(1)).alias("label_rows"))
    rare = lookup(totals.where(F.col("label_rows") < max_label_rows))
    return df.join(rare, "label").groupBy("label", "label_rows", "subject_entity", "object_entity").agg(
        F.count(F.lit(1)).alias("n")
    )


def length_stats(df: DataFrame, **lengths: Column) -> DataFrame:
    """Max, min, mean and median of each given length.

    Lengths repeat, so the exact median keeps one counter per distinct length; ``medians`` is for
    values that do not repeat.
    """
    aggs = [
        f(v).alias(f"{name}_{tag}")
        for name, v in lengths.items()
        for tag, f in (("max", F.max), ("min", F.min), ("mean", F.avg), ("median", F.median))
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs)


def medians(df: DataFrame, **values: Column) -> DataFrame:
    """(name, median) of each given value, exact for any number of distinct values.

    Values are counted, their counts are totalled in order over range partitions, and the one or two
    values in the middle are read off: no task holds all distinct values. Nulls do not count;
    a name without values has none.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("v")) for k, v in values.items()])
    entry = df.select(F.explode(pairs).alias("e")).select("e.*").where("v IS NOT NULL")
    counts = entry.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counts, ["name"], [F.col("v")], {"upto": F.col("n")})
    # 0-based places of the middle rows: one, or two of an even number.
    places = F.array((F.col("upto_total") - 1).cast("long"), F.col("upto_total").cast("long"))
    middle = F.transform(places, lambda p: F.floor(p / 2))
    here = F.filter(middle, lambda p: (F.col("upto") - F.col("n") <= p) & (p < F.col("upto")))
    found = upto.select("name", "v", F.size(here).alias("times")).where("times > 0")
    return found.groupBy("name").agg((F.sum(F.col("v") * F.col("times")) / 2).alias("median"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the top edge belongs to the last bin, empty bins stay.

    The values are lengths or counts: they are counted once, and the bins follow from the
    counts, not from a second pass over the rows.
    """
    counts = df.groupBy(value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # All values equal: one unit round them, as the plotting libraries do.
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("e")
    ).scalar()
    at = F.floor((F.col("v") - F.col("e.lo")) * bins / (F.col("e.hi") - F.col("e.lo")))
    filled = (
        counts.withColumn("e", edges)
        .groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"), F.first("e").alias("e"))
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("n"), F.first("e").alias("e"))
    )
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return filled.select(
        "n", "e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "bin",
        (F.col("e.lo") + width * F.col("bin")).alias("lower"),
        (F.col("e.lo") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce(F.col("n")[F.col("bin")], F.lit(0)).alias("n"),
    )


def token_counts_table(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    words = explode_once(df, [], F.col(tokens), "pos", "token")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, k: int = 10, tokens: str = "tokens") -> DataFrame:
    return token_counts_table(df, tokens).orderBy(F.col("n").desc(), "token").limit(k)


def bottom_tokens(df: DataFrame, k: int = 30, tokens: str = "tokens") -> DataFrame:
    return token_counts_table(df, tokens).orderBy(F.col("n").asc(), "token").limit(k)


def rank_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rank (from 0) and log10 of the count, most frequent token first.

    The vocabulary grows with the corpus, so the rank is a distributed one.
    """
    rows = ranked(token_counts_table(df, tokens), [], [F.col("n").desc(), F.col("token").asc()])
    return rows.select((F.col("rn") - 1).alias("rank"), "token", "n", F.log10("n").alias("log_n"))


def first_match(column: str, pattern: str) -> Column:
    """Text of the first match, NULL where there is none."""
    return F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, 0))


def match_counts(df: DataFrame, pattern: str, column: str = "sentence") -> DataFrame:
    """Rows by the text of their first match."""
    found = df.select(first_match(column, pattern).alias("match")).where("match IS NOT NULL")
    return found.groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def rows_matching(df: DataFrame, pattern: str, column: str = "sentence") -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def char_class_flags(df: DataFrame, column: str = "sentence") -> DataFrame:
    """One flag per character class."""
    return df.withColumns(
        {f"has_{name}": F.col(column).rlike(p) for name, p in rules.CHAR_CLASSES.items()}
    )
