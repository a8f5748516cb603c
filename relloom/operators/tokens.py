"""Token arrays: pair input, vocabulary, truncation and padding, drops and masks.

Operators work on any ``ARRAY<STRING>`` column; blank and character tokens are built in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom import rules
from relloom.functions.arrays import explode_once, let
from relloom.functions.text import hash_order, share_digits
from relloom.operators.profile import token_counts_table
from relloom.session import materialise


def tokens_of(text: Column, kind: str = "blank") -> Column:
    if kind == "blank":
        return F.split(text, " ")
    if kind == "character":
        # An empty text has no characters.
        return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"unknown tokenizer {kind!r}")


def tokenize(df: DataFrame, column: str = "sentence", kind: str = "blank") -> DataFrame:
    return df.withColumn("tokens", tokens_of(F.col(column), kind))


def pair_input(df: DataFrame, single: bool = False, subject_first: bool = False) -> DataFrame:
    """``[CLS] entities [SEP] sentence [SEP]`` with segment ids, or the sentence alone."""
    cls, sep = F.array(F.lit(rules.CLS)), F.array(F.lit(rules.SEP))
    sentence = tokens_of(F.col("sentence"))
    if single:
        tokens = F.concat(cls, sentence, sep)
        return df.withColumns(
            {"tokens": tokens, "segment_ids": F.array_repeat(F.lit(0), F.size(sentence) + 2)}
        )
    pair = (
        F.concat("subject_entity", F.lit(rules.SEP), "object_entity")
        if subject_first
        else F.concat("object_entity", F.lit(f" {rules.SEP} "), "subject_entity")
    )
    first = F.concat(cls, tokens_of(pair), sep)
    second = F.concat(sentence, sep)
    segments = F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array_repeat(F.lit(1), F.size(second)))
    return df.withColumns({"tokens": F.concat(first, second), "segment_ids": segments})


def build_vocab(
    df: DataFrame, tokens: str = "tokens", size: int = 32_000, tags: Sequence[str] = ()
) -> DataFrame:
    """The ``size`` most frequent tokens with ids behind the reserved ones, ``tags`` behind those.

    Only the token counts shuffle; the top list is cut by a bounded sort before it is numbered.
    """
    counts = token_counts_table(df, tokens).where(~F.col("token").isin(*rules.RESERVED, *tags))
    top = counts.orderBy(F.col("n").desc(), "token").limit(size)
    # At most ``size`` rows are gathered and numbered here.
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "token"))).alias("t"))
    every = F.concat(
        F.array(*[F.lit(t) for t in rules.RESERVED]),
        F.col("t.token"),
        F.array(*[F.lit(t) for t in tags]).cast("array<string>"),
    )
    return listed.select(F.posexplode(every).alias("token_id", "token"))


def encode_tokens(df: DataFrame, vocab: DataFrame, vocab_size: int, tokens: str = "tokens") -> DataFrame:
    """Add ``input_ids``; a token outside the vocabulary gets the id of ``[UNK]``.

    Rows are placed by id before they are exploded: if Spark finds the vocabulary, at most
    ``vocab_size`` rows and the reserved ones, below its broadcast size, the tokens of a row are
    gathered where they are. Beyond it, adaptive execution splits the tasks of frequent tokens.
    """
    exploded = explode_once(df.repartition("id"), ["id"], F.col(tokens), "pos", "token")
    listed = vocab.limit(vocab_size + len(rules.RESERVED)) if vocab_size else vocab
    matched = exploded.join(listed, "token", "left")
    unk = F.lit(rules.RESERVED.index(rules.UNK))
    ids = (
        matched.select("id", F.struct("pos", F.coalesce("token_id", unk).alias("token_id")).alias("t"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("id", F.col("t.token_id").alias("input_ids"))
    )
    joined = df.join(ids, "id", "left")
    return joined.withColumn("input_ids", F.coalesce("input_ids", F.array().cast("array<int>")))


def pad_truncate(
    df: DataFrame, max_len: int, column: str = "tokens", pad: Column | None = None, part: str | None = None
) -> DataFrame:
    """Cut on the right at ``max_len``, pad to the longest row, add ``attention_mask``.

    Segment ids, if there, are cut and padded alike. With ``part``, a column of few values, rows are padded to
    the longest one of their part.
    """
    pad = F.lit(rules.PAD) if pad is None else pad
    size = F.max(F.least(F.size(column), F.lit(max_len))).alias("longest")
    if part is None:
        longest = df.agg(size).scalar()
    else:
        sizes = df.groupBy(part).agg(size).agg(F.map_from_entries(F.collect_list(F.struct(part, "longest"))))
        longest = sizes.scalar()[F.col(part)]
    kept = F.least(F.size(column), F.lit(max_len))
    gap = longest - kept

    def fit(values: Column, fill: Column) -> Column:
        return F.concat(F.slice(values, 1, max_len), F.array_repeat(fill, gap))

    new = {
        column: fit(F.col(column), pad),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), gap)),
    }
    if "segment_ids" in df.columns:
        new["segment_ids"] = fit(F.col("segment_ids"), F.lit(0))
    return df.withColumns(new)


def token_counts(df: DataFrame, mask: str = "attention_mask") -> DataFrame:
    """Tokens per row, from the mask."""
    return df.withColumn("n_tokens", F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))


def first_pad(df: DataFrame, column: str = "tokens", pad: Column | None = None) -> DataFrame:
    """0-based position of the first pad; NULL where a row has none."""
    at = F.array_position(column, F.lit(rules.PAD) if pad is None else pad)
    return df.withColumn("first_pad", F.when(at > 0, (at - 1).cast("int")))


def drop_tokens(df: DataFrame, budget: int = 150, seed: int = 42, column: str = "tokens") -> DataFrame:
    """Shorten rows above the budget by dropping tokens in hash order.

    The first two tokens and anything bracketed like a tag stay; a row with too few droppable
    tokens stays above the budget.
    """
    tokens = F.col(column)
    excess = F.size(tokens) - budget
    # Hash of each token that may go, NULL for the others.
    orders = F.transform(
        tokens,
        lambda x, i: F.when(
            (i >= 2) & ~x.startswith("[") & ~x.endswith("]"), hash_order(seed, F.col("id"), i)
        ),
    )

    def shorten(order: Column) -> Column:
        keys = F.sort_array(F.filter(order, lambda k: k.isNotNull()))
        last = F.get(keys, F.least(excess, F.size(keys)) - 1)
        return let(
            last,
            lambda k: F.filter(
                tokens, lambda x, i: k.isNull() | F.get(order, i).isNull() | (F.get(order, i) > k)
            ),
        )

    return df.withColumn(column, F.when(excess > 0, let(orders, shorten)).otherwise(tokens))


def mask_tokens(
    df: DataFrame,
    vocab_size: int,
    ids: str = "input_ids",
    share: float = 0.15,
    seed: int = 42,
    special: int = len(rules.RESERVED),
    tags_from: int | None = None,
) -> DataFrame:
    """Masked-token training rows: ``masked_ids`` and ``target_ids`` (-100 where nothing is asked).

    Ids below ``special`` and from ``tags_from`` on are never chosen. Of the chosen ones 80 % become the mask, 10 % a
    random id, 10 % stay. All draws are hashes of (seed, id, position).
    """
    mask_id = rules.RESERVED.index(rules.MASK)
    end = vocab_size if tags_from is None else tags_from

    drawn = df.withColumn("_draws", F.transform(ids, lambda x, i: hash_order(seed, F.col("id"), i)))

    def draw(i: Column, nth: int) -> Column:
        return F.substring(F.get(F.col("_draws"), i), 1 + 8 * nth, 8)

    def chosen(x: Column, i: Column) -> Column:
        return (x >= special) & (x < end) & (draw(i, 0) < share_digits(share))

    def masked(x: Column, i: Column) -> Column:
        other = special + F.conv(draw(i, 2), 16, 10).cast("long") % (end - special)
        return (
            F.when(~chosen(x, i), x)
            .when(draw(i, 1) < share_digits(0.8), F.lit(mask_id))
            .when(draw(i, 1) < share_digits(0.9), other.cast("int"))
            .otherwise(x)
        )

    return drawn.withColumns(
        {
            "masked_ids": F.transform(ids, masked),
            "target_ids": F.transform(ids, lambda x, i: F.when(chosen(x, i), x).otherwise(-100)),
        }
    ).drop("_draws")


def marker_positions(df: DataFrame, marker: str = "[ENT]", column: str = "tokens") -> DataFrame:
    """Positions of the two opening markers; (0, 0) if a cut removed one."""
    found = F.filter(
        F.transform(column, lambda x, i: F.when(x == marker, i)), lambda p: p.isNotNull()
    )
    both = F.size(found) == 2
    return df.withColumns(
        {
            "markers_ok": both,
            "first_marker": F.when(both, F.get(found, F.lit(0))).otherwise(0),
            "second_marker": F.when(both, F.get(found, F.lit(1))).otherwise(0),
        }
    )


def cut_at_separator(df: DataFrame, column: str = "tokens") -> DataFrame:
    """Tokens before the last separator; rows without one stay whole."""
    from_end = F.array_position(F.reverse(column), F.lit(rules.SEP)).cast("int")
    cut = F.slice(column, F.lit(1), F.size(column) - from_end)
    return df.withColumn(column, F.when(from_end > 0, cut).otherwise(F.col(column)))


def strip_special(df: DataFrame, column: str = "sentence") -> DataFrame:
    """Text without pad, class and separator tokens."""
    return df.withColumn(column, F.trim(F.regexp_replace(column, r"\[PAD\]|\[CLS\]|\[SEP\]", "")))


def rows_with_token(df: DataFrame, token: Column, column: str = "tokens") -> DataFrame:
    return df.where(F.array_contains(column, token))


def token_report(
    df: DataFrame, kinds: tuple[str, ...] = ("blank", "character"), column: str = "sentence", top: int = 10
) -> DataFrame:
    """One row per tokenizer: rows, distinct tokens, length statistics, the ten top tokens.

    One scan: each row gives its tokens under every tokenizer's name, and once its lengths. Both are
    counted in one aggregation, whose rows, one per token and one per pair of lengths, are written and
    summed up. Top tokens are limited in each task before they are ranked.
    """

    # Lengths come first, one text for each tokenizer, and tokens behind them: positions tell them apart.
    none = F.array().cast("array<string>")
    rows = df.select(F.col(column).alias("_text")).withColumns({f"_t{k}": tokens_of(F.col("_text"), kind) for k, kind in enumerate(kinds)})
    own = [F.concat_ws(",", F.length("_text").cast("string"), F.size(f"_t{k}").cast("string")) for k in range(len(kinds))]
    values = F.concat(F.array(*own), *[F.coalesce(f"_t{k}", none) for k in range(len(kinds))])
    ends, end = {}, F.lit(len(kinds))
    for k in range(len(kinds) - 1):
        end = end + F.coalesce(F.size(f"_t{k}"), F.lit(0))
        ends[f"_end{k}"] = end
    entry = explode_once(rows.withColumns({**ends, "_values": values}), list(ends), F.col("_values"), "_i", "token")
    kind_of = F.lit(len(kinds) - 1)
    for k in reversed(range(len(kinds) - 1)):
        kind_of = F.when(F.col("_i") < F.col(f"_end{k}"), k).otherwise(kind_of)
    kind_of = F.when(F.col("_i") < len(kinds), -1 - F.col("_i")).otherwise(kind_of)
    written = materialise(entry.groupBy(kind_of.alias("k"), "token").agg(F.count(F.lit(1)).alias("n")))
    own = F.col("k") < 0
    length = F.split("token", ",")
    counted = written.select(
        F.element_at(F.array(*[F.lit(x) for x in kinds]), F.when(own, -F.col("k")).otherwise(F.col("k") + 1)).alias("tokenizer"),
        F.when(~own, F.col("token")).alias("token"), "n",
        *[F.when(own, F.get(length, F.lit(i)).try_cast("int")).alias(c) for i, c in enumerate(("chars", "words"))],
    )
    own = F.col("token").isNull()
    n = F.when(own, F.col("n"))

    def stats(name: str) -> list[Column]:
        return [
            F.max(name).alias(f"{name}_max"),
            F.min(name).alias(f"{name}_min"),
            (F.sum(F.col(name) * n) / F.sum(F.when(F.col(name).isNotNull(), n))).alias(f"{name}_mean"),
            F.expr(f"percentile({name}, 0.5, n) FILTER (WHERE token IS NULL)").alias(f"{name}_median"),
        ]

    report = counted.groupBy("tokenizer").agg(
        F.sum(n).alias("rows"), *stats("chars"), *stats("words"), F.count("token").alias("distinct_tokens")
    )
    order = W.partitionBy("tokenizer").orderBy(F.col("n").desc(), "token")
    best = counted.where("token IS NOT NULL").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    listed = best.groupBy("tokenizer").agg(F.sort_array(F.collect_list(F.struct("_rank", "token"))).alias("_t"))
    joined = report.join(listed, "tokenizer", "left")
    tops = F.coalesce(F.col("_t.token"), F.array().cast("array<string>"))
    return joined.select(*[c for c in report.columns if c != "tokenizer"], "tokenizer", tops.alias("top_tokens"))
