"""Mixing sources to target weights: random keys, range sort, distributed prefix sums, exact cuts.

Every document gets the key md5('seed:doc_id'). Rows are range partitioned and sorted by (source,
key); a prefix sum of the sizes inside each part, with the sums of the parts before it, gives every
document its place in the source's word stream. The stream is taken ``budget div source size`` times
whole, and once more up to the exact word where the budget ends, so a source's taken words equal its
rounded target. No task needs a whole source and the texts are never shuffled.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by
weight; a target stops at ``MAX_REPEAT`` times its source's size, and the excess is shared again by
weight until none is above. With the sources sorted by cap over weight, the stopped ones are the
first ones whose cap is no more than their share of what the earlier ones left, so one running
total over the sources finds them all.

``taken_rows`` gives whole rows instead. A source's stream is cut at one place (key, size): rows before it are
taken once more, rows behind it are not, so only one row per source is joined to the documents, and
neither a copy nor a shuffle of the texts is needed. Rows that share the place of the cut are numbered.

Null texts have size 0 and are taken 0 words; a source without words has target 0. Null sources are
one source, null ids one key. Repeated rows count each. An empty table gives no rows. Other columns
are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.functions.text import hash_order
from relloom.llm.graph import fresh, keyed
from relloom.operators.ranking import ranked, running_totals
from relloom.session import materialise

SEED = 7
WEIGHTS = 3
MAX_REPEAT = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    weighed = ranked(sources, [], order).select(
        "source", "source_size",
        (F.pmod(F.col("rn") - 1, F.lit(WEIGHTS)) + 1).alias("w"),
        (F.col("source_size") * MAX_REPEAT).alias("cap"),
    )
    by_ratio = [F.col("cap") / F.col("w"), *order]
    placed = materialise(
        running_totals(weighed, [], by_ratio, {"caps": F.col("cap"), "ws": F.col("w"), "all": F.col("source_size")})
    )
    # What is left for this source and the later ones, against this source's cap.
    left = F.col("all_total") - (F.col("caps") - F.col("cap"))
    rest = F.col("ws_total") - (F.col("ws") - F.col("w"))
    placed = placed.withColumn("stopped", left * F.col("w") >= F.col("cap") * rest)
    free = placed.agg(
        (F.max("all_total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))), F.lit(0))).alias("words"),
        F.sum(F.when(~F.col("stopped"), F.col("w"))).alias("weights"),
    ).first()
    share = (free.words or 0) / (free.weights or 1)
    return materialise(
        placed.select(
            "source", "source_size",
            F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.lit(share) * F.col("w")).alias("target"),
        )
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Written table (doc_id, source, size)."""
    return materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    )


def _budgets(sized: DataFrame) -> DataFrame:
    """(_source, source_size, target, epochs, rest): how often a source is taken whole, and the words left then."""
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    return (
        targets(sized)
        .withColumn("budget", budget)
        .withColumn("epochs", whole)
        .select(
            F.col("source").alias("_source"), "source_size", "target", "epochs",
            (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"),
        )
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document.

    ``copies``: how often the whole document is taken; ``taken``: words taken, those of a last
    partial copy included.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    placed = running_totals(
        sized.withColumn("key", hash_order(seed, F.col("doc_id"))), ["source"], [F.col(c) for c in ("key", "doc_id", "size")],
        {"upto": F.col("size")},
    )
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - (F.col("upto") - F.col("size"))))
    return (
        placed.join(_budgets(sized), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("part", part)
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("long")).alias("copies"),
            (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def _cuts(sized: DataFrame, seed: int) -> DataFrame:
    """Written table (_source, source_size, target, epochs, rest, cut_key, cut_size, before), one row per source.

    The rest ends in the documents of key ``cut_key`` and size ``cut_size``, before which ``before`` words stand.
    """
    budgets = _budgets(sized)
    places = sized.groupBy("source", hash_order(seed, F.col("doc_id")).alias("key"), "size").agg(F.count("*").alias("n"))
    placed = running_totals(places, ["source"], [F.col("key"), F.col("size")], {"upto": F.col("size") * F.col("n")})
    before = F.col("upto") - F.col("size") * F.col("n")
    cut = placed.join(
        budgets.select(F.col("_source").alias("_s"), F.col("rest").alias("_rest")), F.col("source").eqNullSafe(F.col("_s"))
    ).where((before < F.col("_rest")) & (F.col("upto") >= F.col("_rest")))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), before.alias("before"))
    return materialise(budgets.join(cut, F.col("_source").eqNullSafe(F.col("source")), "left").drop("source"))


def taken_rows(
    docs: DataFrame, names: dict[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The rows that the mix takes, with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` under ``names``.

    Rows are told apart by their places, so ids may repeat or be null; rows with one place are taken in the order
    in which they are read.
    """
    cuts = _cuts(_sized(docs, id_col, text_col, source_col), seed)
    mixed = fresh(docs, "mix")
    ends = cuts.select(F.struct(*[c for c in cuts.columns]).alias(mixed))
    rows = docs.join(ends, F.col(source_col).eqNullSafe(F.col(f"{mixed}._source")))
    key, size = hash_order(seed, F.col(id_col)), word_count(F.col(text_col))
    of = {c: F.col(f"{mixed}.{c}") for c in cuts.columns}
    on_cut_key = F.coalesce(key == of["cut_key"], F.lit(False))
    tied = on_cut_key & (size == of["cut_size"])
    whole = F.coalesce(key < of["cut_key"], F.lit(False)) | (on_cut_key & (size < of["cut_size"]))

    def given(found: DataFrame, size: Column, copies: Column, taken: Column) -> DataFrame:
        values = {"size": size, "source_size": of["source_size"], "target": of["target"], "copies": copies, "taken": taken}
        return found.select(*docs.columns, *[values[c].alias(n) for c, n in names.items()])

    # A text without words is never taken; looking for the first word is cheaper than counting them.
    word = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    copies = of["epochs"] + whole.cast("long")
    clear = given(rows.where(((of["epochs"] > 0) | whole) & word & ~tied), size, copies, copies * size)

    ties, row = keyed(rows.where(tied))
    number, at = fresh(ties, "number"), fresh(ties, "at")
    order = ranked(ties.select(of["_source"].alias("source"), F.col(row).alias("row")), ["source"], [F.col("row")])
    order = materialise(order.select(F.col("row").alias(at), F.col("rn").alias(number)))
    ties = ties.join(order, ties[row] == order[at])
    size = of["cut_size"]
    part = F.least(size, F.greatest(F.lit(0), of["rest"] - of["before"] - (F.col(number) - 1) * size))
    taken = of["epochs"] * size + part
    cut = given(ties.where(taken > 0), size, of["epochs"] + (part == size).cast("long"), taken)
    return clear.unionByName(cut)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
placed AS (
  SELECT *, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS ws,
         sum(source_size) OVER () AS all_words, sum(w) OVER () AS all_w
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT *, (all_words - caps) * w >= cap * (all_w - ws) AS stopped FROM placed),
free AS (
  SELECT CAST(max(all_words) - coalesce(sum(cap) FILTER (stopped), 0) AS DOUBLE)
         / coalesce(sum(w) FILTER (NOT stopped), 1) AS share FROM judged),
wanted AS (
  SELECT source, source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE share * w END AS target FROM judged, free),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id
                            ROWS UNBOUNDED PRECEDING) - size AS before FROM sized),
cut AS (
  SELECT o.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget
  FROM ordered o JOIN wanted w ON o.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
       + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken
FROM cut
"""
