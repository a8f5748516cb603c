"""Corpus profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from relloom import rules
from relloom.catalog.base import TEST, query, with_rel
from relloom.catalog.cleaning import asian, parsed, with_asian
from relloom.corpus import test_relations
from relloom.operators import profile as pr
from relloom.operators.tokens import tokenize

PAIR = "subject_type || '_' || object_type"


@query(
    "profile",
    with_rel(
        """SELECT count(*) AS rows, count(*) FILTER (sentence IS NULL) AS sentence_nulls,
             count(*) FILTER (label IS NULL) AS label_nulls, count(DISTINCT object_entity) AS object_entity_distinct,
             count(DISTINCT label) AS label_distinct, count(DISTINCT sub_obj_type) AS sub_obj_type_distinct
           FROM (SELECT *, subject_type || '_' || object_type AS sub_obj_type FROM rel)"""
    ),
)
def profile(spark, sf):
    out = pr.profile(pr.type_pair(parsed(spark, sf)), distinct=("object_entity", "label", "sub_obj_type"))
    return out.select(
        "rows", "sentence_nulls", "label_nulls", "object_entity_distinct", "label_distinct",
        "sub_obj_type_distinct",
    )


for _key in ("label", "source", "subject_type", "object_type"):

    @query(f"value_counts_{_key}", with_rel(f"SELECT {_key}, count(*) AS n FROM rel GROUP BY 1 ORDER BY n DESC, 1"))
    def _counts(spark, sf, key=_key):
        return pr.value_counts(parsed(spark, sf), key)


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "value_shares",
    with_rel(
        """SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rel), 9) AS share
           FROM rel GROUP BY label"""
    ),
)
def shares(spark, sf):
    return rounded(pr.value_shares(parsed(spark, sf), "label"), "share")


@query(
    "train_test_shares",
    with_rel(
        """SELECT split, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM (
             SELECT 'train' AS split FROM rel UNION ALL SELECT 'test' FROM test_rel) GROUP BY split""",
        TEST,
    ),
)
def train_test(spark, sf):
    both = pr.with_split(parsed(spark, sf), test_relations(spark, sf))
    return rounded(pr.value_shares(both, "split"), "share")


@query(
    "bucket_share",
    with_rel(
        """SELECT n_hit, rows - n_hit AS n_rest, round(n_hit * 100.0::DOUBLE / rows, 9) AS share_hit,
             round((rows - n_hit) * 100.0::DOUBLE / rows, 9) AS share_rest
           FROM (SELECT count(*) AS rows, count(*) FILTER (contains(label, 'per')) AS n_hit FROM rel)"""
    ),
)
def buckets(spark, sf):
    return rounded(pr.bucket_share(parsed(spark, sf)), "share_hit", "share_rest")


def _coverage_sql(by: str, values: str) -> str:
    return with_rel(
        f"""SELECT {by}, array_to_string(list_sort(list({values})), ',') AS values, count(*) AS n_values,
              round(count(*) * 100.0::DOUBLE / (SELECT count(DISTINCT {values}) FROM pairs), 9) AS coverage
            FROM pairs GROUP BY {by}""",
        f"pairs AS (SELECT DISTINCT label, {PAIR} AS sub_obj_type FROM rel)",
    )


@query("pairs_by_label", _coverage_sql("label", "sub_obj_type"))
def by_label(spark, sf):
    out = rounded(pr.pairs_by_label(parsed(spark, sf)), "coverage")
    return out.withColumn("values", F.array_join("values", ","))


@query("labels_by_pair", _coverage_sql("sub_obj_type", "label"))
def by_pair(spark, sf):
    out = rounded(pr.labels_by_pair(parsed(spark, sf)), "coverage")
    return out.withColumn("values", F.array_join("values", ","))


for _name, _keys in (
    ("label_source", ("label", "source")),
    ("label_subject_type", ("label", "subject_type")),
    ("label_object_type", ("label", "object_type")),
    ("label_type_pair", ("label", "sub_obj_type")),
):

    @query(
        f"crosstab_{_name}",
        with_rel(
            f"""SELECT {', '.join(_keys)}, count(*) AS n
                FROM (SELECT *, {PAIR} AS sub_obj_type FROM rel) GROUP BY ALL"""
        ),
    )
    def _crosstab(spark, sf, keys=_keys):
        return pr.crosstab(pr.type_pair(parsed(spark, sf)), *keys)


TYPES = ["PER", "ORG", "LOC", "DAT", "POH", "NOH"]


@query(
    "crosstab_wide",
    with_rel(
        "SELECT label, "
        + ", ".join(f"count(*) FILTER (object_type = '{t}') AS {t}" for t in TYPES)
        + " FROM rel GROUP BY label"
    ),
)
def wide(spark, sf):
    return pr.crosstab_wide(parsed(spark, sf), "label", "object_type", TYPES)


@query(
    "crosstab_three_way",
    with_rel(
        """SELECT split, source, object_type, count(*) AS n FROM (
             SELECT 'train' AS split, source, object_type FROM rel
             UNION ALL SELECT 'test', source, object_type FROM test_rel) GROUP BY ALL""",
        TEST,
    ),
)
def three_way(spark, sf):
    both = pr.with_split(parsed(spark, sf), test_relations(spark, sf))
    return pr.crosstab(both, "split", "source", "object_type")


@query(
    "pair_counts",
    with_rel(
        """SELECT label, label_rows, subject_entity, object_entity, count(*) AS n
           FROM rel JOIN (SELECT label, count(*) AS label_rows FROM rel GROUP BY label) USING (label)
           WHERE label_rows < 500 GROUP BY ALL"""
    ),
)
def pairs(spark, sf):
    return pr.pair_counts(parsed(spark, sf), 500)


@query(
    "length_stats",
    with_rel(
        """SELECT count(*) AS rows, max(c) AS chars_max, min(c) AS chars_min, round(avg(c), 9) AS chars_mean,
             median(c) AS chars_median, max(w) AS words_max, min(w) AS words_min, round(avg(w), 9) AS words_mean,
             median(w) AS words_median
           FROM (SELECT length(sentence) AS c, len(string_split(sentence, ' ')) AS w FROM rel)"""
    ),
)
def lengths(spark, sf):
    out = pr.length_stats(
        parsed(spark, sf), chars=F.length("sentence"), words=F.size(F.split("sentence", " "))
    )
    return rounded(out, "chars_mean", "words_mean")


def _histogram_sql(value: str, bins: int) -> str:
    return with_rel(
        f"""SELECT CAST(bin AS INT) AS bin, round(lo + (hi - lo) / {bins} * bin, 9) AS lower,
              round(lo + (hi - lo) / {bins} * (bin + 1), 9) AS upper, count(v) AS n
            FROM (SELECT unnest(range(0, {bins})) AS bin) CROSS JOIN edges
            LEFT JOIN vals ON least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1}) = bin
            GROUP BY bin, lo, hi""",
        f"vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM rel)",
        "edges AS (SELECT min(v) AS lo, max(v) AS hi FROM vals)",
    )


for _name, _sql, _bins in (
    ("sentence_chars", "length(sentence)", 10),
    ("subject_chars", "length(subject_entity)", 10),
    ("object_chars", "length(object_entity)", 15),
    ("sentence_words", "len(string_split(sentence, ' '))", 20),
):

    @query(f"histogram_{_name}", _histogram_sql(_sql, _bins))
    def _histogram(spark, sf, name=_name, bins=_bins):
        column, unit = name.split("_")
        column = column if column == "sentence" else f"{column}_entity"
        value = F.length(column) if unit == "chars" else F.size(F.split(column, " "))
        return rounded(pr.histogram(parsed(spark, sf), value, bins), "lower", "upper")


TOKENS = "tok AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(sentence, ' ')) AS token FROM rel) GROUP BY token)"


@query("top_tokens", with_rel("SELECT token, n FROM tok ORDER BY n DESC, token LIMIT 10", TOKENS))
def top(spark, sf):
    return pr.top_tokens(tokenize(parsed(spark, sf)), 10)


@query("bottom_tokens", with_rel("SELECT token, n FROM tok ORDER BY n, token LIMIT 30", TOKENS))
def bottom(spark, sf):
    return pr.bottom_tokens(tokenize(parsed(spark, sf)), 30)


@query(
    "rank_frequency",
    with_rel(
        """SELECT row_number() OVER (ORDER BY n DESC, token) - 1 AS rank, token, n, round(log10(n), 9) AS log_n FROM tok""",
        TOKENS,
    ),
)
def rank_curve(spark, sf):
    return rounded(pr.rank_frequency(tokenize(parsed(spark, sf))), "log_n")


@query(
    "match_counts",
    with_rel(
        """SELECT match, count(*) AS n FROM (SELECT regexp_extract(sentence, '[0-9]+') AS match FROM rel)
           WHERE match <> '' GROUP BY match"""
    ),
)
def matches(spark, sf):
    return pr.match_counts(parsed(spark, sf), rules.CHAR_CLASSES["digits"])


@query("rows_matching", with_rel(f"SELECT id, {asian('sentence')} AS sentence FROM rel WHERE regexp_matches({asian('sentence')}, '{rules.FOREIGN}')"))
def matching(spark, sf):
    return pr.rows_matching(with_asian(spark, sf), rules.FOREIGN).select("id", "sentence")


@query(
    "char_class_flags",
    with_rel(
        "SELECT id, "
        + ", ".join(
            # RE2 allows at most 1000 repeats; for presence two are enough.
            f"regexp_matches({asian('sentence')}, '{p.replace('{2,9999}', '{2}')}') AS has_{name}"
            for name, p in rules.CHAR_CLASSES.items()
        )
        + " FROM rel"
    ),
)
def flags(spark, sf):
    return pr.char_class_flags(with_asian(spark, sf)).select(
        "id", *[f"has_{name}" for name in rules.CHAR_CLASSES]
    )


@query(
    "char_class_counts",
    with_rel(
        "SELECT "
        + ", ".join(
            f"count(*) FILTER (regexp_matches({asian('sentence')}, '{p.replace('{2,9999}', '{2}')}')) AS {name}"
            for name, p in rules.CHAR_CLASSES.items()
        )
        + " FROM rel"
    ),
)
def class_counts(spark, sf):
    flagged = pr.char_class_flags(with_asian(spark, sf))
    return flagged.agg(*[F.count_if(f"has_{name}").alias(name) for name in rules.CHAR_CLASSES])




@query(
    "medians",
    with_rel(
        """SELECT 'score' AS name, median(sqrt(id + 0.5::DOUBLE)) AS median FROM rel
           UNION ALL SELECT 'label_score', median(sqrt(id + 0.5::DOUBLE)) FILTER (label = 'no_relation') FROM rel
           UNION ALL SELECT 'chars', median(length(sentence)) FROM rel"""
    ),
)
def middle(spark, sf):
    """A value of its own for every row, for some rows only, and a repeating one."""
    score = F.sqrt(F.col("id") + 0.5)
    return pr.medians(
        parsed(spark, sf), score=score, label_score=F.when(F.col("label") == "no_relation", score), chars=F.length("sentence")
    )
