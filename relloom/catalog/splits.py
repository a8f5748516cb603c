"""Splits, origin tables, adversarial scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from relloom.catalog.base import TEST, query, with_rel
from relloom.catalog.cleaning import BASE, EXCHANGED, PUNCT, WORD, parsed, prefix_sql, sql_map
from relloom.corpus import test_relations
from relloom.operators import split as sp
from relloom.operators.adversarial import adversarial_scores
from relloom.plans.config import Config
from relloom.plans.prepare import adversarial_split, integer_tables, integer_test_table, training_rows
from relloom.rules import FOREIGN, RESERVED, SWAP_MAP, special_tokens
from relloom.session import scratch_path

STRATIFIED = """
split_rows AS (
  SELECT id, label, sentence, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id::VARCHAR))
      <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split
  FROM rel
)"""


@query("stratified_split", with_rel("SELECT id, label, split FROM split_rows", STRATIFIED))
def stratified(spark, sf):
    return sp.stratified_split(parsed(spark, sf)).select("id", "label", "split")


@query(
    "random_split",
    with_rel(
        """SELECT id, source, CASE WHEN row_number() OVER (ORDER BY md5('42:' || id::VARCHAR))
             <= ceil(count(*) OVER () * 0.3::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM rel
           UNION ALL SELECT id, source, 'train' FROM test_rel""",
        TEST,
    ),
)
def random(spark, sf):
    out = sp.random_split(parsed(spark, sf), 0.3, extra_train=test_relations(spark, sf))
    return out.select("id", "source", "split")


@query(
    "score_split",
    with_rel(
        """SELECT id, label, prob_1, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY prob_1 DESC, id)
             <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split
           FROM (SELECT *, ((id * 7919) % 1000) / 1000.0::DOUBLE AS prob_1 FROM rel)"""
    ),
)
def by_score(spark, sf):
    rows = parsed(spark, sf).withColumn("prob_1", F.expr("((id * 7919) % 1000) / 1000.0D"))
    return sp.score_split(rows).select("id", "label", "prob_1", "split")


@query("no_split", with_rel("SELECT id, 'train' AS split FROM rel"))
def without(spark, sf):
    return sp.no_split(parsed(spark, sf)).select("id", "split")


@query(
    "origin_table",
    with_rel(
        "SELECT id, sentence, 0 AS comes_from FROM rel UNION ALL SELECT id, sentence, 1 FROM test_rel",
        TEST,
    ),
)
def origin(spark, sf):
    both = sp.origin_table(parsed(spark, sf), test_relations(spark, sf))
    return both.select("id", "sentence", "comes_from")


@query("export_split", with_rel("SELECT id, label, sentence, split FROM split_rows", STRATIFIED))
def export(spark, sf):
    """Both parts written side by side and read back."""
    path = scratch_path(spark, "split")
    sp.export_split(sp.stratified_split(parsed(spark, sf)), path)
    return spark.read.parquet(path).select("id", "label", "sentence", "split")


@query(
    "attach_scores",
    with_rel("SELECT id, label, ((id * 7919) % 1000) / 1000.0::DOUBLE AS prob_1 FROM rel"),
)
def attach(spark, sf):
    rows = parsed(spark, sf)
    scores = rows.select("id", F.expr("((id * 7919) % 1000) / 1000.0D").alias("prob_1"))
    return sp.attach_scores(rows, scores).select("id", "label", "prob_1")


@query("adversarial_scores")
def adversarial(spark, sf):
    return adversarial_scores(parsed(spark, sf), test_relations(spark, sf)).select("id", "label", "prob_1")


@query(
    "adversarial_scores_checked",
    with_rel("SELECT id, label, CAST(1 AS BIGINT) AS n, true AS in_range FROM rel"),
)
def adversarial_checked(spark, sf):
    """What holds of any fitted model: one score in [0, 1] for each train row."""
    scores = adversarial_scores(parsed(spark, sf), test_relations(spark, sf))
    return scores.groupBy("id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.every(F.col("prob_1").between(0, 1)).alias("in_range")
    )


@query(
    "adversarial_split",
    with_rel(
        """SELECT label, split, n FROM (
             SELECT label, 'valid' AS split, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS n FROM rel GROUP BY label
             UNION ALL SELECT label, 'train', CAST(count(*) - floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM rel GROUP BY label)
           WHERE n > 0"""
    ),
)
def adversarial_parts(spark, sf):
    out = adversarial_split(parsed(spark, sf), test_relations(spark, sf))
    return out.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


LOSERS = """conflicts AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sentence, subject_entity, object_entity) AS n3,
    count(*) OVER (PARTITION BY sentence, subject_entity, object_entity, label) AS n4 FROM rel) WHERE n3 > 1 AND n4 = 1
), label_rows AS (SELECT label, count(*) AS label_rows FROM rel GROUP BY label),
losers AS (
  SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sentence, subject_entity, object_entity
      ORDER BY label_rows, label, id) AS rn FROM conflicts JOIN label_rows USING (label)) WHERE rn > 1
)"""
SPLIT = """CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id::VARCHAR))
  <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split"""


@query(
    "training_rows",
    with_rel(
        f"""SELECT label, split, count(*) AS n FROM (
             SELECT id, label, {SPLIT} FROM rel WHERE id NOT IN (SELECT id FROM losers)) GROUP BY label, split""",
        LOSERS,
    ),
)
def training(spark, sf):
    """The default preparation of training rows: clean in list order, then split."""
    cfg = Config(select_DC=["remove_duplicated", "add_only_punct", "add_others_tokens", "quering_with_punct"])
    return training_rows(parsed(spark, sf), cfg).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


# The branches of a config, with full rows.
TAGGED = f"SELECT *, {BASE} AS tagged FROM rel"
SWAPPED = f"""SELECT -(id * 2 + 1) AS id, ({sql_map(SWAP_MAP)})[label] AS label, sentence, object_entity AS subject_entity, id AS origin_id
  FROM rel WHERE label IN ({", ".join(repr(x) for x in SWAP_MAP)})"""
MORE = f"""more AS (
  SELECT id, label, sentence, subject_entity, id AS origin_id FROM rel UNION ALL {SWAPPED}
  UNION ALL SELECT -(id * 2 + 2), label, sentence, subject_entity, id FROM exchanged)"""
BRANCH = ["id", "label", "sentence", "subject_entity", "origin_id", "split"]


@query(
    "training_rows_augmented",
    with_rel(f"SELECT id, label, sentence, subject_entity, origin_id, {SPLIT} FROM more", EXCHANGED, MORE),
)
def augmented(spark, sf):
    """Both augmentations, then the split: the rule."""
    cfg = Config(select_DA=["swap_sentence", "sub_obj_change_augment"])
    return training_rows(parsed(spark, sf), cfg).select(BRANCH)


@query(
    "training_rows_augment_after_split",
    with_rel(
        f"""SELECT id, label, sentence, subject_entity, id AS origin_id, split FROM parts
            UNION ALL SELECT -(id + 1), ({sql_map(SWAP_MAP)})[label], sentence, object_entity, id, 'train' FROM parts
            WHERE split = 'train' AND label IN ({", ".join(repr(x) for x in SWAP_MAP)})""",
        f"parts AS (SELECT *, {SPLIT} FROM rel)",
    ),
)
def augmented_train(spark, sf):
    """Split first; only the train part is augmented."""
    cfg = Config(select_DA=["swap_sentence"], augment_after_split=True)
    return training_rows(parsed(spark, sf), cfg).select(BRANCH)


@query(
    "training_rows_split_beforehand",
    with_rel(
        """SELECT id, label, split, sentence FROM parts WHERE split = 'valid'
           OR id NOT IN (SELECT id FROM losers WHERE id IN (SELECT id FROM parts WHERE split = 'train'))""",
        f"parts AS (SELECT id, sentence, subject_entity, object_entity, label, {SPLIT} FROM rel)",
        LOSERS.replace("FROM rel", "FROM parts WHERE split = 'train'"),
    ),
)
def split_first(spark, sf):
    """Valid rows keep what only train rows lose: conflicting labels."""
    cfg = Config(select_DC=["remove_duplicated"], valid_split_beforehand=True)
    return training_rows(parsed(spark, sf), cfg).select("id", "label", "split", "sentence")


@query("training_rows_no_valid", with_rel(f"SELECT id, label, tagged AS sentence, 'train' AS split FROM ({TAGGED})"))
def all_train(spark, sf):
    cfg = Config(select_DC=["add_entity_tokens_base"], no_valid=True)
    return training_rows(parsed(spark, sf), cfg).select("id", "label", "sentence", "split")


@query(
    "training_rows_adverse_valid",
    with_rel(
        f"""SELECT id, label, tagged AS sentence, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY prob_1 DESC, id)
              <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END AS split
            FROM (SELECT *, ((id * 7919) % 1000) / 1000.0::DOUBLE AS prob_1 FROM ({TAGGED}))"""
    ),
)
def adverse(spark, sf):
    cfg = Config(select_DC=["add_entity_tokens_base"], adverse_valid=True)
    rows = parsed(spark, sf).withColumn("prob_1", F.expr("((id * 7919) % 1000) / 1000.0D"))
    return training_rows(rows, cfg).select("id", "label", "sentence", "split")


# Integer tables.
TABLES = Config(
    token_max_len=32, vocab_size=1500,
    select_DC=["remove_duplicated", "add_only_punct", "add_others_tokens", "quering_with_punct"],
)
CHAIN = f"""{prefix_sql(f'{WORD}[subject_type]', f'{WORD}[object_type]')}
  || regexp_replace({PUNCT}, '{FOREIGN}', '[OTH]', 'g')"""


def _tokens_sql(rows: str) -> str:
    return f"""SELECT *, list_concat(list_concat(['[CLS]'], string_split(object_entity || ' [SEP] ' || subject_entity, ' ')),
      list_concat(['[SEP]'], list_concat(string_split({CHAIN}, ' '), ['[SEP]']))) AS tokens,
      len(string_split(object_entity || ' [SEP] ' || subject_entity, ' ')) + 2 AS first_len FROM {rows}"""


FITTED = f"""tokens_train AS ({_tokens_sql("(SELECT *, " + SPLIT + " FROM rel WHERE id NOT IN (SELECT id FROM losers))")}),
tokens_test AS ({_tokens_sql("test_rel")}),
vocab AS (
  SELECT row_number() OVER (ORDER BY part, less, place, token) - 1 AS token_id, token FROM (
    SELECT 1 AS part, -n AS less, 0 AS place, token FROM (
      SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tokens_train WHERE split = 'train')
      WHERE NOT list_contains({RESERVED + special_tokens()}, token)
      GROUP BY token ORDER BY n DESC, token LIMIT {TABLES.vocab_size})
    UNION ALL SELECT 0, 0, unnest(range(0, {len(RESERVED)})), unnest({RESERVED})
    UNION ALL SELECT 2, 0, unnest(range(0, {len(special_tokens())})), unnest({special_tokens()})))"""


def _integers_sql(rows: str, columns: str, part: str) -> str:
    most = TABLES.token_max_len
    return with_rel(
        f"""SELECT {columns}, array_to_string(list_concat(ids, list_transform(range(0, longest - kept), lambda i: 0)), ',') AS input_ids,
              repeat('0', CAST(least(first_len, kept) AS INT)) || repeat('1', CAST(kept - least(first_len, kept) AS INT))
                || repeat('0', CAST(longest - kept AS INT)) AS token_type_ids,
              repeat('1', CAST(kept AS INT)) || repeat('0', CAST(longest - kept AS INT)) AS attention_mask
            FROM (SELECT *, len(ids) AS kept, max(len(ids)) OVER ({part}) AS longest FROM {rows} JOIN coded USING (id))""",
        TEST, LOSERS, FITTED,
        f"""coded AS (
  SELECT id, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM (
    SELECT id, unnest(tokens[1:{most}]) AS token, unnest(range(0, len(tokens[1:{most}]))) AS pos FROM {rows})
  LEFT JOIN vocab USING (token) GROUP BY id)""",
    )


def _plain(rows, *columns):
    return rows.select(
        *columns, F.array_join("input_ids", ",").alias("input_ids"),
        *[F.array_join(c, "").alias(c) for c in ("token_type_ids", "attention_mask")],
    )


@query(
    "training_table",
    _integers_sql("tokens_train", "id, split, label_num, subject_type, object_type", "PARTITION BY split"),
)
def train_integers(spark, sf):
    """Clean, split, fit the vocabulary on the train part, encode, pad each part."""
    keep = ["id", "split", "label", "subject_type", "object_type"]
    table, _ = integer_tables(parsed(spark, sf), test_relations(spark, sf), TABLES, keep)
    return _plain(table, "id", "split", "label_num", "subject_type", "object_type")


@query("test_table", _integers_sql("tokens_test", "id", ""))
def test_integers(spark, sf):
    """The rows to predict, by the vocabulary of the train part."""
    table = integer_test_table(parsed(spark, sf), test_relations(spark, sf), TABLES)
    return _plain(table, "id")
