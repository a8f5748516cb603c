"""Token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.catalog.base import query, with_rel
from relloom.catalog.cleaning import BASE, parsed
from relloom.functions.text import share_digits
from relloom.operators import clean as cl
from relloom.operators import tokens as tk
from relloom.rules import RESERVED, special_tokens

VOCAB_SIZE = 2000
PAIR = """pair AS (SELECT id, list_concat(list_concat(list_concat(['[CLS]'],
    string_split(object_entity || ' [SEP] ' || subject_entity, ' ')), ['[SEP]']),
    list_concat(string_split(sentence, ' '), ['[SEP]'])) AS tokens,
  len(string_split(object_entity || ' [SEP] ' || subject_entity, ' ')) + 2 AS first_len FROM rel)"""
VOCAB = f"""vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 4 AS INT) AS token_id, token FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(string_split(sentence, ' ')) AS token FROM rel)
    WHERE token NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]')
    GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB_SIZE})
  UNION ALL SELECT * FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]'))
)"""
IDS = """ids AS (
  SELECT id, list(coalesce(token_id, 1) ORDER BY pos) AS input_ids FROM (
    SELECT id, unnest(string_split(sentence, ' ')) AS token,
      unnest(range(0, len(string_split(sentence, ' ')))) AS pos FROM rel)
  LEFT JOIN vocab USING (token) GROUP BY id
)"""


def text(column: str) -> F.Column:
    return F.array_join(column, " ").alias(column)


@query(
    "tokenize_blank",
    with_rel("SELECT id, len(t) AS n, t[1] AS first, t[-1] AS last FROM (SELECT id, string_split(sentence, ' ') AS t FROM rel)"),
)
def blank(spark, sf):
    return tk.tokenize(parsed(spark, sf)).select(
        "id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first"),
        F.try_element_at("tokens", F.lit(-1)).alias("last"),
    )


@query(
    "tokenize_character",
    with_rel("SELECT id, length(sentence) AS n, sentence[1] AS first, sentence[-1] AS last FROM rel"),
)
def character(spark, sf):
    return tk.tokenize(parsed(spark, sf), kind="character").select(
        "id", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first"),
        F.try_element_at("tokens", F.lit(-1)).alias("last"),
    )


@query(
    "pair_input",
    with_rel(
        """SELECT id, array_to_string(tokens, ' ') AS tokens, repeat('0', CAST(first_len AS INT))
             || repeat('1', CAST(len(tokens) - first_len AS INT)) AS segments FROM pair""",
        PAIR,
    ),
)
def pair(spark, sf):
    rows = tk.pair_input(parsed(spark, sf))
    return rows.select("id", text("tokens"), F.array_join("segment_ids", "").alias("segments"))


@query(
    "pair_input_subject_first",
    with_rel(
        """SELECT id, '[CLS] ' || subject_entity || '[SEP]' || object_entity || ' [SEP] ' || sentence || ' [SEP]' AS tokens
           FROM rel"""
    ),
)
def subject_first(spark, sf):
    return tk.pair_input(parsed(spark, sf), subject_first=True).select("id", text("tokens"))


@query("single_input", with_rel("SELECT id, '[CLS] ' || sentence || ' [SEP]' AS tokens FROM rel"))
def single(spark, sf):
    return tk.pair_input(parsed(spark, sf), single=True).select("id", text("tokens"))


@query("build_vocab", with_rel("SELECT token_id, token FROM vocab", VOCAB))
def vocab(spark, sf):
    return tk.build_vocab(tk.tokenize(parsed(spark, sf)), size=VOCAB_SIZE)


@query(
    "build_vocab_with_tags",
    with_rel(
        f"""SELECT CAST(row_number() OVER (ORDER BY part, less, place, token) - 1 AS INT) AS token_id, token FROM (
              SELECT 1 AS part, -n AS less, 0 AS place, token FROM (
                SELECT token, count(*) AS n FROM (SELECT unnest(string_split({BASE}, ' ')) AS token FROM rel)
                WHERE NOT list_contains({RESERVED + special_tokens()}, token)
                GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB_SIZE})
              UNION ALL SELECT 0, 0, unnest(range(0, {len(RESERVED)})), unnest({RESERVED})
              UNION ALL SELECT 2, 0, unnest(range(0, {len(special_tokens())})), unnest({special_tokens()}))"""
    ),
)
def tagged_vocab(spark, sf):
    rows = tk.tokenize(cl.mark_entities(parsed(spark, sf), "base"))
    return tk.build_vocab(rows, size=VOCAB_SIZE, tags=special_tokens())


def encoded(spark, sf) -> DataFrame:
    rows = tk.tokenize(parsed(spark, sf)).select("id", "tokens")
    return tk.encode_tokens(rows, tk.build_vocab(rows, size=VOCAB_SIZE), VOCAB_SIZE)


@query("encode_tokens", with_rel("SELECT id, array_to_string(input_ids, ',') AS input_ids FROM ids", VOCAB, IDS))
def encode(spark, sf):
    return encoded(spark, sf).select("id", F.array_join("input_ids", ",").alias("input_ids"))


@query(
    "rows_with_token",
    with_rel(
        "SELECT id, len(list_filter(input_ids, lambda x: x = 1)) AS n FROM ids WHERE list_contains(input_ids, 1)",
        VOCAB, IDS,
    ),
)
def unknown_rows(spark, sf):
    """Rows with a word outside the vocabulary, and how many there are."""
    rows = tk.rows_with_token(encoded(spark, sf), F.lit(1), "input_ids")
    unknown = F.size(F.filter("input_ids", lambda x: x == 1))
    return rows.select("id", unknown.cast("long").alias("n"))


PADDED = """padded AS (
  SELECT id, len(tokens) AS n, least(len(tokens), 28) AS kept, max(least(len(tokens), 28)) OVER () AS longest, tokens FROM pair
)"""


@query(
    "pad_truncate",
    with_rel(
        """SELECT id, array_to_string(list_concat(tokens[1:28], list_transform(range(0, longest - kept), lambda i: '[PAD]')), ' ') AS tokens,
             repeat('1', CAST(kept AS INT)) || repeat('0', CAST(longest - kept AS INT)) AS mask FROM padded""",
        PAIR, PADDED,
    ),
)
def padded(spark, sf):
    rows = tk.pad_truncate(tk.pair_input(parsed(spark, sf)).select("id", "tokens", "segment_ids"), 28)
    return rows.select("id", text("tokens"), F.array_join("attention_mask", "").alias("mask"))


@query(
    "token_counts",
    with_rel(
        """SELECT id, CAST(kept AS INT) AS n_tokens,
             CASE WHEN kept < longest THEN CAST(kept AS INT) ELSE -1 END AS first_pad FROM padded""",
        PAIR, PADDED,
    ),
)
def counts(spark, sf):
    rows = tk.pad_truncate(tk.pair_input(parsed(spark, sf)).select("id", "tokens"), 28)
    return tk.first_pad(tk.token_counts(rows)).select(
        "id", "n_tokens", F.coalesce("first_pad", F.lit(-1)).alias("first_pad")
    )


@query(
    "drop_tokens",
    with_rel(
        """SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM ranks
           WHERE NOT free OR rn > n - 16 GROUP BY id""",
        f"tagged AS (SELECT id, {BASE} AS tagged FROM rel)",
        """tok AS (SELECT id, unnest(string_split(tagged, ' ')) AS token,
             unnest(range(0, len(string_split(tagged, ' ')))) AS pos, len(string_split(tagged, ' ')) AS n FROM tagged)""",
        """flagged AS (SELECT *, pos >= 2 AND NOT starts_with(token, '[') AND NOT ends_with(token, ']') AS free FROM tok)""",
        """ranks AS (SELECT *, row_number() OVER (PARTITION BY id, free
             ORDER BY md5('42:' || id::VARCHAR || ':' || pos::VARCHAR)) AS rn FROM flagged)""",
    ),
)
def dropped(spark, sf):
    """Tagged sentences cut to 16 words; tags survive."""
    rows = tk.tokenize(cl.mark_entities(parsed(spark, sf), "base"))
    return tk.drop_tokens(rows, budget=16).select("id", text("tokens"))


@query(
    "mask_tokens",
    with_rel(
        f"""SELECT id, string_agg(CASE WHEN NOT chosen THEN x WHEN substr(h, 9, 8) < '{share_digits(0.8)}' THEN 4
                 WHEN substr(h, 9, 8) < '{share_digits(0.9)}'
                   THEN 5 + CAST('0x' || substr(h, 17, 8) AS BIGINT) % ({VOCAB_SIZE + 5} - 5) ELSE x END, ',' ORDER BY pos) AS masked_ids,
              string_agg(CASE WHEN chosen THEN x ELSE -100 END, ',' ORDER BY pos) AS target_ids
            FROM (SELECT *, x >= 5 AND substr(h, 1, 8) < '{share_digits(0.15)}' AS chosen FROM draws) GROUP BY id""",
        VOCAB, IDS,
        """draws AS (SELECT *, md5('42:' || id::VARCHAR || ':' || pos::VARCHAR) AS h FROM (
             SELECT id, unnest(input_ids) AS x, unnest(range(0, len(input_ids))) AS pos FROM ids))""",
    ),
)
def masked(spark, sf):
    rows = tk.mask_tokens(encoded(spark, sf), VOCAB_SIZE + 5)
    return rows.select(
        "id", F.array_join("masked_ids", ",").alias("masked_ids"), F.array_join("target_ids", ",").alias("target_ids")
    )


MARKED = f"""cut AS (SELECT id, string_split({BASE}, ' ')[1:20] AS t FROM rel),
found AS (SELECT id, list_filter(range(0, len(t)), lambda i: t[i + 1] = '[ENT]') AS p FROM cut)"""


@query(
    "marker_positions",
    with_rel(
        """SELECT id, len(p) = 2 AS markers_ok, CAST(CASE WHEN len(p) = 2 THEN p[1] ELSE 0 END AS INT) AS first_marker,
             CAST(CASE WHEN len(p) = 2 THEN p[2] ELSE 0 END AS INT) AS second_marker FROM found""",
        MARKED,
    ),
)
def markers(spark, sf):
    rows = tk.tokenize(cl.mark_entities(parsed(spark, sf), "base"))
    rows = rows.withColumn("tokens", F.slice("tokens", 1, 20))
    return tk.marker_positions(rows).select("id", "markers_ok", "first_marker", "second_marker")


@query(
    "cut_at_separator",
    with_rel("SELECT id, array_to_string(tokens[1:len(tokens) - 1], ' ') AS tokens FROM pair", PAIR),
)
def cut(spark, sf):
    return tk.cut_at_separator(tk.pair_input(parsed(spark, sf))).select("id", text("tokens"))


@query(
    "strip_special",
    with_rel(
        r"SELECT id, trim(regexp_replace(array_to_string(tokens, ' '), '\[PAD\]|\[CLS\]|\[SEP\]', '', 'g')) AS sentence FROM pair",
        PAIR,
    ),
)
def stripped(spark, sf):
    rows = tk.pair_input(parsed(spark, sf)).withColumn("sentence", F.array_join("tokens", " "))
    return tk.strip_special(rows).select("id", "sentence")


def _report_sql(kind: str, tokens: str) -> str:
    return f"""SELECT '{kind}' AS tokenizer, count(*) AS rows, max(c) AS chars_max, min(c) AS chars_min,
        round(avg(c), 9) AS chars_mean, median(c) AS chars_median, max(len(t)) AS words_max, min(len(t)) AS words_min,
        round(avg(len(t)), 9) AS words_mean, median(len(t)) AS words_median,
        (SELECT count(DISTINCT x) FROM (SELECT unnest({tokens}) AS x FROM rel)) AS distinct_tokens,
        (SELECT string_agg(x, '|' ORDER BY n DESC, x) FROM (SELECT x, count(*) AS n FROM (
           SELECT unnest({tokens}) AS x FROM rel) GROUP BY x ORDER BY n DESC, x LIMIT 10)) AS top_tokens
      FROM (SELECT length(sentence) AS c, {tokens} AS t FROM rel)"""


@query(
    "token_report",
    with_rel(
        _report_sql("blank", "string_split(sentence, ' ')")
        + " UNION ALL "
        + _report_sql("character", "string_split(sentence, '')")
    ),
)
def report(spark, sf):
    rows = tk.token_report(parsed(spark, sf))
    return rows.withColumns(
        {
            "chars_mean": F.round("chars_mean", 9),
            "words_mean": F.round("words_mean", 9),
            "top_tokens": F.array_join("top_tokens", "|"),
        }
    )
