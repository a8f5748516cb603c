"""Parsing, cleaning steps, augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom import rules
from relloom.catalog.base import query, with_rel
from relloom.corpus import raw, relations
from relloom.functions.arrays import explode_once
from relloom.operators import augment as aug
from relloom.operators import clean as cl
from relloom.operators.dedup import dedup
from relloom.operators.parse import encode_labels, parse_entities
from relloom.operators.profile import value_counts
from relloom.session import scratch_path
from relloom.sources.relations import SCHEMAS
from relloom.streaming.clean_stream import clean_stream, stream_relations, write_stream

PARSED_COLS = (
    "id, sentence, source, label, subject_entity, subject_start_idx, subject_end_idx, subject_type,"
    " object_entity, object_start_idx, object_end_idx, object_type"
)


def parsed(spark, sf) -> DataFrame:
    return relations(spark, sf).drop("label_num")


def sql_map(pairs: dict) -> str:
    body = ", ".join(f"'{k}': '{v}'" for k, v in pairs.items())
    return f"MAP {{{body}}}"


def tagged_sql(s_open: str, s_close: str, o_open: str, o_close: str) -> str:
    """Sentence with tags, as the closed form over the sorted spans."""
    return f"""CASE WHEN greatest(subject_start_idx, object_start_idx) > least(subject_end_idx, object_end_idx) THEN
      CASE WHEN object_end_idx > subject_end_idx THEN
        sentence[:subject_start_idx] || {s_open} || subject_entity || {s_close}
        || sentence[subject_end_idx + 2:object_start_idx] || {o_open} || object_entity || {o_close}
        || sentence[object_end_idx + 2:]
      ELSE
        sentence[:object_start_idx] || {o_open} || object_entity || {o_close}
        || sentence[object_end_idx + 2:subject_start_idx] || {s_open} || subject_entity || {s_close}
        || sentence[subject_end_idx + 2:]
      END ELSE sentence END"""


WORD = f"({sql_map(rules.TYPE_WORDS)})"
BASE = tagged_sql("'[ENT] '", "' [/ENT] '", "'[ENT] '", "' [/ENT] '")
TYPED = tagged_sql(
    "'[S:' || subject_type || '] '", "' [/S:' || subject_type || '] '",
    "'[O:' || object_type || '] '", "' [/O:' || object_type || '] '",
)
PUNCT = tagged_sql(
    f"' @ * ' || {WORD}[subject_type] || ' * '", "' @ '",
    f"' # ^ ' || {WORD}[object_type] || ' ^ '", "' # '",
)
# First row per exact key, as raw rows are compared: entity literals hold offsets and types.
DEDUP_RAW = """
raw_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY sentence, subject_entity, subject_start_idx, subject_type, object_entity,
                   object_start_idx, object_type, source, label ORDER BY id) AS rn FROM rel)
  WHERE rn = 1
)"""


@query(
    "flagship",
    with_rel(
        f"""SELECT label, count(*) AS n, CAST(sum(length({TYPED})) AS BIGINT) AS chars
        FROM raw_first GROUP BY label""",
        DEDUP_RAW,
    ),
)
def flagship(spark, sf):
    """Raw rows -> exact dedup -> parse -> typed tags -> rows and characters per label."""
    rows = parse_entities(dedup(raw(relations(spark, sf))))
    return cl.mark_entities(rows, "typed").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars")
    )


@query("parse_entities", with_rel(f"SELECT {PARSED_COLS} FROM rel"))
def parse(spark, sf):
    return parse_entities(raw(relations(spark, sf)))


@query(
    "parse_entities_partial",
    with_rel("""SELECT id, subject_type, subject_entity AS subject_word, object_type,
                object_entity AS object_word FROM rel"""),
)
def parse_partial(spark, sf):
    rows = parse_entities(raw(relations(spark, sf)), partial=True)
    return rows.select("id", "subject_type", "subject_word", "object_type", "object_word")


@query("encode_labels", with_rel("SELECT id, label, label_num FROM rel"))
def encode(spark, sf):
    return encode_labels(parsed(spark, sf)).select("id", "label", "label_num")


def _rule_cases(kind: int) -> str:
    if kind == 0:
        cases = [
            f"WHEN '{label}' THEN CASE WHEN object_type IN ({', '.join(repr(t) for t in types)})"
            f" THEN object_type ELSE '{into}' END"
            for label, (types, into) in rules.OBJECT_TYPE_RULES.items()
        ]
        return f"CASE label {' '.join(cases)} ELSE object_type END"
    return """CASE WHEN label LIKE 'per%' THEN 'PER' WHEN label LIKE 'org%' THEN 'ORG' ELSE subject_type END"""


@query(
    "normalize_types",
    with_rel(f"SELECT id, label, {_rule_cases(1)} AS subject_type, {_rule_cases(0)} AS object_type FROM rel"),
)
def normalize(spark, sf):
    return cl.normalize_types(parsed(spark, sf)).select("id", "label", "subject_type", "object_type")


@query("mark_entities_base", with_rel(f"SELECT id, {BASE} AS sentence, true AS span_ok FROM rel"))
def mark_base(spark, sf):
    return cl.mark_entities(parsed(spark, sf), "base").select("id", "sentence", "span_ok")


@query("mark_entities_typed", with_rel(f"SELECT id, {TYPED} AS sentence, true AS span_ok FROM rel"))
def mark_typed(spark, sf):
    return cl.mark_entities(parsed(spark, sf), "typed").select("id", "sentence", "span_ok")


@query("mark_entities_punct", with_rel(f"SELECT id, {PUNCT} AS sentence, true AS span_ok FROM rel"))
def mark_punct(spark, sf):
    return cl.mark_entities(parsed(spark, sf), "punct").select("id", "sentence", "span_ok")


def prefix_sql(subject: str, obj: str) -> str:
    return (
        f"'@ * ' || {subject} || ' * ' || subject_entity || ' @와 # ^ ' || {obj} || ' ^ '"
        " || object_entity || ' #의 관계 [SEP] '"
    )


@query(
    "query_prefix",
    with_rel(
        f"SELECT id, {prefix_sql(f'{WORD}[subject_type]', f'{WORD}[object_type]')} || {PUNCT} AS sentence FROM rel"
    ),
)
def prefix(spark, sf):
    return cl.query_prefix(cl.mark_entities(parsed(spark, sf), "punct")).select("id", "sentence")


@query(
    "query_prefix_typed",
    with_rel(f"SELECT id, {prefix_sql('subject_type', 'object_type')} || sentence AS sentence FROM rel"),
)
def prefix_typed(spark, sf):
    return cl.query_prefix(parsed(spark, sf), typed=True).select("id", "sentence")


# The texts hold no Asian scripts; accented letters are mapped to kana, Han and Korean signs.
LATIN, ASIAN = "éèêçöäüßóíúñ", "日本語漢みナ々ーㅋ々ア字"


def with_asian(spark, sf) -> DataFrame:
    rows = parsed(spark, sf)
    return rows.withColumns(
        {c: F.translate(c, LATIN, ASIAN) for c in ("sentence", "subject_entity", "object_entity")}
    )


def asian(column: str) -> str:
    return f"translate({column}, '{LATIN}', '{ASIAN}')"


@query(
    "replace_foreign",
    with_rel(f"SELECT id, regexp_replace({asian('sentence')}, '{rules.FOREIGN}', '[OTH]', 'g') AS sentence FROM rel"),
)
def foreign(spark, sf):
    return cl.replace_foreign(with_asian(spark, sf)).select("id", "sentence")


@query(
    "flag_kana",
    with_rel(
        "SELECT id, "
        + ", ".join(
            f"regexp_matches({asian(c)}, '{rules.KANA_SIGN}') AS {c}_kana"
            for c in ("sentence", "subject_entity", "object_entity")
        )
        + " FROM rel"
    ),
)
def kana(spark, sf):
    flags = [f"{c}_kana" for c in ("sentence", "subject_entity", "object_entity")]
    return cl.flag_kana(with_asian(spark, sf)).select("id", *flags)


@query(
    "remove_stop_words",
    with_rel(
        """SELECT id, coalesce(array_to_string(list_filter(string_split(sentence, ' '),
             lambda x: x <> '' AND NOT list_contains(ws, x)), ' '), '') AS sentence
           FROM rel, (SELECT list(word) AS ws FROM stop)""",
        """stop AS (SELECT word FROM (SELECT unnest(string_split(sentence, ' ')) AS word FROM rel)
             WHERE word <> '' GROUP BY word ORDER BY count(*) DESC, word LIMIT 50)""",
    ),
)
def stop_words(spark, sf):
    """The 50 most frequent words of the corpus serve as the stop list."""
    rows = parsed(spark, sf)
    words = explode_once(rows, [], F.split("sentence", " "), "pos", "word").where("word <> ''")
    stop = value_counts(words, "word").limit(50).select("word")
    return cl.remove_stop_words(rows, stop).select("id", "sentence")


@query("strip_blanks", with_rel("SELECT id, replace(sentence, ' ', '') AS sentence FROM rel"))
def strip(spark, sf):
    return cl.strip_blanks(parsed(spark, sf)).select("id", "sentence")


@query(
    "mask_entities_base",
    with_rel(
        """SELECT id, '[SUB]' AS subject_entity, '[OBJ]' AS object_entity,
             replace(replace(tagged, found[1], one), found[2], two) AS sentence
           FROM masked""",
        f"tagged AS (SELECT id, subject_start_idx < object_start_idx AS s_first, {BASE} AS tagged FROM rel)",
        r"""masked AS (SELECT *, regexp_extract_all(tagged, '\[ENT\].+?\[/ENT\]') AS found,
             CASE WHEN s_first THEN '[SUB]' ELSE '[OBJ]' END AS one,
             CASE WHEN s_first THEN '[OBJ]' ELSE '[SUB]' END AS two FROM tagged)""",
    ),
)
def mask_base(spark, sf):
    rows = cl.clean(parsed(spark, sf), ["add_entity_tokens_base", "entity_mask_base"])
    return rows.select("id", "subject_entity", "object_entity", "sentence")


@query(
    "mask_entities_typed",
    with_rel(
        r"""SELECT id, '[S:' || subject_type || ']' AS subject_entity, '[O:' || object_type || ']' AS object_entity,
             regexp_replace(regexp_replace(tagged, '(\[S:.+?\]).+?\[/S:.+?\]', '\1', 'g'),
                            '(\[O:.+?\]).+?\[/O:.+?\]', '\1', 'g') AS sentence
           FROM tagged""",
        f"tagged AS (SELECT id, subject_type, object_type, {TYPED} AS tagged FROM rel)",
    ),
)
def mask_typed(spark, sf):
    rows = cl.clean(parsed(spark, sf), ["add_entity_tokens_detail", "entity_mask_detail"])
    return rows.select("id", "subject_entity", "object_entity", "sentence")


# Entities of the corpus are single words, so names are too: a word-by-word SQL suffices.
@query(
    "mask_other_persons",
    with_rel(
        """SELECT r.id, array_to_string(list_transform(m.words, lambda w:
               CASE WHEN w.keep THEN w.word ELSE '[PER]' END), ' ') AS sentence
           FROM rel r JOIN merged m USING (id)""",
        """names AS (SELECT subject_entity AS name FROM rel WHERE subject_type = 'PER'
             UNION SELECT object_entity FROM rel WHERE object_type = 'PER')""",
        f"tagged AS (SELECT id, subject_entity, object_entity, {BASE} AS tagged FROM rel)",
        r"""pieces AS (SELECT id, subject_entity, object_entity, p.i AS i, p.piece AS piece FROM (
             SELECT *, unnest(list_transform(regexp_split_to_array(tagged, ' ?\[ENT\] ?| ?\[/ENT\] ?'),
               lambda x, i: {'i': i, 'piece': x})) AS p FROM tagged))""",
        """words AS (SELECT id, i, w.j AS j, w.word AS word, piece = subject_entity OR piece = object_entity AS whole
             FROM (SELECT *, unnest(list_transform(string_split(piece, ' '),
               lambda x, j: {'j': j, 'word': x})) AS w FROM pieces))""",
        """merged AS (SELECT id, list({'word': word, 'keep': whole OR name IS NULL} ORDER BY i, j) AS words
             FROM words LEFT JOIN names ON word = name AND word <> '' GROUP BY id)""",
    ),
)
def other_persons(spark, sf):
    rows = parsed(spark, sf)
    return cl.mask_other_persons(cl.mark_entities(rows, "base"), cl.person_names(rows)).select("id", "sentence")


@query(
    "clean_chain",
    with_rel(
        f"""SELECT id, sentence AS plain, {prefix_sql(f'{WORD}[subject_type]', f'{WORD}[object_type]')} ||
              regexp_replace({PUNCT}, '{rules.FOREIGN}', '[OTH]', 'g') AS sentence FROM rel"""
    ),
)
def chain(spark, sf):
    """The default step list over rows to predict: steps for training rows only are left out."""
    rows = parsed(spark, sf).withColumn("plain", F.col("sentence"))
    steps = ["remove_duplicated", "add_only_punct", "add_others_tokens", "quering_with_punct"]
    return cl.clean(rows, steps).select("id", "plain", "sentence")


STREAMED = ["add_only_punct", "add_others_tokens", "quering_with_punct"]


@query(
    "clean_stream",
    with_rel(
        f"""SELECT id, label, {prefix_sql(f'{WORD}[subject_type]', f'{WORD}[object_type]')} ||
              regexp_replace({PUNCT}, '{rules.FOREIGN}', '[OTH]', 'g') AS sentence FROM rel"""
    ),
)
def stream(spark, sf):
    """Files put into a folder, cleaned a few at a time by a checkpointed stream, and read back."""
    base = scratch_path(spark, "stream")
    columns = [field.split()[0] for field in SCHEMAS["parsed"].split(", ")]
    parsed(spark, sf).select(columns).write.parquet(f"{base}/in")
    # Four batches or so: files come as the corpus is split, so their number grows with it, and not their size.
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    rows = clean_stream(stream_relations(spark, f"{base}/in", max_files=max(1, files // 4)), STREAMED)
    write_stream(rows, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "label", "sentence")


@query(
    "swap_relations",
    with_rel(
        f"""SELECT id, sentence, source, object_entity AS subject_entity, subject_entity AS object_entity,
              subject_start_idx, subject_end_idx, subject_type, object_start_idx, object_end_idx, object_type,
              ({sql_map(rules.SWAP_MAP)})[label] AS label
            FROM rel WHERE label IN ({', '.join(repr(x) for x in rules.SWAP_MAP)})"""
    ),
)
def swap(spark, sf):
    return aug.swap_relations(parsed(spark, sf))


EXCHANGED = """
grp AS (
  SELECT *, row_number() OVER g AS rn,
    count(*) OVER (PARTITION BY label, object_type, subject_type) AS n
  FROM rel WHERE label <> 'no_relation' AND object_type IN ('POH', 'DAT', 'LOC')
  WINDOW g AS (PARTITION BY label, object_type, subject_type ORDER BY id)
), exchanged AS (
  SELECT a.id, replace(replace(a.sentence, a.subject_entity, b.subject_entity),
                       a.object_entity, b.object_entity) AS sentence,
    a.source, a.label, b.subject_entity AS subject_entity, a.subject_start_idx, a.subject_end_idx, a.subject_type,
    b.object_entity AS object_entity, a.object_start_idx, a.object_end_idx, a.object_type
  FROM grp a JOIN grp b ON a.label = b.label AND a.object_type = b.object_type
    AND a.subject_type = b.subject_type AND a.rn = b.n + 1 - b.rn
)"""


@query("exchange_pairs", with_rel(f"SELECT {PARSED_COLS} FROM exchanged", EXCHANGED))
def exchange(spark, sf):
    return aug.exchange_pairs(parsed(spark, sf))


@query(
    "augment_chain",
    with_rel(
        f"""SELECT label, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM (
              SELECT sentence, label FROM rel
              UNION ALL SELECT sentence, ({sql_map(rules.SWAP_MAP)})[label] FROM rel
                WHERE label IN ({', '.join(repr(x) for x in rules.SWAP_MAP)})
              UNION ALL SELECT sentence, label FROM exchanged) GROUP BY label""",
        EXCHANGED,
    ),
)
def augmented(spark, sf):
    rows = aug.augment(parsed(spark, sf), ["swap_sentence", "sub_obj_change_augment"])
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars")
    )
