"""Worked examples: one sentence through parsing, tags, prefixes and masks; odd inputs."""

import random
import re

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relloom.operators import clean as cl
from relloom.operators.parse import decode_labels, encode_labels, parse_entities
from tests.conftest import PARSED, no_broadcast

# The worked example of the tags' documentation.
SENTENCE = "〈Something〉는 조지 해리슨이 쓰고 비틀즈가 1969년 앨범 《Abbey Road》에 담은 노래다."
TAIL = " 가 1969년 앨범 《Abbey Road》에 담은 노래다."
PUNCT = "〈Something〉는  # ^ 사람 ^ 조지 해리슨 # 이 쓰고  @ * 모임 * 비틀즈 @" + TAIL


@pytest.fixture(scope="module")
def raw(spark):
    subject = "{'word': '비틀즈', 'start_idx': 24, 'end_idx': 26, 'type': 'ORG'}"
    obj = "{'word': '조지 해리슨', 'start_idx': 13, 'end_idx': 18, 'type': 'PER'}"
    return spark.createDataFrame(
        [(1, SENTENCE, subject, obj, "org:members", "wikipedia")],
        "id long, sentence string, subject_entity string, object_entity string, label string, source string",
    )


@pytest.fixture(scope="module")
def golden(raw):
    return parse_entities(raw)


def sentence(df):
    return df.first().sentence


def test_parse(golden):
    row = golden.first()
    assert (row.subject_entity, row.subject_start_idx, row.subject_end_idx, row.subject_type) == ("비틀즈", 24, 26, "ORG")
    assert (row.object_entity, row.object_start_idx, row.object_end_idx, row.object_type) == ("조지 해리슨", 13, 18, "PER")


@pytest.mark.parametrize(
    "literal, word",
    [
        ("{'word': 'a', 'start_idx': 0, 'end_idx': 0, 'type': 'PER'}", "a"),
        ("{'word': \"it's\", 'start_idx': 0, 'end_idx': 3, 'type': 'PER'}", "it's"),
        ("{'word': 'a\\'b\"c', 'start_idx': 0, 'end_idx': 4, 'type': 'PER'}", "a'b\"c"),
    ],
)
def test_quotes(spark, literal, word):
    df = spark.createDataFrame([(1, literal, literal)], "id long, subject_entity string, object_entity string")
    assert parse_entities(df).first().subject_entity == word


def test_broken_literal_stops_the_job(spark):
    df = spark.createDataFrame([(1, "{'word': ", "{}")], "id long, subject_entity string, object_entity string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        parse_entities(df).collect()


def test_tags(golden):
    assert sentence(cl.mark_entities(golden, "base")) == (
        "〈Something〉는 [ENT] 조지 해리슨 [/ENT] 이 쓰고 [ENT] 비틀즈 [/ENT]" + TAIL
    )
    assert sentence(cl.mark_entities(golden, "typed")) == (
        "〈Something〉는 [O:PER] 조지 해리슨 [/O:PER] 이 쓰고 [S:ORG] 비틀즈 [/S:ORG]" + TAIL
    )
    assert sentence(cl.mark_entities(golden, "punct")) == PUNCT


def test_prefix(golden):
    prefix = "@ * 모임 * 비틀즈 @와 # ^ 사람 ^ 조지 해리슨 #의 관계 [SEP] "
    assert sentence(cl.query_prefix(cl.mark_entities(golden, "punct"))) == prefix + PUNCT
    typed = "@ * ORG * 비틀즈 @와 # ^ PER ^ 조지 해리슨 #의 관계 [SEP] "
    assert sentence(cl.query_prefix(golden, typed=True)) == typed + SENTENCE


def test_masks(golden):
    row = cl.mask_entities(cl.mark_entities(golden, "base"), "base").first()
    assert row.sentence == "〈Something〉는 [OBJ] 이 쓰고 [SUB]" + TAIL
    assert (row.subject_entity, row.object_entity) == ("[SUB]", "[OBJ]")
    row = cl.mask_entities(cl.mark_entities(golden, "typed"), "typed").first()
    assert row.sentence == "〈Something〉는 [O:PER] 이 쓰고 [S:ORG]" + TAIL
    assert (row.subject_entity, row.object_entity) == ("[S:ORG]", "[O:PER]")


def test_foreign_script(spark):
    df = spark.createDataFrame([("日本の東京とソニー漢字 ABC ㅋㅋ",), ("가나다 123 !!",), ("",)], "sentence string")
    got = [r.sentence for r in cl.replace_foreign(df).collect()]
    assert got == ["[OTH] ABC ㅋㅋ", "가나다 123 !!", ""]


def test_kana(spark):
    df = spark.createDataFrame([("みなみ", "ソニー", "ソニー々")], "sentence string, subject_entity string, object_entity string")
    row = cl.flag_kana(df).first()
    assert (row.sentence_kana, row.subject_entity_kana, row.object_entity_kana) == (True, False, True)


def test_other_persons(rows_of):
    text = "Yesterday Ada Blom asked Cem whether Eva Ilse Horn of Nordwerk knew Ada or Ada Blomqvist"
    rows = rows_of([(1, text, "Cem", "Nordwerk", "per:employee_of")])
    names = rows.sparkSession.createDataFrame(
        [(n,) for n in ("Ada Blom", "Ada", "Cem", "Eva Ilse Horn", "Ilse", "", None)], "name string"
    )
    out = cl.mask_other_persons(cl.mark_entities(rows), names)
    # The blank behind a closing tag and the one of the text both stay.
    want = "Yesterday [PER] asked Cem  whether [PER] of Nordwerk  knew [PER] or [PER] Blomqvist"
    assert sentence(out) == want
    with no_broadcast(rows.sparkSession):
        assert sentence(cl.mask_other_persons(cl.mark_entities(rows), names)) == want
    assert sentence(cl.mask_other_persons(cl.mark_entities(rows), names.limit(0))).replace("  ", " ") == text


def masked_by_hand(pieces, own, names):
    out = []
    for piece in pieces:
        words, at = piece.split(" "), 0
        while piece not in own and at < len(words):
            n = max((n for n in range(1, len(words) - at + 1) if " ".join(words[at : at + n]) in names), default=0)
            words[at : at + max(n, 1)] = ["[PER]" if n else words[at]]
            at += 1
        out.append(" ".join(words))
    return " ".join(out)


def test_other_persons_by_hand(rows_of):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randrange(1, 25))) for _ in range(80)]
    rows = rows_of([(i, f"{t} x{i} {t[::-1]} y{i} {t}", f"x{i}", f"y{i}", "no_relation") for i, t in enumerate(texts)])
    names = {" ".join(draw.choice("abcd") for _ in range(draw.randrange(1, 5))) for _ in range(12)}
    tagged = cl.mark_entities(rows)
    out = cl.mask_other_persons(tagged, rows.sparkSession.createDataFrame([(n,) for n in names], "name string"))
    got = {r.id: r.sentence for r in out.collect()}
    for i, t in enumerate(texts):
        pieces = re.split(r" ?\[ENT\] ?| ?\[/ENT\] ?", f"{t} [ENT] x{i} [/ENT]  {t[::-1]} [ENT] y{i} [/ENT]  {t}")
        assert got[i] == masked_by_hand(pieces, (f"x{i}", f"y{i}"), names)


def test_other_persons_ships_no_text(rows_of):
    """The stream that is joined with the names holds places and hashes only."""
    rows = rows_of([(1, "a x b y", "x", "y", "no_relation")])
    names = rows.sparkSession.createDataFrame([("a",), ("a b",)], "name string")
    with no_broadcast(rows.sparkSession):
        plan = cl.mask_other_persons(cl.mark_entities(rows), names)._jdf.queryExecution().optimizedPlan().toString()
    # Single words leave their sentence behind (column 2 is not required above the explode), runs of words too.
    assert re.search(r"Generate posexplode\(_words#\d+\), \[2\], true, \[pos", plan)
    assert re.search(r"Project \[id#\w+, piece#\d+, _at#\d+\.pos AS pos#\d+, _at#\d+\.n AS n#\d+, _at#\d+\._hash AS _hash#\w+\]", plan)


def test_other_persons_streams_rare_words_only(rows_of, monkeypatch):
    """Frequent words are looked up in the row and texts are not shuffled; however many are frequent, the rows are the same."""
    draw = random.Random(6)
    texts = [" ".join(draw.choice("aabbbbccd") for _ in range(draw.randrange(1, 25))) for _ in range(40)]
    rows = rows_of([(i, f"{t} a{i} {t[::-1]} y{i} {t}", f"a{i}", f"y{i}", "no_relation") for i, t in enumerate(texts)])
    names = {"a", "c", "b a", "c d b", "a0", "y1"}
    tagged, listed = cl.mark_entities(rows), rows.sparkSession.createDataFrame([(n,) for n in names], "name string")
    for frequent in (1, 3, 1000):
        monkeypatch.setattr(cl, "FREQUENT", frequent)
        out = cl.mask_other_persons(tagged, listed)
        got = {r.id: r.sentence for r in out.collect()}
        for i, t in enumerate(texts):
            pieces = re.split(r" ?\[ENT\] ?| ?\[/ENT\] ?", f"{t} [ENT] a{i} [/ENT]  {t[::-1]} [ENT] y{i} [/ENT]  {t}")
            assert got[i] == masked_by_hand(pieces, (f"a{i}", f"y{i}"), names)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "NOT array_contains(scalar-subquery" in plan and "RepartitionByExpression" not in plan
        assert "AS _common" not in plan  # else each row would get a copy of the table
    words = rows.sparkSession.createDataFrame([(w,) for w in "a a a b b c c d".split()], "_word string")
    for frequent, most in ((1, "a"), (2, "a"), (3, "abc"), (4, "abc")):
        monkeypatch.setattr(cl, "FREQUENT", frequent)
        found = cl._most_frequent(words)
        assert sorted(r[0] for r in found.collect()) == list(most)
        assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(cl, "FREQUENT", 0)
    assert cl._most_frequent(words).count() == 0


# Odd spans.
def one_row(spark, text, s, o, types=("PER", "ORG")):
    row = (1, text, text[s[0]: s[1] + 1], *s, types[0], text[o[0]: o[1] + 1], *o, types[1], "no_relation", "web")
    return spark.createDataFrame([row], PARSED)


def by_insertion(text, s, o, tags):
    """Tags put in from right to left, one at a time."""
    (s_open, s_close), (o_open, o_close) = tags
    cuts = [(s[0], s_open), (s[1] + 1, s_close), (o[0], o_open), (o[1] + 1, o_close)]
    # At equal positions the closing tag comes first in the text, so it is put in last.
    for at, tag in sorted(cuts, key=lambda c: (c[0], c[1] in (s_open, o_open)), reverse=True):
        text = text[:at] + tag + text[at:]
    return text


@pytest.mark.parametrize(
    "s, o", [((0, 0), (2, 2)), ((4, 7), (0, 2)), ((0, 3), (4, 7)), ((4, 7), (0, 3)), ((0, 1), (8, 9))]
)
def test_tags_by_insertion(spark, s, o):
    text = "abcdefghij"
    got = cl.mark_entities(one_row(spark, text, s, o), "typed").first()
    tags = (("[S:PER] ", " [/S:PER] "), ("[O:ORG] ", " [/O:ORG] "))
    assert got.sentence == by_insertion(text, s, o, tags)
    assert got.span_ok


@pytest.mark.parametrize("s, o", [((0, 4), (2, 6)), ((0, 8), (3, 5)), ((3, 5), (3, 5))])
@pytest.mark.parametrize("style", ["base", "typed", "punct"])
def test_overlap_leaves_the_sentence(spark, s, o, style):
    got = cl.mark_entities(one_row(spark, "abcdefghij", s, o), style).first()
    assert (got.sentence, got.span_ok) == ("abcdefghij", False)


def test_removing_tags_gives_the_sentence_back(spark):
    from relloom.corpus import relations
    from tests.conftest import SF

    rows = relations(spark, SF).withColumn("plain", F.col("sentence"))
    back = cl.mark_entities(rows, "typed").withColumn(
        "back", F.regexp_replace("sentence", r" \[/[SO]:[A-Z]+\] |\[[SO]:[A-Z]+\] ", "")
    )
    assert back.where("back <> plain OR NOT span_ok").count() == 0


def test_same_text_for_both_entities(spark):
    rows = one_row(spark, "kim met kim", (0, 2), (8, 10))
    out = cl.mask_entities(cl.mark_entities(rows, "base"), "base").first()
    # The second replacement finds nothing: the first one took both.
    assert out.sentence == "[SUB]  met [SUB] "


def test_unknown_type_has_no_word(spark):
    with pytest.raises((PySparkException, Py4JJavaError)):
        cl.mark_entities(one_row(spark, "abcdefghij", (0, 1), (3, 4), ("PER", "DUR")), "punct").collect()


def test_labels(spark):
    df = spark.createDataFrame([("no_relation",), ("per:religion",)], "label string")
    assert [r.label_num for r in encode_labels(df).collect()] == [0, 29]
    assert [r.label for r in decode_labels(encode_labels(df)).collect()] == ["no_relation", "per:religion"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        encode_labels(spark.createDataFrame([("no such label",)], "label string")).collect()


def test_stop_words_in_a_long_list(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i} w{i % 7}  x w{i % 50}") for i in range(300)], "id long, sentence string")
    words = spark.createDataFrame([(f"w{k}",) for k in range(0, 300, 3)], "word string")
    want = sorted(map(tuple, cl.remove_stop_words(rows, [f"w{k}" for k in range(0, 300, 3)]).collect()))
    assert sorted(map(tuple, cl.remove_stop_words(rows, words).collect())) == want
    monkeypatch.setattr(cl, "LISTED", 5)
    assert sorted(map(tuple, cl.remove_stop_words(rows, words).collect())) == want


def test_stop_words_as_list_and_table(spark):
    rows = spark.createDataFrame([(1, "a b  c a"), (2, "a"), (3, ""), (4, None)], "id long, sentence string")
    words = spark.createDataFrame([("a",), ("c",), (None,)], "word string")
    want = [(1, "b"), (2, ""), (3, ""), (4, None)]
    assert sorted(map(tuple, cl.remove_stop_words(rows, ["a", "c", None]).collect())) == want
    assert sorted(map(tuple, cl.remove_stop_words(rows, words).collect())) == want
    with no_broadcast(spark):
        assert sorted(map(tuple, cl.remove_stop_words(rows, words).collect())) == want


def test_chain_skips_training_steps(rows_of):
    rows = rows_of([(1, "a x b y", "x", "y", "no_relation"), (2, "a x b y", "x", "y", "per:title")])
    steps = [("remove_duplicated", {"ids": [2]}), "add_entity_tokens_base"]
    assert cl.clean(rows, steps, train=True).count() == 1
    assert cl.clean(rows, steps).count() == 2
    assert cl.clean(rows, []).collect() == rows.collect()
    with pytest.raises(ValueError):
        cl.clean(rows, ["no_such_step"])


def test_own_step(rows_of):
    cl.register_step("shout", lambda df: df.withColumn("sentence", F.upper("sentence")))
    try:
        rows = rows_of([(1, "a x b y", "x", "y", "no_relation")])
        assert sentence(cl.clean(rows, ["shout"])) == "A X B Y"
    finally:
        del cl.STEPS["shout"]
