"""Operators 11 to 13 against brute force, and on nulls, empty rows, ties, repeated rows and extra columns."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from relloom.llm import conversation_repair as R
from relloom.llm import language_id as L
from relloom.llm import vector_codes as V
from tests.conftest import SF, no_broadcast

# 11. Conversations.
SYMBOLS = [(c, f) for c in ("s", "u", "a", "x", "") for f in ("", "t", "b", "d")]


def whole_chart(symbols):
    """All spans and all split points."""
    n = len(symbols)
    cell = {(i, i + 1): R.leaf(*s) for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            found = [R.combined(cell[i, k], cell[k, i + length]) for k in range(i + 1, i + length)]
            cell[i, i + length] = tuple(min((c[x] for c in found if c[x] is not None), default=None) for x in range(16))
    return cell[0, n]


def test_one_split_a_span_gives_the_whole_chart():
    rng = random.Random(3)
    for n in (1, 2, 3, 5, 8, 13):
        for _ in range(12):
            symbols = [rng.choice(SYMBOLS) for _ in range(n)]
            assert R.Chart().block(symbols) == whole_chart(symbols)


def test_audit_spells_a_well_formed_conversation():
    rng = random.Random(4)
    for _ in range(50):
        symbols = [rng.choice(SYMBOLS) for _ in range(rng.randrange(1, 12))]
        cell = R.Chart().block(symbols)
        cost, audit = min(cell[q] for q in R.ACCEPTING)
        state, left, paid = R.START, iter(symbols), 0
        for edit in audit:
            initial, fault = (None, "") if edit == "I" else next(left)
            if edit != "D":
                c = initial if edit == "K" else "a" if state == R.AFTER_U else "u"
                state = R.MOVES[c][state]
                assert fault not in ("b", "d")
            paid += {"K": 0, "R": 1, "D": 2, "I": 5}[edit] + 5 * (fault == "t" and edit != "D")
        assert next(left, None) is None and state in R.ACCEPTING and paid == cost


CONVERSATION = "conv_id long, turn long, role string, text string, pos long, n long, cells string"


def odd_conversations():
    rng = random.Random(9)
    rows = [
        (1, 0, "user", None), (1, 1, None, "No role."), (1, None, "system", "No turn."), (1, None, "user", "Nor here."),
        (2, 0, "", "Empty role."), (2, 1, "user", ""), (2, 2, "assistant", " \t\n "), (2, 9, "Assistant", "Other case."),
        (None, 3, "user", "No conversation."), (None, 4, "assistant", "None either."), (None, None, None, None),
        (3, None, "user", "All turns null."), (3, None, "assistant", "Yes."),
        (4, 5, "user", "Same turn."), (4, 5, "user", "Same turn."), (4, 5, "assistant", "Same turn, too."), (4, 5, "assistant", "Less."),
        (5, -7, "user", "x" * 50_000), (5, 7, "assistant", "é漢 \U0001f600!"),
    ]
    for k in range(150):
        rows.append((6, k + k // 40, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Ja.", "Nein", "Wie?", f"T{k}.", ""])))
    # Those whose only row goes.
    gone = [c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    rows += [(c, 0, "user", "Gone.") for c in range(100, 200)]
    return [(*r, None, 1, "x") for r in rows], gone


def repaired_by_sql(rows):
    con = duckdb.connect()
    names = [x.split()[0] for x in CONVERSATION.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, CONVERSATION.split(", "), strict=True)])
    con.register("conversations", pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema))
    cursor = con.execute(R.REPAIR_SQL)
    return [c[0] for c in cursor.description], Counter(cursor.fetchall())


@pytest.mark.parametrize("block", [64, 4])
def test_repair_of_odd_conversations(spark, monkeypatch, block):
    """Blocks of 4 rows: the conversation of 150 rows is combined over several levels."""
    monkeypatch.setattr(R, "BLOCK", block)
    rows, gone = odd_conversations()
    names, want = repaired_by_sql(rows)
    df = spark.createDataFrame(rows, CONVERSATION).repartition(3)
    with no_broadcast(spark):
        got = R.repair(df).select(names).collect()
    assert Counter(map(tuple, got)) == want
    by_id = {r.conv_id: r for r in got}
    assert all(by_id[c].audit == "" and by_id[c].cost == 0 for c in gone)
    assert R.repair(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."),
            (2, 0, "assistant", "Hi."), (3, 0, "user", " ")]
    chart = R.parsed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    summary = {r.conv_id: (r.cost, r.audit, r.blank, r.illegal) for r in chart.summary().collect()}
    assert summary == {1: (2, "KDKK", 0, 1), 2: (2, "D", 0, 0), 3: (2, "D", 1, 0)}
    got = sorted((r.conv_id, r.n, r.edit, r.role, r.text) for r in chart.repaired().collect())
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Are you there?"), (1, 2, "K", "assistant", "Yes.")]


# 12. Languages.
def test_grams():
    texts = ["Ab, c! 7", "", "-", "Éß中", "a\nb"]
    h, row = L.grams(texts)
    want = Counter()
    for i, t in enumerate(texts):
        word = ""
        for c in t.lower() + " ":
            if c.isalpha():
                word += c
                continue
            marked = f"_{word}_"
            for n in L.GRAMS if word else ():
                want[i] += len(word) if n == 1 else max(0, len(marked) - n + 1)
            word = ""
    assert Counter(row.tolist()) == want
    one = {i: set(h[row == i].tolist()) for i in range(5)}
    assert set(L.grams(["c"])[0].tolist()) <= one[0] and not set(L.grams(["c"])[0].tolist()) <= one[4]
    assert all(not len(x) for x in L.grams([]))


def test_filters_hold_their_grams_and_know_their_mistakes():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, 60_000).astype(np.uint64) * np.uint64(2) for _ in range(70)]
    masks = np.zeros((2, 1 << L.BITS), dtype=np.uint64)
    for l, s in enumerate(sets):
        for j in range(L.HASHES):
            place = (s >> np.uint64(L.BITS * j)) & np.uint64((1 << L.BITS) - 1)
            np.bitwise_or.at(masks[l // 64], place.astype(np.int64), np.uint64(1) << np.uint64(l % 64))
    f = L.Filters([f"l{l}" for l in range(70)], masks)
    for l in (0, 63, 64, 69):
        assert f.hits(sets[l], np.zeros(len(sets[l]), np.int64), 1)[0, l] == len(sets[l])
    other = rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    share = f.hits(other, np.zeros(len(other), np.int64), 1)[0] / len(other)
    assert np.allclose(share, f.mistaken, atol=3e-3)


def test_languages_as_exact_sets_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "lang", "text").collect()
    out = [zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows]
    counts = defaultdict(Counter)
    for r, held in zip(rows, out, strict=True):
        if not held and r.lang is not None:
            counts[r.lang].update(L.grams([r.text or ""])[0].tolist())
    share = {l: {g: n / c.total() for g, n in c.items()} for l, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, p in s.items():
            top[g] = max(top[g], p)
    sets = {l: {g for g, p in s.items() if p >= L.LEAST_SHARE and p * L.RATIO >= top[g]} for l, s in share.items()}
    got = {r.doc_id: r for r in L.language(docs).collect()}
    right = 0
    for r, held in zip(rows, out, strict=True):
        assert got[r.doc_id].held_out == held
        found = {l: sum(g in s for g in L.grams([r.text or ""])[0].tolist()) for l, s in sets.items()}
        first, second = sorted(found.values())[-1:-3:-1]
        if first > 1.05 * second:
            assert got[r.doc_id].lang_pred == max(found, key=found.get)
            assert abs(got[r.doc_id].score - first / sum(found.values())) < 0.05
        right += held and got[r.doc_id].lang_pred == r.lang
    assert right >= 0.98 * sum(out)


def test_languages_of_odd_rows(spark):
    texts = {"aa": "nolo minu tesk ", "bb": "xyq zwk qqx ", None: "nolo zwk ", "": "中文 字 "}
    rows = [(i, t * (1 + i % 7), l, 1.0, "s") for i, (l, t) in enumerate(list(texts.items()) * 30)]
    more = [None, "", " \n7!", "NOLO.", "qqx", "字", "zzzz", "nolo minu " * 30_000, "\x00nolo"]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(more)] + [(None, "nolo", "bb", None, None), (None, "nolo", "bb", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = L.language(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[1000 + i].lang_pred for i in range(len(more))] == ["und", "und", "und", "aa", "bb", "", "bb", "aa", "aa"]
    assert by_id[None].lang_pred == "aa" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0) for r in got)
    assert {r.lang_pred for r in got} == {"aa", "bb", "", "und"}
    unknown = L.language(df.where("lang IS NULL")).collect()
    assert unknown and {r.lang_pred for r in unknown} == {"und"}
    assert L.language(df.limit(0)).count() == 0


# 13. Vectors.
def plain_nearest(x, book):
    apart = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


@pytest.mark.parametrize("spread", [1, 5, 100, 1 << 26])
def test_slices_give_the_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    for size in (1, 2, 7, 64):
        for width in (1, 2, 4):
            book = rng.integers(-spread, spread + 1, (size, width))
            x = rng.integers(-spread, spread + 1, (500, width))
            for got, want in zip(V.Slices(book).nearest(x), plain_nearest(x, book), strict=True):
                assert (got == want).all()
            far = np.full((3, width), 1 << 26)
            for got, want in zip(V.Slices(book).nearest(far), plain_nearest(far, book), strict=True):
                assert (got == want).all()


def test_candidates_are_those_inside_the_box():
    rng = np.random.default_rng(8)
    book, x = rng.integers(-20, 20, (64, 3)), rng.integers(-20, 20, (200, 3))
    masks = V.Slices(book).candidates(x, np.full(200, 6))
    inside = (np.abs(x[:, None] - book[None]) <= 6).all(axis=2)
    assert [[bool(int(m) >> e & 1) for e in range(64)] for m in masks] == inside.tolist()


def plain_codes(rows):
    """The contract, vector by vector."""
    whole = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(whole[0][1]) // V.PARTS
    cut = np.array([r[1] for r in whole]).reshape(len(whole), V.PARTS, width)
    books = cut[: V.ENTRIES].transpose(1, 0, 2).copy()
    for k in range(V.ROUNDS + 1):
        found = [plain_nearest(cut[:, p], books[p]) for p in range(V.PARTS)]
        for p, (index, _) in enumerate(found) if k < V.ROUNDS else ():
            for e in set(index.tolist()):
                members = cut[index == e, p]
                books[p, e] = [int(s) // len(members) for s in members.sum(axis=0)]
    errors = sum(d for _, d in found)
    by_label = Counter()
    for r, e in zip(whole, errors.tolist(), strict=True):
        by_label[r[2]] += e
    codes = ["".join(f"{index[i]:02x}" for index, _ in found) for i in range(len(whole))]
    return Counter((r[0], c, e, by_label[r[2]], V.Codebooks(books).digest()) for r, c, e in zip(whole, codes, errors.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_codes_of_odd_vectors(spark, n):
    rng = random.Random(n)
    good = [[rng.choice([-2, -1, 0, 1, 3]) / 256 + rng.random() / 300 for _ in range(32)] for _ in range(n)]
    rows = [(rng.randrange(n * 2), v, rng.choice([1, 2, None])) for v in good]
    rows += rows[:3] + [(None, v, 1) for v in good[:2]]
    want = plain_codes([(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows]) if rows else Counter()
    bad = [None, [], [0.5] * 31, [0.5] * 64, [None] + [0.5] * 31, [float("nan")] + [0.5] * 31, [float("-inf")] * 32, [1e30] * 32]
    rows += [(5000 + i, v, 2) for i, v in enumerate(bad)] if n else []
    schema = "vec_id long, embedding array<double>, label int, v string, code string, _label int"
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema).repartition(3)
    assert Counter(map(tuple, V.compressed(df).collect())) == want
