"""Repair of conversations by weighted CYK parsing of their rows.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``. The repair grammar is in
Chomsky normal form over spans of rows. Its nonterminals are the pairs (p, q) of ``STATES``: a span derives
(p, q) if edits of its rows lead the acceptor from p to q. Leaf rules are the edits of one row: Keep
(cost 0), Rerole to user or assistant (1) and Delete (2), wrapped on both sides in the closure of Insert (5 for each
empty row of user or assistant), so insertions stand anywhere. A row that is blank or a duplicate must
be deleted, and keeping or reroling a truncated row costs 5 more. Binary rules are
(p, r) -> (p, q) (q, r). A cell holds the least (cost, audit) of its span and nonterminal, the audit being the edits'
initials, ties going to the least string by ASCII.

Spans are combined bottom-up by their length: 1, 2, 4, ... rows, inside blocks of ``BLOCK`` rows and then over
blocks. One split point a span is enough, unlike in a grammar whose rules are tied to a split: every
derivation of (p, r) over a span passes some state q at every inner point, so the least over q at one point is the
least of all. That least cells combine to the least is true for the strings too: of two audits
of one span with the same cost none begins with the other, as it would hold the same edits of the rows
and more insertions, at a higher cost; so what is appended cannot turn their order around. Work and cells
grow linearly with the rows. A test compares the cells with a chart of all spans and split points.

No step needs a whole conversation in one task: rows are range partitioned by (conversation, turn), blocks
are cut from their places, cells of blocks are combined ``BLOCK`` at a time until one is left, and the choices
go back down the same way. What grows with a conversation is its audit, which is part of the result,
in each of the up to eleven cells of its span. ``digests`` hashes each conversation's rows in
order, in one task as a hash needs it, but streams them.

Order: by turn (null first), role and text; rows equal in all of these are interchangeable. Nulls in role
and text count as one space, and are returned so. Rows with a null conversation are one conversation. An empty role has no
initial and cannot be kept. Initials are compared as they are, in lower case. An empty table gives no rows. Columns are
picked by name; others are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.operators.ranking import ranked
from relloom.session import lookup, materialise

#: Acceptor of (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(STATES)
ACCEPTING = (START, AFTER_A)
MOVES = {
    "s": {START: AFTER_S},
    "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
}
RULES = [(p, q, r) for p in range(STATES) for q in range(STATES) for r in range(STATES)]
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK = 64
SPACES = " \t\n\x0b\x0c\r"

#: (cost, audit) of each nonterminal p * STATES + q; None: not derived.
Cell = tuple[tuple[int, str] | None, ...]


def combined(left: Cell, right: Cell) -> Cell:
    """The binary rules at one split point."""
    out: list[tuple[int, str] | None] = [None] * (STATES * STATES)
    for p, q, r in RULES:
        a, b = left[p * STATES + q], right[q * STATES + r]
        if a is not None and b is not None:
            found = (a[0] + b[0], a[1] + b[1])
            known = out[p * STATES + r]
            if known is None or found < known:
                out[p * STATES + r] = found
    return tuple(out)


def _cell(edits: list[tuple[int, int, int, str]]) -> Cell:
    out: list[tuple[int, str] | None] = [None] * (STATES * STATES)
    for p, q, cost, audit in edits:
        known = out[p * STATES + q]
        out[p * STATES + q] = min(known, (cost, audit)) if known else (cost, audit)
    return tuple(out)


def _insertions() -> Cell:
    """Closure of Insert: no path between two states needs more than STATES of them."""
    nothing = [(p, p, 0, "") for p in range(STATES)]
    once = _cell(nothing + [(p, q, INSERT, "I") for c in "ua" for p, q in MOVES[c].items()])
    closure = once
    for _ in range(STATES):
        closure = combined(closure, once)
    return closure


INSERTIONS = _insertions()


def leaf(initial: str, fault: str) -> Cell:
    """Cell of one row; ``fault``: "" (none), "t" (truncated), "b" or "d" (must go)."""
    edits = [(p, p, DELETE, "D") for p in range(STATES)]
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        edits += [(p, q, more, "K") for p, q in MOVES.get(initial, {}).items()]
        edits += [(p, q, REROLE + more, "R") for c in "ua" for p, q in MOVES[c].items()]
    return combined(combined(INSERTIONS, _cell(edits)), INSERTIONS)


class Chart:
    """Charts of one block's symbols (initial, fault); spans of up to ``MEMO`` rows are remembered."""

    MEMO, MOST = 4, 200_000

    def __init__(self):
        self.known: dict[tuple, Cell] = {}

    def spans(self, cells: list[Cell]) -> Cell:
        """Neighbouring spans combined pairwise until one spans all."""
        while len(cells) > 1:
            ends = [combined(a, b) for a, b in zip(cells[::2], cells[1::2])]
            cells = ends + cells[len(ends) * 2 :]
        return cells[0]

    def short(self, symbols: tuple) -> Cell:
        cell = self.known.get(symbols)
        if cell is None:
            cell = leaf(*symbols[0]) if len(symbols) == 1 else self.spans([self.short((s,)) for s in symbols])
            if len(self.known) < self.MOST:
                self.known[symbols] = cell
        return cell

    def block(self, symbols: list[tuple[str, str]]) -> Cell:
        return self.spans([self.short(tuple(symbols[k : k + self.MEMO])) for k in range(0, len(symbols), self.MEMO)])


def path(cells: list[Cell], start: int, end: int) -> list[int]:
    """States before, between and after neighbouring spans on the least derivation of (start, end)."""
    ways: dict[int, tuple[int, str, list[int]]] = {start: (0, "", [start])}
    for cell in cells:
        after: dict[int, tuple[int, str, list[int]]] = {}
        for p, (cost, audit, states) in ways.items():
            for q in range(STATES):
                step = cell[p * STATES + q]
                if step is not None:
                    found = (cost + step[0], audit + step[1], [*states, q])
                    if q not in after or found[:2] < after[q][:2]:
                        after[q] = found
        ways = after
    return ways[end][2]


def _facts(columns: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in columns.items()) + ">"


#: What a span's summary holds besides its chart.
FACTS = {
    "n": "bigint", "first_role": "string", "last_role": "string", "first_turn": "bigint", "last_turn": "bigint",
    "turns": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
}
LEGAL = ("su", "ua", "au")


def joined_facts(parts: list[dict]) -> dict:
    """Facts of neighbouring spans as those of the span they make up."""
    out = dict(parts[0])
    for x in parts[1:]:
        out["illegal"] += x["illegal"] + (out["last_role"] + x["first_role"] not in LEGAL)
        out["last_role"] = x["last_role"]
        out["turns"] += x["turns"] - (out["last_turn"] is not None and out["last_turn"] == x["first_turn"])
        out["first_turn"] = x["first_turn"] if out["first_turn"] is None else out["first_turn"]
        out["last_turn"] = out["last_turn"] if x["last_turn"] is None else x["last_turn"]
        for k in ("n", "blank", "duplicate", "truncated"):
            out[k] += x[k]
    return out


def row_facts(initial: str, fault: str, turn: int | None) -> dict:
    return {
        "n": 1, "first_role": initial, "last_role": initial, "first_turn": turn, "last_turn": turn, "turns": int(turn is not None),
        "blank": int(fault == "b"), "duplicate": int(fault == "d"), "truncated": int(fault == "t"), "illegal": 0,
    }


# Rows and their faults.


def _placed(rows: DataFrame) -> DataFrame:
    """Written table of all rows with their place ``pos``: ascending inside a conversation."""
    text = F.rtrim("text", F.lit(SPACES))
    sorted_ = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "role", "text", "_row")
    return materialise(
        sorted_.sortWithinPartitions("conv_id", "turn", "role", "text").select(
            "conv_id", "turn", "role", "text",
            F.monotonically_increasing_id().alias("pos"),
            F.substring("role", 1, 1).alias("initial"),
            F.when(text == "", "b").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "t").otherwise("").alias("own"),
            F.unhex(F.sha2(F.concat_ws(":", F.length("role"), F.col("role"), F.col("text")), 256)).alias("same"),
        )
    )


def _faults(placed: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, initial, fault): the first fault of each row."""
    firsts = lookup(
        placed.groupBy("conv_id", "same").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
        .select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "first")
    )
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("same") == F.col("_same"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("pos") > F.col("first"), "d").otherwise(F.col("own"))
    return placed.join(firsts, on, "left").select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


# Charts of blocks, and of spans of blocks.

_SPAN = "seq bigint, cells array<struct<cost:bigint,audit:string>>, facts " + _facts(FACTS)


def _grouped(rows: DataFrame, group: list[str], item: Column) -> DataFrame:
    """Items of each group in order; groups have at most BLOCK of them."""
    return rows.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _cells(struct: list[dict | None]) -> Cell:
    return tuple(None if c is None else (c["cost"], c["audit"]) for c in struct)


def _plain(cell: Cell) -> list[dict | None]:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in cell]


def _map(groups: DataFrame, schema: str, each) -> DataFrame:
    """Rows from ``each(conv_id, seq, items)`` over groups, a batch at a time."""
    kind = groups.schema["conv_id"].dataType.simpleString()
    arrow = groups.sparkSession.createDataFrame([], f"conv_id {kind}, {schema}").toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = each()
        for batch in batches:
            rows = [out for r in batch.to_pylist() for out in work(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return groups.mapInArrow(run, f"conv_id {kind}, {schema}")


def _block_spans(blocks: DataFrame) -> DataFrame:
    def each():
        chart = Chart()

        def work(r: dict) -> list[dict]:
            items = r["items"]
            facts = joined_facts([row_facts(x["initial"], x["fault"], x["turn"]) for x in items])
            cell = chart.block([(x["initial"], x["fault"]) for x in items])
            return [{"conv_id": r["conv_id"], "seq": r["seq"], "cells": _plain(cell), "facts": facts}]

        return work

    return _map(blocks, _SPAN, each)


def _wider_spans(groups: DataFrame) -> DataFrame:
    def each():
        chart = Chart()

        def work(r: dict) -> list[dict]:
            items = r["items"]
            cell = chart.spans([_cells(x["cells"]) for x in items])
            return [{"conv_id": r["conv_id"], "seq": r["seq"], "cells": _plain(cell), "facts": joined_facts([x["facts"] for x in items])}]

        return work

    return _map(groups, _SPAN, each)


def _split_choices(groups: DataFrame) -> DataFrame:
    """Choices of a span's parts from that of the span: states before and after, and outputs before."""

    def each():
        def work(r: dict) -> list[dict]:
            cells = [_cells(x["cells"]) for x in r["items"]]
            states, done, out = path(cells, r["p"], r["q"]), r["done"], []
            for x, cell, p, q in zip(r["items"], cells, states[:-1], states[1:], strict=True):
                out.append({"conv_id": r["conv_id"], "seq": x["seq"], "p": p, "q": q, "done": done})
                audit = cell[p * STATES + q][1]
                done += len(audit) - audit.count("D")
            return out

        return work

    return _map(groups, "seq bigint, p int, q int, done bigint", each)


class Parsed:
    """Chart of all conversations: ``placed`` rows, ``blocks`` of them, and one span for each conversation."""

    def __init__(self, rows: DataFrame):
        self.placed = _placed(rows)
        item = F.struct("pos", "turn", "initial", "fault")
        by_block = _faults(self.placed).withColumn("seq", F.expr(f"pos div {BLOCK}"))
        self.blocks = materialise(_grouped(by_block, ["conv_id", "seq"], item))
        #: Spans of each level with the number ``up`` of the wider span that they are part of.
        self.levels: list[DataFrame] = []
        spans = materialise(_block_spans(self.blocks))
        while True:
            most = spans.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
            if most <= BLOCK:
                break
            numbered = ranked(spans, ["conv_id"], [F.col("seq")])
            self.levels.append(materialise(numbered.withColumn("up", F.expr(f"(rn - 1) div {BLOCK}")).drop("rn", "rn_total")))
            spans = self._wider(self.levels[-1])
        self.levels.append(spans.withColumn("up", F.lit(0).cast("long")))
        self.whole = self._wider(self.levels[-1])

    def _wider(self, level: DataFrame) -> DataFrame:
        groups = _grouped(level, ["conv_id", "up"], F.struct("seq", "cells", "facts")).withColumnRenamed("up", "seq")
        return materialise(_wider_spans(groups))

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations with rows."""
        ends = F.filter(F.array(*[F.get("cells", F.lit(START * STATES + q)) for q in ACCEPTING]), lambda c: c.isNotNull())
        gaps = F.coalesce(F.col("facts.last_turn") - F.col("facts.first_turn") + 1 - F.col("facts.turns"), F.lit(0))
        return self.whole.withColumn("best", F.array_min(ends)).select(
            "conv_id", gaps.alias("gaps"), *[f"facts.{c}" for c in ("blank", "duplicate", "truncated", "illegal")],
            "best.cost", "best.audit",
        )

    def choices(self) -> DataFrame:
        """(conv_id, seq, p, q, done) of every block: its nonterminal in the least derivation."""
        cells = [F.get("cells", F.lit(START * STATES + q)) for q in ACCEPTING]
        end = F.when(cells[0] <= F.coalesce(cells[1], cells[0]), ACCEPTING[0]).otherwise(ACCEPTING[1])
        chosen = self.whole.select("conv_id", "seq", F.lit(START).alias("p"), end.alias("q"), F.lit(0).cast("long").alias("done"))
        for level in reversed(self.levels):
            groups = _grouped(level, ["conv_id", "up"], F.struct("seq", "cells"))
            chosen = materialise(_split_choices(_with_choice(groups, chosen, "up")))
        return chosen

    def edits(self) -> DataFrame:
        """(conv_id, n, edit, pos, role) for each edit but those that keep nothing.

        ``n``: place in the repaired conversation; ``pos``: the row kept, null for inserted ones; ``role``: the new
        role, null where the row's own stays.
        """

        def each():
            chart = Chart()

            def work(r: dict) -> list[dict]:
                items = r["items"]
                cells = [chart.short(((x["initial"], x["fault"]),)) for x in items]
                states, n, out = path(cells, r["p"], r["q"]), r["done"], []
                for x, cell, p, q in zip(items, cells, states[:-1], states[1:], strict=True):
                    for edit in cell[p * STATES + q][1]:
                        if edit == "D":
                            continue
                        keep = edit == "K"
                        c = x["initial"] if keep else "a" if p == AFTER_U else "u"
                        p = MOVES[c][p]
                        role = None if keep else "user" if c == "u" else "assistant"
                        out.append({"conv_id": r["conv_id"], "n": n, "edit": edit, "pos": None if edit == "I" else x["pos"], "role": role})
                        n += 1
                return out

            return work

        return _map(_with_choice(self.blocks, self.choices(), "seq"), "n bigint, edit string, pos bigint, role string", each)

    def repaired(self) -> DataFrame:
        """(conv_id, n, edit, turn, role, text) of the repaired conversations; inserted rows have no turn."""
        edits = materialise(self.edits())
        own = self.placed.select(F.col("pos").alias("_pos"), "turn", F.col("role").alias("_role"), "text")
        kept = edits.where("pos IS NOT NULL").join(own, F.col("pos") == F.col("_pos")).select(
            "conv_id", "n", "edit", "turn", F.coalesce("role", "_role").alias("role"), "text"
        )
        added = edits.where("pos IS NULL").select("conv_id", "n", "edit", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
        return kept.unionByName(added)


def _with_choice(groups: DataFrame, chosen: DataFrame, seq: str) -> DataFrame:
    c = chosen.select(F.col("conv_id").alias("_conv"), F.col("seq").alias("_seq"), "p", "q", "done")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(seq) == F.col("_seq"))
    return groups.join(c, on).select("conv_id", F.col(seq).alias("seq"), "items", "p", "q", "done")


def parsed(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Parsed:
    space = F.lit(" ")
    return Parsed(
        conversations.select(
            F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        )
    )


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of ``role:text`` lines joined by line feeds, streamed in order."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "n", F.concat_ws(":", "role", "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for conv, n, line in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == 0:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256(line.encode())
                else:
                    running.update(("\n" + line).encode())
            if out:
                yield _hashes(out, batch.schema)
        if running is not None:
            yield _hashes([(now, running.hexdigest())], batch.schema)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "n").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _hashes(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    ids = pa.array([x[0] for x in out], schema.field(0).type)
    return pa.record_batch([ids, pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])


# The damage that the query repairs.


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32('conv_id:turn') % 20: 0 goes, 1 loses its text, 2 its ends of sentences, 3 comes
    twice, 4 becomes one of the user. Nulls count as one space, in the key too."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    kind = F.col("kind")
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame) -> DataFrame:
    """One row for every conversation: what is wrong after the damage, and the least repair."""
    chart = parsed(damaged(conversations))
    found = lookup(chart.summary())
    hashes = lookup(digests(chart.repaired()))
    every = conversations.select("conv_id").distinct()
    f = found.withColumnRenamed("conv_id", "_conv")
    h = hashes.withColumnRenamed("conv_id", "_hashed")
    return (
        every.join(f, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .join(h, F.col("conv_id").eqNullSafe(F.col("_hashed")) , "left")
        .select(
            "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )


def repair_sql() -> str:
    """The same repair row by row, from state to state."""
    moves = ", ".join(f"('{c}', {p}, {q})" for c, m in MOVES.items() for p, q in m.items())
    return rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, LATERAL (SELECT unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))) WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c_before,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM numbered),
ruled AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM marked),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM ruled GROUP BY conv_id),
moves(c, p, q) AS (VALUES {moves}),
steps AS (
  SELECT conv_id, i, p, q, {TRUNCATED} * (fault = 't')::INT AS cost, 'K' AS edit, role || ':' || text AS line
  FROM ruled JOIN moves USING (c) WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT conv_id, i, p, q, {REROLE} + {TRUNCATED} * (fault = 't')::INT, 'R',
    CASE m.c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM ruled, moves m WHERE m.c <> 's' AND fault NOT IN ('b', 'd')
  UNION ALL
  SELECT conv_id, i, p, p, {DELETE}, 'D', NULL FROM ruled, (SELECT unnest(range({STATES})) AS p)),
inserts AS (
  SELECT p, p AS q, 0 AS cost, '' AS edit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT unnest(range({STATES})) AS p)
  UNION ALL
  SELECT p, q, {INSERT}, 'I', [CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM moves WHERE c <> 's'
  UNION ALL
  SELECT x.p, y.q, 2 * {INSERT}, 'II', ['user:', 'assistant:'] FROM moves x JOIN moves y ON x.q = y.p
  WHERE x.c = 'u' AND y.c = 'a'),
walked AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q, CAST(cost AS BIGINT) AS cost, edit AS audit, lines
  FROM counts, inserts WHERE p = {START}
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, k.q, min(struct_pack(
      cost := w.cost + s.cost + k.cost, audit := w.audit || s.edit || k.edit,
      lines := list_concat(CASE WHEN s.line IS NULL THEN w.lines ELSE list_append(w.lines, s.line) END, k.lines))) AS best
    FROM walked w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.p = w.q
    JOIN inserts k ON k.p = s.q
    GROUP BY w.conv_id, w.i, k.q)),
ends AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost, audit := w.audit, lines := w.lines)) AS best
  FROM walked w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
  WHERE q IN {ACCEPTING} GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


REPAIR_SQL = repair_sql()
