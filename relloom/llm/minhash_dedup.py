"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes) and a signature of
   ``COORDS`` min-hashes. Texts with equal sets are one class from here on; its smallest id stands
   for it.
2. Each class is posted under its coordinate-value pairs. Pairs held by one class alone are skipped.
   Two classes that share at least ``MATCHES`` coordinates must meet in one of the rarest
   ``m - MATCHES + 1`` of the m shared-by-anyone pairs of either, so only that prefix is kept
   (long lists are skipped and not merged). Collisions of a candidate are then counted on the two
   signatures, and what reaches ``MATCHES`` is confirmed on the full sets.
3. No list is expanded into all of its pairs at first: members are tried against the list's first
   and last member, then against the one that shares most of its shingles. Links found join classes into components. Only members of
   lists that still hold several components are then tried against all others of the list that
   are not in their own component, so no link between components is lost. Of these pairs, those are
   left out whose similarity cannot reach the threshold, by an exact bound (``_ABLE``).

A pair at similarity 0.75 agrees in 48 of 64 coordinates on average; it is missed if fewer than
MATCHES agree (below 1e-6; far less for closer pairs). What is reported is always exact.

Null and empty texts have the empty set and are linked with nothing. Rows with a null id are not
linked either: their component is null and they are kept, copies of other rows or not. Repeated rows with one id get the same class. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relloom.llm import text as T
from relloom.llm.graph import Steps, components, extended, fresh
from relloom.session import materialise

COORDS = 64
MATCHES = 30
SIMILARITY = 75  # per cent
BLOCK = 4096

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(1, 2**63, COORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDS min-hashes of 32 bits; each coordinate orders the shingles by another hash."""
    out = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048]
        hashes = (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)
        np.minimum(out, hashes.min(axis=1).astype(np.uint32), out=out)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_key, sig): size, digest and signature of every row's shingle set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for _, rows, raw, at in T.slices(batch, "text"):
                _, _, first, h = T.lower_words(raw, at, T.NOT_SPACE)
                for r in range(rows):
                    s = np.unique(T.shingles(h[first[r] : first[r + 1]]))
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).astype(np.int64) if len(s) else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "set_key", "sig"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles bigint, set_key binary, sig array<bigint>")


def _postings(steps: Steps, classes: DataFrame) -> DataFrame:
    """Written table (id, key): the prefix of every class in the lists held by two or more."""
    posted = classes.select("id", F.posexplode("sig").alias("pos", "value")).select(
        "id", F.xxhash64("pos", "value").alias("key")
    )
    lists = steps.write("lists", posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = posted.join(lists, "key")
    rarest = W.partitionBy("id").orderBy("n", "key")
    placed = shared.select(
        "id", "key", F.row_number().over(rarest).alias("at"), F.count("*").over(W.partitionBy("id")).alias("m")
    )
    kept = placed.where(F.col("at") <= F.col("m") - (MATCHES - 1)).select("id", "key")
    return steps.write("postings", kept, done=("lists",))


def _confirmed(steps: Steps, pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Written links (a, b): the pairs whose signatures and then full sets are similar enough."""
    sigs = classes.select("id", "sig")
    a, b = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    close = steps.write(
        "close",
        pairs.join(a, "a").join(b, "b")
        .where(F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= MATCHES)
        .select("a", "b"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None  # pairs of one first document often follow each other
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, known = a, _set(batch, "text_a", i)
                other = _set(batch, "text_b", i)
                common = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * common >= SIMILARITY * (len(known) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = classes.schema["id"].dataType.simpleString()
    ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    full = close.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return steps.write("links", full.mapInArrow(run, f"a {kind}, b {kind}"), done=("close",))


def _set(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    [(_, _, raw, at)] = T.slices(batch.slice(row, 1), column)
    return np.unique(T.shingles(T.lower_words(raw, at, T.NOT_SPACE)[3]))


def _tried_first(postings: DataFrame) -> DataFrame:
    """(a, b): every member of a list with the list's first and last member."""
    heads = postings.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    both = postings.join(heads, "key")
    return (
        both.select("a", F.col("id").alias("b"))
        .unionByName(both.select(F.col("id").alias("a"), F.col("z").alias("b")))
        .where("a < b").distinct()
    )


def _shared(steps: Steps, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Written table (id, n, s): shingles of each member, and how many of them another one has too."""
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, raw, at in T.slices(batch, "text"):
                _, _, first, h = T.lower_words(raw, at, T.NOT_SPACE)
                sets = [np.unique(T.shingles(h[first[r] : first[r + 1]])) for r in range(rows)]
                sizes = [len(x) for x in sets]
                ids = batch.column(0).slice(row, rows).take(pa.array(np.repeat(np.arange(rows), sizes)))
                yield pa.record_batch(
                    [ids, pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(sizes, sizes), pa.int64())],
                    names=["id", "shingle", "n"],
                )

    rows = texts.join(members, "id", "left_semi").select("id", "text")
    posted = steps.write("posted", rows.mapInArrow(run, f"id {kind}, shingle bigint, n bigint"))
    known = posted.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    return steps.write("shared", posted.join(known, "shingle").groupBy("id", "n").agg(F.count("*").alias("s")), done=("posted",))


def _open(steps: Steps, postings: DataFrame, roots: DataFrame) -> DataFrame:
    """Written rows, with ``root``, of the lists that hold more than one component."""
    rooted = steps.write(
        "rooted",
        postings.join(roots, postings["id"] == roots["node"], "left").select(
            *postings.columns, F.coalesce("root", "id").alias("root")
        ),
    )
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return steps.write("open", rooted.join(several.select("key"), "key", "left_semi"), done=("rooted",))


#: The intersection of two sets has no shingle that only one member of all open lists holds. This
#: bounds their similarity from above: members with many edits of their own drop out.
_ABLE = f"100 * least(s_x, s_y) >= {SIMILARITY} * (n_x + n_y - least(s_x, s_y))"


def _named(rows: DataFrame, end: str) -> list:
    return ["key", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "root", "n", "s")]]


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _tried_centre(able: DataFrame) -> DataFrame:
    """(a, b): members of open lists with the list's member that has the fewest shingles of its own."""
    centre = able.groupBy("key").agg(
        F.max_by(F.struct("id", "root", "n", "s"), F.struct(F.col("s") / F.col("n"), "id")).alias("x")
    )
    centre = centre.select("key", "x.*")
    met = centre.select(*_named(centre, "x")).join(able.select(*_named(able, "y")), "key")
    return _pairs(met.where("root_x <> root_y").where(_ABLE))


def _once(steps: Steps, able: DataFrame) -> DataFrame:
    """Rows of one list only of those that hold the same members: copies share many coordinates."""
    lists = able.groupBy("key").agg(
        F.count("*").alias("c"), *[F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]
    )
    first = lists.groupBy("c", "h0", "h1").agg(F.min("key").alias("key")).select("key")
    return steps.write("once", able.join(first, "key", "left_semi"), done=("open",))


def _rest(steps: Steps, able: DataFrame, texts: DataFrame) -> DataFrame:
    """Written links (a, b) between a list's members in different components, on the full sets.

    Members outside a list's largest component are held against the list's other members. A list of
    more than ``BLOCK`` members is laid out as a grid of blocks, so a task holds two blocks at most; a
    pair is given only if it is a link. Of lists with the same members (by count and two 64-bit hash sums), one is used.
    """
    kind = able.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_set(batch, "text", i).tobytes() for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    able = _once(steps, able)
    members = able.select("id").distinct()
    whole = texts.join(members, "id", "left_semi").select("id", "text").mapInArrow(sets, f"id {kind}, shingles binary")
    sizes = able.groupBy("key", "root").agg(F.count("*").alias("c"))
    lists = sizes.groupBy("key").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"),
        F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"),
    )
    rows = able.join(lists, "key").join(steps.write("sets", whole), "id").select(
        "key", "id", "root", "shingles", "blocks", (F.col("root") != F.col("main")).alias("minor"),
        F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
    )
    across = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    common = ["key", "id", "root", "shingles", "minor"]
    cells = rows.select(*common, F.lit(False).alias("asks"), F.col("block").alias("i"), across.alias("j")).unionByName(
        rows.where("minor").select(*common, F.lit(True).alias("asks"), across.alias("i"), F.col("block").alias("j"))
    )

    def meet(cell: pa.Table) -> pa.Table:
        asks = cell["asks"].to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]
        roots, minor = cell["root"].to_numpy(), cell["minor"].to_numpy()
        size = np.array([len(x) for x in found])
        held = np.flatnonzero(~asks)
        links = []
        if len(held) and asks.any():
            every = np.concatenate([found[k] for k in held])
            owner = np.repeat(np.arange(len(held)), size[held])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            ids = cell["id"].to_pylist()
            for x in np.flatnonzero(asks):
                lo, hi = np.searchsorted(every, found[x], "left"), np.searchsorted(every, found[x], "right")
                count = hi - lo
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                common = np.bincount(owner[at], minlength=len(held))
                ok = 100 * common >= SIMILARITY * (size[x] + size[held] - common)
                for k in held[ok & (roots[held] != roots[x])]:
                    if not minor[k] or ids[x] < ids[k]:
                        links.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
        a, b = zip(*links, strict=True) if links else ((), ())
        id_type = cell.schema.field("id").type
        return pa.table({"a": pa.array(a, id_type), "b": pa.array(b, id_type)})

    links = cells.groupBy("key", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}").distinct()
    return steps.write("rest", links, done=("once", "sets"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (doc_id, n_shingles, component_id, kept) for every row; kept: the component's first id.

    What the steps in between wrote and shuffled is gone when it is there.
    """
    steps = Steps(docs.sparkSession)
    rows = steps.write("sketches", sketches(docs, id_col, text_col))
    sets = rows.where("id IS NOT NULL AND set_key IS NOT NULL")
    classes = steps.write(
        "classes", sets.groupBy("set_key").agg(F.min_by(F.struct("id", "sig"), "id").alias("x")).select("set_key", "x.*")
    )
    postings = _postings(steps, classes)
    members = postings.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = steps.write("texts", texts.join(members, "id", "left_semi").dropDuplicates(["id"]))
    links = _confirmed(steps, _tried_first(postings), classes, texts)
    roots = steps.write("roots", components(links), done=("links",))
    left = _open(steps, postings, roots)
    able = _shared(steps, left.select("id").distinct(), texts).where(f"100 * s >= {SIMILARITY} * n")
    left = steps.write("left", left.drop("root").join(able, "id"), done=("postings", "open", "shared"))
    roots = extended(roots, _confirmed(steps, _tried_centre(_open(steps, left, roots)), classes, texts))
    steps.drop("open", "links")
    roots = extended(roots, _rest(steps, _open(steps, left, roots), texts))
    of_class = classes.join(roots, classes["id"] == roots["node"], "left").select(
        "set_key", F.coalesce("root", "id").alias("component")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    found = rows.join(of_class, "set_key", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
    return steps.write("found", found, done=("sketches", "classes", "texts", "left", "roots", "rest"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; of rows with one id, one stays. Columns stay.

    Rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    name = fresh(docs, "gone")
    gone = materialise(found.where("NOT kept").select(F.col("doc_id").alias(name)).distinct())
    again = materialise(
        found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    )

    def without(rows: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.join(ids, rows[id_col] == ids[name], how)

    once = without(docs, gone.unionByName(again))
    repeated = without(without(docs, again, "left_semi"), gone).dropDuplicates([id_col])
    return once.unionByName(repeated)
