"""Cleaning steps over relation rows and the chain that runs them in config order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom import rules
from relloom.functions.arrays import explode_once, let
from relloom.functions.text import after, between, words
from relloom.operators.dedup import drop_listed
from relloom.operators.parse import parse_entities
from relloom.session import lookup, materialise

# A table of stop words up to this size travels inside the expression, in so many slots.
LISTED = 20_000
SLOTS = 4096
# So do the most frequent words of a corpus when names are looked up, and those of them that are names.
FREQUENT = 100_000
FREQUENT_SLOTS = 1 << 15


def _type_word(column: str) -> Column:
    code = F.col(column)
    word = rules.literal_map(rules.TYPE_WORDS)[code]
    return F.coalesce(word, F.raise_error(F.concat(F.lit("type without a word: "), code)))


def _tags(style: str) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """(opening, closing) tag of the subject and of the object."""
    if style == "base":
        pair = (F.lit("[ENT] "), F.lit(" [/ENT] "))
        return pair, pair
    if style == "typed":
        return tuple(
            (F.concat(F.lit(f"[{r}:"), F.col(c), F.lit("] ")), F.concat(F.lit(f" [/{r}:"), F.col(c), F.lit("] ")))
            for r, c in (("S", "subject_type"), ("O", "object_type"))
        )
    if style == "punct":
        return tuple(
            (F.concat(F.lit(f" {outer} {inner} "), _type_word(c), F.lit(f" {inner} ")), F.lit(f" {outer} "))
            for outer, inner, c in (("@", "*", "subject_type"), ("#", "^", "object_type"))
        )
    raise ValueError(f"unknown tag style {style!r}")


def mark_entities(df: DataFrame, style: str = "base") -> DataFrame:
    """Put tags round both entities: ``base``, ``typed`` or ``punct``.

    Offsets are 0-based and inclusive. Overlapping spans leave the sentence as it is and
    set ``span_ok`` to false.
    """
    s = F.col("sentence")
    starts = [F.col("subject_start_idx"), F.col("object_start_idx")]
    ends = [F.col("subject_end_idx"), F.col("object_end_idx")]
    first, second = (F.least(*starts), F.least(*ends)), (F.greatest(*starts), F.greatest(*ends))
    (s_open, s_close), (o_open, o_close) = _tags(style)
    object_last = ends[1] > ends[0]

    def pick(if_object_last: Column, otherwise: Column) -> Column:
        return F.when(object_last, if_object_last).otherwise(otherwise)

    marked = F.concat(
        between(s, F.lit(0), first[0] - 1),
        pick(s_open, o_open), between(s, *first), pick(s_close, o_close),
        between(s, first[1] + 1, second[0] - 1),
        pick(o_open, s_open), between(s, *second), pick(o_close, s_close),
        after(s, second[1]),
    )
    ok = second[0] > first[1]
    return df.withColumns({"sentence": F.when(ok, marked).otherwise(s), "span_ok": ok})


def query_prefix(df: DataFrame, typed: bool = False) -> DataFrame:
    """Put the question about both entities before the sentence, with type words or codes."""
    subject, obj = (
        (F.col("subject_type"), F.col("object_type"))
        if typed
        else (_type_word("subject_type"), _type_word("object_type"))
    )
    prefix = F.concat(
        F.lit("@ * "), subject, F.lit(" * "), F.col("subject_entity"),
        F.lit(" @와 # ^ "), obj, F.lit(" ^ "), F.col("object_entity"), F.lit(" #의 관계 [SEP] "),
    )
    return df.withColumn("sentence", F.concat(prefix, F.col("sentence")))


def normalize_types(df: DataFrame) -> DataFrame:
    """Bring entity types in line with the label.

    An object type the label does not accept becomes the label's own one; the subject type
    follows the label's prefix.
    """
    allowed = F.create_map(
        *[x for label, (types, _) in rules.OBJECT_TYPE_RULES.items()
          for x in (F.lit(label), F.array(*[F.lit(t) for t in types]))]
    )
    change = rules.literal_map({label: into for label, (_, into) in rules.OBJECT_TYPE_RULES.items()})
    label = F.col("label")
    # A missing type is not among the allowed ones; labels without a rule allow any.
    wrong = allowed[label].isNotNull() & ~F.coalesce(F.array_contains(allowed[label], F.col("object_type")), F.lit(False))
    subject = F.when(label.startswith("per"), "PER").when(label.startswith("org"), "ORG")
    return df.withColumns(
        {
            "object_type": F.when(wrong, change[label]).otherwise(F.col("object_type")),
            "subject_type": F.coalesce(subject, F.col("subject_type")),
        }
    )


def replace_foreign(df: DataFrame, pattern: str = rules.FOREIGN) -> DataFrame:
    """Each run of kana or Han signs becomes ``[OTH]``."""
    return df.withColumn("sentence", F.regexp_replace("sentence", pattern, "[OTH]"))


def remove_stop_words(
    df: DataFrame, stop_words: Sequence[str] | DataFrame, tokens: str | None = None
) -> DataFrame:
    """Drop listed words and join the rest by blanks; words are blank-separated or a tokens column.

    A sequence is a hash set inside the expression. A table is written and counted: up to ``LISTED``
    words it becomes a hash table inside the expression, beyond that it is joined with the exploded words
    and the rest is put together again by ``id``, which must be unique. Null words of either are no words,
    and a null sentence stays null.
    """
    parts = F.col(tokens) if tokens else words(F.col("sentence"))
    if isinstance(stop_words, DataFrame):
        listed = lookup(stop_words.select(F.col(stop_words.columns[0]).alias("_word")).dropna().distinct())
        if listed.count() > LISTED:
            return _remove_by_join(df, listed, parts)
        kept = F.filter(parts, lambda x: ~F.array_contains(F.get("_table", _slot(x)), x))
        rows = df.withColumn("_table", _table(listed)).withColumn("sentence", F.array_join(kept, " "))
        return rows.select(*df.columns)
    stop_words = [w for w in stop_words if w is not None]
    if not stop_words:
        return df.withColumn("sentence", F.array_join(parts, " "))
    kept = F.filter(parts, lambda x: ~x.isin(*stop_words))
    return df.withColumn("sentence", F.array_join(kept, " "))


def _slot(word: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")


def _table(listed: DataFrame, slots: int = SLOTS) -> Column:
    """A short list as an array of as many arrays as there are slots, each word in the one of its hash."""
    filled = listed.groupBy(_slot(F.col("_word"), slots).alias("_slot")).agg(F.collect_list("_word").alias("_words"))
    every = listed.sparkSession.range(slots).select(F.col("id").cast("int").alias("_slot")).join(filled, "_slot", "left")
    words_ = F.coalesce("_words", F.array().cast("array<string>")).alias("_words")
    return every.agg(F.sort_array(F.collect_list(F.struct("_slot", words_))).alias("t")).select("t._words").scalar()


def _remove_by_join(df: DataFrame, listed: DataFrame, parts: Column) -> DataFrame:
    # Rows placed by id: if Spark finds the list small, words are gathered where they are.
    exploded = explode_once(df.repartition("id"), ["id"], parts, "_pos", "_word")
    kept = (
        exploded.join(listed, "_word", "left_anti")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_word"))).alias("_kept"))
        .select("id", F.array_join(F.col("_kept._word"), " ").alias("_text"))
    )
    text = F.when(parts.isNotNull(), F.coalesce(F.col("_text"), F.lit(""))).alias("sentence")
    return df.join(kept, "id", "left").select(
        *[text if c == "sentence" else F.col(c) for c in df.columns]
    )


def strip_blanks(df: DataFrame) -> DataFrame:
    return df.withColumn("sentence", F.replace("sentence", F.lit(" "), F.lit("")))


def mask_entities(df: DataFrame, style: str = "base") -> DataFrame:
    """Replace tagged entities by their mask; needs ``mark_entities`` of the same style first."""
    s = F.col("sentence")
    if style == "base":
        found = F.regexp_extract_all(s, F.lit(r"\[ENT\][^\n]+?\[/ENT\]"), F.lit(0))
        subject_first = F.col("subject_start_idx") < F.col("object_start_idx")
        one = F.when(subject_first, "[SUB]").otherwise("[OBJ]")
        two = F.when(subject_first, "[OBJ]").otherwise("[SUB]")
        masked = F.replace(F.replace(s, F.get(found, F.lit(0)), one), F.get(found, F.lit(1)), two)
        return df.withColumns(
            {
                "sentence": F.coalesce(masked, s),
                "subject_entity": F.lit("[SUB]"),
                "object_entity": F.lit("[OBJ]"),
            }
        )
    if style == "typed":
        for role in "SO":
            s = F.regexp_replace(s, rf"(\[{role}:[^\n]+?\])[^\n]+?\[/{role}:[^\n]+?\]", "$1")
        masked = df.withColumn("sentence", s)
        return masked.withColumns(
            {
                f"{name}_entity": F.regexp_extract("sentence", rf"\[{name[0].upper()}:[^\n]+?\]", 0)
                for name in ("subject", "object")
            }
        )
    raise ValueError(f"unknown mask style {style!r}")


def flag_kana(df: DataFrame) -> DataFrame:
    """Flags for texts that hold kana in need of transliteration."""
    return df.withColumns(
        {f"{c}_kana": F.col(c).rlike(rules.KANA_SIGN) for c in ("sentence", "subject_entity", "object_entity")}
    )


def person_names(df: DataFrame) -> DataFrame:
    """Distinct person entities of a corpus: the name list for ``mask_other_persons``."""
    both = F.array(
        *[F.when(F.col(f"{r}_type") == "PER", F.col(f"{r}_entity")) for r in ("subject", "object")]
    )
    name = df.select(F.explode(both).alias("name")).where("name IS NOT NULL AND name <> ''")
    return name.distinct()


def _most_frequent(words_: DataFrame) -> DataFrame:
    """(_word) of FREQUENT words at most, those that stand most often.

    Where to cut is told by how many words stand how often, so no task sorts all words; words that stand as often as those
    that the cut would part are all left out.
    """
    counts = materialise(words_.groupBy("_word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kinds = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(FREQUENT)
    cut, taken = None, 0
    for n, more in kinds.collect():
        taken += more
        if taken > FREQUENT:
            break
        cut = n
    return counts.where(F.col("n") >= F.lit(cut)).select("_word")


def mask_other_persons(df: DataFrame, names: DataFrame) -> DataFrame:
    """Replace listed names outside the two tagged entities by ``[PER]``; the tags go away.

    Names are matched on whole blank-separated words, the longest one first from the left. A
    stream of candidates carries no sentence: for each word its place, and for each place and number of
    words above one that a name has, the hash of that many words. It is joined with the names and their hashes,
    so work and shuffle grow with the words alone, however many names begin with the same word. The ``FREQUENT``
    words that stand most often in the corpus, which are most of all places, do not go into the stream: they are counted first
    (``_most_frequent``), and which of them are names travels inside the expression. Hits come back to their row by ``id``, which must be
    unique, and are held against its text there. The list grows with the corpus: Spark broadcasts it
    or not by its written size.
    """
    names = names.select("name").where("name <> ''").distinct()
    listed = lookup(names.select("name", F.split("name", " ").alias("_name")).select(
        "name", F.size("_name").alias("n"), F.xxhash64("_name").alias("_hash")))
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())
    pieces = F.split("sentence", r" ?\[ENT\] ?| ?\[/ENT\] ?")
    texts = explode_once(df, ["id", "subject_entity", "object_entity"], pieces, "piece", "text")
    texts = texts.where("text <> subject_entity AND text <> object_entity").select("id", "piece", F.split("text", " ").alias("_words"))
    places, common = [], None
    if 1 in lengths:
        words_ = explode_once(texts, ["id", "piece"], F.col("_words"), "pos", "name")
        single = listed.where("n = 1").drop("_hash")
        most = _most_frequent(words_.select(F.col("name").alias("_word")))
        common = _table(lookup(most.join(single, F.col("_word") == F.col("name"), "left_semi")), FREQUENT_SLOTS)
        rare = words_.where(~F.array_contains(F.get(_table(most, FREQUENT_SLOTS), _slot(F.col("name"), FREQUENT_SLOTS)), F.col("name")))
        places.append(rare.join(single, "name"))
    if lengths and lengths[-1] > 1:
        several = F.concat(
            *[F.expr(f"""if(size(_words) < {n}, array(), transform(sequence(0, size(_words) - {n}),
                           i -> named_struct('pos', i, 'n', {n}, '_hash', xxhash64(slice(_words, i + 1, {n})))))""")
              for n in lengths if n > 1]
        )
        starts = explode_once(texts, ["id", "piece"], several, "_i", "_at").select("id", "piece", "_at.*")
        places.append(starts.join(listed, ["n", "_hash"]))
    if not places:
        return df.withColumn("sentence", F.array_join(pieces, " "))
    found = reduce(DataFrame.unionByName, [p.select("id", "piece", "pos", "n", "name") for p in places])
    hit = F.struct("piece", "pos", (-F.col("n")).alias("less"), "name")
    hits = found.groupBy("id").agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
    rows = df.join(hits, "id", "left")
    if common is not None:
        # Named once below, so Spark puts the table into the expression; a column of its own would be copied for each row.
        rows = rows.withColumn("_common", common)

    def chosen(texts: Column) -> Column:
        """Left to right, longest first; a name that starts inside a taken one is skipped."""

        def real(h: Column) -> Column:
            return F.array_join(F.slice(F.split(F.get(texts, h["piece"]), " "), h["pos"] + 1, -h["less"]), " ") == h["name"]

        def take(acc: Column, h: Column) -> Column:
            one = F.struct(h["piece"].alias("piece"), h["pos"].alias("pos"), (-h["less"]).alias("n"))
            more = F.struct(
                h["piece"].alias("piece"), (h["pos"] - h["less"]).alias("free"), F.concat(acc["taken"], F.array(one)).alias("taken")
            )
            return F.when((h["piece"] == acc["piece"]) & (h["pos"] < acc["free"]), acc).otherwise(more)

        none = F.array().cast("array<struct<piece:int,pos:int,n:int>>")
        start = F.struct(F.lit(-1).alias("piece"), F.lit(0).alias("free"), none.alias("taken"))
        found = F.aggregate(F.filter("_hits", real), start, take, lambda acc: acc["taken"])
        return F.when(F.col("_hits").isNull(), none).otherwise(found)

    def plain(p: Column, w: Column) -> Column:
        """A frequent word is masked if it is a name; a single word is in no other name's way."""
        if common is None:
            return w
        own = F.coalesce((p == F.col("subject_entity")) | (p == F.col("object_entity")), F.lit(True))
        known = F.array_contains(F.get("_common", _slot(w, FREQUENT_SLOTS)), w) & F.col("id").isNotNull() & ~own
        return F.when(known, "[PER]").otherwise(w)

    def masked(texts: Column, taken: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            def word(w: Column, k: Column) -> Column:
                # array_join leaves out NULL: the words behind the first one of a name.
                starts = F.exists(taken, lambda t: (t["piece"] == i) & (t["pos"] == k))
                inside = F.exists(taken, lambda t: (t["piece"] == i) & (k > t["pos"]) & (k < t["pos"] + t["n"]))
                return F.when(starts, "[PER]").when(~inside, w)

            hit = F.exists(taken, lambda t: t["piece"] == i)
            rest = F.transform(F.split(p, " "), lambda w: plain(p, w))
            return let(rest, lambda m: F.array_join(F.when(hit, F.transform(m, word)).otherwise(m), " "))

        return F.array_join(F.transform(texts, piece), " ")

    rebuilt = let(pieces, lambda texts: let(chosen(texts), lambda taken: masked(texts, taken)))
    return rows.select(*[rebuilt.alias(c) if c == "sentence" else F.col(c) for c in df.columns])


Step = Callable[..., DataFrame]
# Step names a cleaning list may hold.
STEPS: dict[str, Step] = {
    "entity_parsing": parse_entities,
    "normalize_class": normalize_types,
    "flag_kana": flag_kana,
    "remove_duplicated": drop_listed,
    "add_entity_tokens_base": lambda df: mark_entities(df, "base"),
    "add_entity_tokens_detail": lambda df: mark_entities(df, "typed"),
    "add_only_punct": lambda df: mark_entities(df, "punct"),
    "quering_with_punct": query_prefix,
    "quering_with_detail": lambda df: query_prefix(df, typed=True),
    "add_others_tokens": replace_foreign,
    "stop_words": remove_stop_words,
    "strip_blanks": strip_blanks,
    "entity_mask_base": lambda df: mask_entities(df, "base"),
    "entity_mask_detail": lambda df: mask_entities(df, "typed"),
    "dc_change_per_others": mask_other_persons,
}
TRAIN_ONLY = {"remove_duplicated"}
NEED_LABEL = {"normalize_class"}
# Steps that look at whole groups or other tables; all others work row by row.
NOT_ROWWISE = {"remove_duplicated", "dc_change_per_others"}


def register_step(name: str, step: Step) -> None:
    """Add a cleaning step of one's own under a name usable in configs."""
    STEPS[name] = step


def clean(df: DataFrame, steps: Sequence[str | tuple[str, dict]] = (), train: bool = False) -> DataFrame:
    """Run the listed steps in order; a step is a name or (name, arguments).

    Steps for training rows only are left out unless ``train``; steps that need labels are
    left out where there are none.
    """

    def run(rows: DataFrame, step: str | tuple[str, dict]) -> DataFrame:
        name, args = (step, {}) if isinstance(step, str) else step
        if name not in STEPS:
            raise ValueError(f"unknown cleaning step {name!r}")
        if not train and name in TRAIN_ONLY or name in NEED_LABEL and "label" not in rows.columns:
            return rows
        return STEPS[name](rows, **args)

    return reduce(run, steps, df)
