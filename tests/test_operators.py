"""Properties and brute-force checks of operators over whole groups, including hot ones."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relloom import rules
from relloom.operators import augment as aug
from relloom.operators import dedup as dd
from relloom.operators import ensemble as en
from relloom.operators import evaluate as ev
from relloom.operators import profile as pr
from relloom.operators import split as sp
from relloom.operators import tokens as tk
from relloom.operators.adversarial import adversarial_scores, fit_origin, origin_weights, pair_text
from relloom.operators.ranking import ranked, running_totals
from relloom.sources.runs import submission
from tests.conftest import no_broadcast


@pytest.fixture(scope="module")
def hot(spark):
    """6,000 rows; one label holds a third of them, and one sentence a sixth."""
    draw = random.Random(7)
    rows = []
    for i in range(6000):
        label = rules.LABELS[5] if i % 3 == 0 else draw.choice(rules.LABELS)
        text = "same old words" if i % 6 == 0 else f"w{draw.randrange(900)} meets w{draw.randrange(30)}"
        rows.append((i * 13 % 6007, text, label, draw.randrange(50) / 50))
    return spark.createDataFrame(rows, "id long, sentence string, label string, prob_1 double").withColumns(
        {"subject_entity": F.split("sentence", " ")[0], "object_entity": F.split("sentence", " ")[2],
         "source": F.lit("web")}
    )


def local(df):
    return [r.asDict() for r in df.collect()]


def test_ranks(hot):
    got = {r["id"]: (r["rn"], r["rn_total"]) for r in local(ranked(hot, ["label"], [F.col("prob_1").desc(), F.col("id").asc()]))}
    groups = defaultdict(list)
    for r in local(hot):
        groups[r["label"]].append((-r["prob_1"], r["id"]))
    want = {id_: (k + 1, len(g)) for g in groups.values() for k, (_, id_) in enumerate(sorted(g))}
    assert got == want


def test_running_totals_without_group(hot):
    rows = local(running_totals(hot, [], [F.col("id").asc()], {"t": F.col("id")}))
    total = 0
    for r in sorted(rows, key=lambda r: r["id"]):
        total += r["id"]
        assert r["t"] == total
    assert {r["t_total"] for r in rows} == {total}


def test_a_hot_group_spreads_over_tasks(spark, hot):
    """The rank of one label is computed in several parts of similar size."""
    placed = hot.repartitionByRange(8, F.col("label").asc(), F.col("id").asc())
    sizes = Counter(
        r.part for r in placed.where(F.col("label") == rules.LABELS[5]).select(F.spark_partition_id().alias("part")).collect()
    )
    assert len(sizes) >= 3 and max(sizes.values()) < 0.7 * sum(sizes.values())


def test_stratified_split(hot):
    rows = local(sp.stratified_split(hot))
    groups = defaultdict(list)
    for r in rows:
        groups[r["label"]].append((hashlib.md5(f"42:{r['id']}".encode()).hexdigest(), r["id"], r["split"]))
    assert len(rows) == 6000
    for g in groups.values():
        cut = math.floor(len(g) * 0.2 + 0.5)
        assert [s for *_, s in sorted(g)] == ["valid"] * cut + ["train"] * (len(g) - cut)


@pytest.mark.parametrize("parts", [1, 13])
def test_split_does_not_depend_on_partitions(spark, hot, parts):
    want = {r["id"] for r in local(sp.stratified_split(hot).where("split = 'valid'"))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["id"] for r in local(sp.stratified_split(hot.repartition(parts)).where("split = 'valid'"))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_split_of_single_rows_and_nothing(hot):
    one = hot.where("id = 13").unionByName(hot.where("id = 26"))
    assert {r["split"] for r in local(sp.stratified_split(one))} <= {"train"}
    assert sp.stratified_split(hot.where("id < 0")).count() == 0
    assert sp.score_split(hot.where("id < 0")).count() == 0
    assert sp.random_split(hot.where("id < 0")).count() == 0


def test_random_split_size(hot):
    counts = Counter(r["split"] for r in local(sp.random_split(hot, 0.3)))
    assert counts == {"valid": 1800, "train": 4200}


@pytest.mark.parametrize("digits, most", [(1, 3), (2, 40), (4, 50_000)])
def test_cut_buckets_stay_small(hot, monkeypatch, digits, most):
    """However few digits a round tells apart, the ranked bucket is bounded and the rows are the same."""
    want = {r["id"] for r in local(sp.stratified_split(hot).where("split = 'valid'"))}
    plain = {r["id"] for r in local(sp.random_split(hot).where("split = 'valid'"))}
    monkeypatch.setattr(sp, "DIGITS", digits)
    monkeypatch.setattr(sp, "EDGE_ROWS", most)
    assert {r["id"] for r in local(sp.stratified_split(hot).where("split = 'valid'"))} == want
    assert {r["id"] for r in local(sp.random_split(hot).where("split = 'valid'"))} == plain
    narrow = hot.select("label", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("_key"))
    for strata in (["label"], []):
        edges, _ = sp.edge_buckets(narrow, strata, F.round(F.col("n") * 0.2))
        assert edges.agg(F.max("_rows")).first()[0] <= most


def test_copies_of_an_id_stay_together(spark, monkeypatch):
    monkeypatch.setattr(sp, "EDGE_ROWS", 2)
    rows = spark.createDataFrame([(7, "a")] * 50 + [(k, "a") for k in range(100, 110)], "id long, label string")
    out = local(sp.stratified_split(rows, test_size=0.5))
    assert len(out) == 60 and len({r["split"] for r in out if r["id"] == 7}) == 1


def test_score_split(hot):
    groups = defaultdict(lambda: defaultdict(list))
    for r in local(sp.score_split(hot)):
        groups[r["label"]][r["split"]].append((-r["prob_1"], r["id"]))
    for g in groups.values():
        n = len(g["valid"]) + len(g["train"])
        assert len(g["valid"]) == int(n * 0.2)
        assert not g["valid"] or max(g["valid"]) < min(g["train"])


def test_all_scores_tied(hot):
    tied = hot.withColumn("prob_1", F.lit(0.5))
    valid = sp.score_split(tied).where("split = 'valid'").count()
    assert valid == sum(int(n * 0.2) for n in Counter(r["label"] for r in local(hot)).values())


def test_attach_scores_needs_both_sides(hot):
    scores = hot.select("id", F.lit(0.5).alias("p"))
    assert sp.attach_scores(hot, scores).where("p = 0.5").count() == 6000
    with pytest.raises((PySparkException, Py4JJavaError)):
        sp.attach_scores(hot, scores.where("id <> 13")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        sp.attach_scores(hot.where("id <> 13"), scores).collect()


# Duplicates, by brute force.
KEYS = ["sentence", "subject_entity", "object_entity"]


def by_key(rows, keys):
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(r[k] for k in keys)].append(r["id"])
    return groups


@pytest.mark.parametrize("keys", [KEYS, dd.EXACT])
def test_duplicates(hot, keys):
    groups = by_key(local(hot), keys).values()
    ids = lambda df: {r["id"] for r in local(df)}
    assert ids(dd.dedup(hot, keys)) == {min(g) for g in groups}
    assert ids(dd.dedup(hot, keys, keep="last")) == {max(g) for g in groups}
    assert ids(dd.duplicates(hot, keys)) == {i for g in groups if len(g) > 1 for i in g}
    assert ids(dd.duplicates(hot, keys, "first")) == {i for g in groups for i in g if i != min(g)}
    assert ids(dd.duplicates(hot, keys, "last")) == {i for g in groups for i in g if i != max(g)}


def test_conflicts_shuffle_digests(spark):
    """Texts that differ in where they part, and nulls, are keys of their own; no sentence is shuffled for the conflicts."""
    rows = [(1, "ab", "c", "d", "x"), (2, "a", "bc", "d", "y"), (3, None, "c", "d", "x"), (4, None, "c", "d", "y"),
            (5, "", "c", "d", "x"), (6, "-", "c", "d", "y"), (7, "ab", "c", "d", "z")]
    df = spark.createDataFrame(rows, "id long, sentence string, subject_entity string, object_entity string, label string")
    found = dd._conflict_ids(df)
    assert {r.id for r in found.collect()} == {1, 3, 4, 7}
    assert "sentence" not in found.columns


def test_conflicts(hot):
    rows = local(hot)
    three, four = by_key(rows, KEYS), by_key(rows, [*KEYS, "label"])
    label = {r["id"]: r["label"] for r in rows}
    size = Counter(label.values())
    key = {r["id"]: tuple(r[k] for k in KEYS) for r in rows}
    want = {i for i in label if len(three[key[i]]) > 1 and len(four[(*key[i], label[i])]) == 1}
    assert {r["id"] for r in local(dd.label_conflicts(hot))} == want
    groups = defaultdict(list)
    for i in want:
        groups[key[i]].append((size[label[i]], label[i], i))
    kept = set(label) - want | {min(g)[2] for g in groups.values()}
    assert {r["id"] for r in local(dd.resolve_conflicts(hot))} == kept


def test_dedup_limits_groups_before_the_shuffle(hot):
    plan = dd.dedup(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# Augmentation.
def test_swap_twice_is_the_identity(rows_of):
    rows = rows_of([(1, "a x b y", "x", "y", "per:children"), (2, "c y d x", "y", "x", "per:spouse")])
    swapped = aug.swap_relations(rows)
    assert [r.label for r in swapped.orderBy("id").collect()] == ["per:parents", "per:spouse"]
    assert sorted(aug.swap_relations(swapped).collect()) == sorted(rows.collect())
    moved = aug.swap_relations(rows, swap_spans=True).orderBy("id").first()
    assert (moved.subject_start_idx, moved.object_start_idx, moved.subject_type) == (6, 2, "ORG")


def test_exchange_replaces_all_and_in_order(rows_of):
    rows = rows_of(
        [(i, f"s{i} o{i} s{i} end", f"s{i}", f"o{i}", "per:title", "PER", "POH") for i in range(1, 6)]
        + [(9, "s9 . o9", "s9", "o9", "no_relation", "PER", "POH")]
    )
    out = {r.id: r for r in aug.exchange_pairs(rows).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    assert out[1].sentence == "s5 o5 s5 end"
    assert out[3].sentence == "s3 o3 s3 end"
    assert (out[4].subject_entity, out[4].object_entity) == ("s2", "o2")


def test_exchange_is_literal(rows_of):
    rows = rows_of([(1, "a.c x abc", "a.c", "x", "per:title", "PER", "POH"), (2, "q+ $1", "q+", "$1", "per:title", "PER", "POH")])
    out = {r.id: r.sentence for r in aug.exchange_pairs(rows).collect()}
    assert out == {1: "q+ $1 abc", 2: "a.c x"}


def test_augment_appends(rows_of):
    rows = rows_of([(1, "a x b y", "x", "y", "per:spouse", "PER", "POH")])
    assert aug.augment(rows, ["swap_sentence", "sub_obj_change_augment"]).count() == 3
    with pytest.raises(ValueError):
        aug.augment(rows, ["no_such_step"])


# Scores.
@pytest.fixture(scope="module")
def predictions(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        w = [draw.choice([1, 1, 2, 5]) for _ in range(30)]
        rows.append((i, draw.randrange(29), [x / sum(w) for x in w]))
    return spark.createDataFrame(rows, "id long, label_num int, probs array<double>")


def area_by_hand(scores, hits):
    """Trapezoids under the curve, one point per distinct score."""
    if not any(hits):
        return 0.0
    area, tp, seen, r0, p0 = 0.0, 0, 0, 0.0, 1.0
    for s in sorted(set(scores), reverse=True):
        tp += sum(h for x, h in zip(scores, hits) if x == s)
        seen += scores.count(s)
        r, p = tp / sum(hits), tp / seen
        area += (r - r0) * (p + p0) / 2
        r0, p0 = r, p
    return area


def test_auprc(predictions):
    rows = local(predictions)
    got = {r["c"]: r["auprc"] for r in local(ev.class_auprc(predictions))}
    want = {
        c: area_by_hand([r["probs"][c] for r in rows], [r["label_num"] == c for r in rows]) for c in range(30)
    }
    assert got == pytest.approx(want)
    assert want[29] == 0
    assert ev.auprc(predictions).first().auprc == pytest.approx(sum(want.values()) / 30 * 100)


@pytest.mark.parametrize("bins", [1, 7, 256])
def test_binned_area_bounds_the_exact_one(predictions, bins):
    exact = {r["c"]: r["auprc"] for r in local(ev.class_auprc(predictions))}
    halves = [predictions.where(F.col("id") % 2 == k) for k in (0, 1)]
    merged = ev.score_histogram(halves[0], bins).unionByName(ev.score_histogram(halves[1], bins))
    merged = merged.groupBy("c", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    assert merged.count() <= 30 * bins
    got = {r["c"]: r for r in local(ev.binned_auprc(merged))}
    for c, area in exact.items():
        assert got[c]["low"] - 1e-12 <= area <= got[c]["high"] + 1e-12
        assert got[c]["low"] - 1e-12 <= got[c]["auprc"] <= got[c]["high"] + 1e-12
    one = ev.auprc(predictions, bins=bins).first()
    assert one.auprc == pytest.approx(sum(r["auprc"] for r in got.values()) / 30 * 100)
    assert ev.evaluate(predictions, bins=bins).first().auprc == pytest.approx(one.auprc)
    if bins == 256:
        assert one.auprc == pytest.approx(ev.auprc(predictions).first().auprc, abs=1.5)


def test_metrics_agree(predictions):
    scored = ev.predict_labels(predictions)
    rows = local(scored)
    assert all(r["pred"] == r["probs"].index(max(r["probs"])) for r in rows)
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in local(ev.confusion(scored))}
    seen = {r["label_num"] for r in rows} | {r["pred"] for r in rows}
    assert len(cells) == len(seen) ** 2
    assert sum(cells.values()) == len(rows)
    diagonal = sum(n for (t, p), n in cells.items() if t == p)
    assert ev.accuracy(scored).first().accuracy == pytest.approx(diagonal / len(rows))
    tp = sum(n for (t, p), n in cells.items() if t == p and t)
    fp = sum(n for (t, p), n in cells.items() if t != p and p)
    fn = sum(n for (t, p), n in cells.items() if t != p and t)
    assert ev.micro_f1(scored).first().micro_f1 == pytest.approx(200 * tp / (2 * tp + fp + fn))
    bundle = ev.evaluate(predictions).first()
    assert bundle.micro_f1 == pytest.approx(ev.micro_f1(scored).first().micro_f1)


def test_losses_by_hand(predictions):
    types = predictions.withColumns({"subject_type": F.lit("PER"), "object_type": F.lit("DAT")})
    logits = types.withColumn("logits", F.transform("probs", lambda p: F.log(p) * 2 + 1))
    rows = local(logits)
    allowed = rules.TYPE_RULES["PER", "DAT"]

    def lse(x):
        return math.log(sum(math.exp(v) for v in x))

    def losses(r):
        x, y = r["logits"], r["label_num"]
        ce = lse(x) - x[y]
        focal = 0.5 * (1 - math.exp(-ce)) ** 2 * ce
        above = 0 if y == 0 else lse([x[0], x[y]]) - x[y]
        below = lse([v for c, v in enumerate(x) if c == 0 or c != y]) - x[0]
        bce = [math.log(1 + math.exp(v)) - (v if c == y else 0) for c, v in enumerate(x) if c not in allowed]
        return {"ce": ce, "focal": focal, "threshold": above + below, "penalty": sum(bce) / 30}

    each = [losses(r) for r in rows]
    for kind in each[0]:
        want = sum(e[kind] for e in each) / len(each)
        assert ev.loss_audit(logits, kind).first().loss == pytest.approx(want)
    smooth = sum(0.9 * e["ce"] + 0.1 / 30 * sum(lse(r["logits"]) - v for v in r["logits"]) for e, r in zip(each, rows))
    assert ev.loss_audit(logits, "ce", smoothing=0.1).first().loss == pytest.approx(smooth / len(rows))
    with pytest.raises(ValueError):
        ev.loss_audit(logits, "no such loss")


def test_softmax(predictions):
    logits = predictions.withColumn("logits", F.transform("probs", lambda p: F.log(p) + 700))
    for r in local(ev.add_probs(logits.withColumnRenamed("probs", "want"))):
        assert r["probs"] == pytest.approx(r["want"])


def test_ensemble(predictions):
    one = predictions.withColumn("weight", F.lit(3.0))
    assert all(
        r["probs"] == pytest.approx(p["probs"])
        for r, p in zip(local(en.ensemble(one).orderBy("id")), local(predictions.orderBy("id")))
    )
    flipped = predictions.select("id", F.reverse("probs").alias("probs"), F.lit(1.0).alias("weight"))
    both = one.select("id", "probs", "weight").unionByName(flipped)
    p = local(predictions.where("id = 5"))[0]["probs"]
    got = local(en.ensemble(both).where("id = 5"))[0]["probs"]
    assert got == pytest.approx([(3 * a + b) / 4 for a, b in zip(p, p[::-1])])
    with pytest.raises((PySparkException, Py4JJavaError)):
        en.check_probs(predictions.withColumn("probs", F.slice("probs", 1, 29))).collect()


def test_divergence(predictions):
    two = predictions.select("id", F.reverse("probs").alias("probs"))
    kl = lambda a, b: sum(x * math.log(x / y) for x, y in zip(a, b))
    want = sum((kl(r["probs"], r["probs"][::-1]) + kl(r["probs"][::-1], r["probs"])) / 2 for r in local(predictions))
    assert ev.run_divergence(predictions, two).first().divergence == pytest.approx(want)


def test_adversarial_scores(rows_of):
    train = rows_of(
        [(i, f"river stone p{i} q{i}", f"p{i}", f"q{i}", "no_relation") for i in range(60)]
        + [(i, f"comet orbit p{i} q{i}", f"p{i}", f"q{i}", "no_relation") for i in range(60, 80)]
    )
    test = rows_of([(i, f"comet orbit r{i} s{i}", f"r{i}", f"s{i}", "no_relation") for i in range(40)])
    scores = {r["id"]: r["prob_1"] for r in local(adversarial_scores(train, test))}
    assert len(scores) == 80
    assert min(scores[i] for i in range(60, 80)) > max(scores[i] for i in range(60))


# Profiles.
def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(3,), (3,)], "v int")
    out = local(pr.histogram(df, F.col("v"), 4).orderBy("bin"))
    assert [r["n"] for r in out] == [0, 0, 2, 0]
    assert (out[0]["lower"], out[-1]["upper"]) == (2.5, 3.5)


def test_first_match(spark):
    df = spark.createDataFrame([("a12b3",), ("x",), ("12",)], "sentence string")
    assert {r["match"]: r["n"] for r in local(pr.match_counts(df, "[0-9]+"))} == {"12": 2}


# Tokens.
def test_drop_tokens(spark):
    words = ["[CLS]", "first"] + [f"w{i}" for i in range(20)] + ["[ENT]", "z]"]
    df = spark.createDataFrame([(1, words), (2, words[:5])], "id long, tokens array<string>")
    out = {r["id"]: r["tokens"] for r in local(tk.drop_tokens(df, budget=10))}
    assert len(out[1]) == 10 and out[2] == words[:5]
    assert out[1][:2] == words[:2] and out[1][-2:] == words[-2:]
    assert [w for w in words if w in out[1]] == out[1]
    assert len(local(tk.drop_tokens(df, budget=1))[0]["tokens"]) == 4


def test_mask_tokens(spark):
    df = spark.createDataFrame([(i, [2] + [10 + i % 5] * 200 + [3]) for i in range(50)], "id long, input_ids array<int>")
    rows = local(tk.mask_tokens(df, vocab_size=100))
    asked = changed = total = 0
    for r in rows:
        assert r["target_ids"][0] == r["target_ids"][-1] == -100
        for x, m, t in zip(r["input_ids"][1:-1], r["masked_ids"][1:-1], r["target_ids"][1:-1]):
            total += 1
            assert t in (x, -100) and (t == x or m == x)
            asked += t == x
            changed += m == 4
    assert 0.13 < asked / total < 0.17
    assert 0.75 < changed / asked < 0.85


def test_encode_without_broadcast(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"]), (3, [])], "id long, tokens array<string>")
    vocab = tk.build_vocab(df, size=2)
    want = [(1, [5, 6, 5]), (2, [1]), (3, [])]
    assert sorted((r["id"], r["input_ids"]) for r in local(tk.encode_tokens(df, vocab, 2))) == want
    with no_broadcast(spark):
        assert sorted((r["id"], r["input_ids"]) for r in local(tk.encode_tokens(df, vocab, 2))) == want


def test_cut_and_markers(spark):
    df = spark.createDataFrame(
        [(1, ["a", "[SEP]", "b", "[SEP]", "c"]), (2, ["a", "b"]), (3, ["[ENT]", "x", "[ENT]"])],
        "id long, tokens array<string>",
    )
    cut = {r["id"]: r["tokens"] for r in local(tk.cut_at_separator(df))}
    assert cut == {1: ["a", "[SEP]", "b"], 2: ["a", "b"], 3: ["[ENT]", "x", "[ENT]"]}
    marks = {r["id"]: (r["first_marker"], r["second_marker"]) for r in local(tk.marker_positions(df))}
    assert marks == {1: (0, 0), 2: (0, 0), 3: (0, 2)}


def test_augmented_rows_have_their_own_ids(rows_of):
    rows = rows_of([(i, "a x b y", "x", "y", "per:spouse") for i in range(4)])
    out = aug.augment(rows, ["swap_sentence", "swap_sentence"]).collect()
    assert len({r.id for r in out}) == len(out) == 12
    assert sorted(r.origin_id for r in out) == sorted(3 * [0, 1, 2, 3])


def test_incomplete_runs_are_errors(spark):
    even = [1 / 30] * 30
    runs = spark.createDataFrame([(1, even, 2.0), (1, even, 1.0), (2, even, 1.0)], "id long, probs array<double>, weight double")
    assert en.ensemble(runs).count() == 2
    with pytest.raises(Exception, match="not in all runs"):
        en.ensemble(runs, expected=2).collect()
    none = spark.createDataFrame([(1, even, None)], "id long, probs array<double>, weight double")
    with pytest.raises(Exception, match="no weight"):
        en.ensemble(none).collect()
    sample = spark.createDataFrame([(1,), (2,)], "id long")
    one = spark.createDataFrame([(1, "a", even)], "id long, pred_label string, probs array<double>")
    with pytest.raises(Exception, match="no prediction"):
        submission(sample, one).collect()


def test_divergence_of_zero_probabilities(spark):
    def run(rows):
        return spark.createDataFrame(rows, "id long, probs array<double>")

    one = run([(1, [0.0, 1.0])])
    assert ev.run_divergence(one, one).first().divergence == 0
    assert ev.run_divergence(one, run([(1, [0.5, 0.5])])).first().divergence == float("inf")
    with pytest.raises(Exception, match="only one run"):
        ev.run_divergence(one, run([(2, [0.0, 1.0])])).collect()


def test_runs_must_be_complete(spark):
    even = [1 / 30] * 30

    def runs(*pairs):
        return spark.createDataFrame([(r, i, even, 1.0) for r, i in pairs], "run string, id long, probs array<double>, weight double")

    whole = runs(("a", 1), ("a", 2), ("b", 1), ("b", 2))
    assert en.ensemble(whole).count() == 2 and en.ensemble_submission(whole).count() == 2
    for broken in (runs(("a", 1), ("a", 2), ("b", 1)), runs(("a", 1), ("a", 1), ("b", 1)), runs(("a", 1), ("a", 1))):
        with pytest.raises(Exception, match="not in all runs exactly once"):
            en.ensemble_submission(broken).collect()
    with pytest.raises(Exception, match="not in all runs"):
        en.ensemble(whole, expected=3).collect()


def test_divergence_from_logits(spark):
    def run(*logits):
        return spark.createDataFrame([(i, x) for i, x in enumerate(logits)], "id long, logits array<double>")

    one, two = run([0.0, -800.0, 1.0]), run([0.0, 5.0, 1.0])

    def logs(x):
        z = max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
        return [v - z for v in x]

    a, b = logs([0.0, -800.0, 1.0]), logs([0.0, 5.0, 1.0])
    want = sum((math.exp(p) - math.exp(q)) * (p - q) for p, q in zip(a, b)) / 2
    assert want > 300
    assert ev.logit_divergence(one, two).first().divergence == pytest.approx(want)
    assert ev.logit_divergence(one, one).first().divergence == 0
    # From probabilities, the same row is infinitely far: exp(-801) is 0.
    probs = [ev.add_probs(x) for x in (one, two)]
    assert ev.run_divergence(*probs).first().divergence == float("inf")
    never = run([0.0, float("-inf"), 1.0])
    assert ev.logit_divergence(never, never).first().divergence == 0
    assert ev.logit_divergence(never, one).first().divergence == float("inf")
    with pytest.raises(Exception, match="only one run"):
        ev.logit_divergence(run([1.0]), run([1.0], [2.0])).collect()


def test_scores_follow_from_the_weights(rows_of):
    train = rows_of([(i, f"river stone p{i} q{i}", f"p{i}", f"q{i}", "no_relation") for i in range(30)])
    test = rows_of([(i, f"comet orbit r{i} s{i}", f"r{i}", f"s{i}", "no_relation") for i in range(30)])
    model = fit_origin(train, test)
    weights = {r.place: r.weight for r in origin_weights(model, train.sparkSession).collect()}
    for r in model.transform(pair_text(train)).select("features", "probability").collect():
        x = weights[-1] + sum(weights.get(int(k), 0.0) * v for k, v in zip(r.features.indices, r.features.values))
        assert r.probability[1] == pytest.approx(1 / (1 + math.exp(-x)))
    got = {r["id"]: r["prob_1"] for r in local(adversarial_scores(train, test))}
    assert all(0 <= p <= 1 for p in got.values()) and len(got) == 30


def test_token_report_scans_once(hot):
    report = tk.token_report(hot)
    rows = local(hot)
    for r in local(report):
        texts = [x["sentence"].split(" ") if r["tokenizer"] == "blank" else list(x["sentence"]) for x in rows]
        counts = Counter(t for ts in texts for t in ts)
        lengths = sorted(len(t) for t in texts)
        assert r["distinct_tokens"] == len(counts) and r["rows"] == len(rows)
        assert r["top_tokens"] == [t for t, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:10]]
        assert r["words_median"] == (lengths[2999] + lengths[3000]) / 2 and r["words_max"] == lengths[-1]
    odd = hot.sparkSession.createDataFrame([("a b",), ("",), (None,)], "sentence string")
    assert {r["tokenizer"]: (r["rows"], r["distinct_tokens"]) for r in local(tk.token_report(odd))} == {"blank": (3, 3), "character": (3, 3)}


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_medians(spark, n):
    draw = random.Random(n)
    rows = [(draw.random() if k % 3 else None, float(draw.randrange(3)), None) for k in range(n)]
    got = {r.name: r.median for r in pr.medians(
        spark.createDataFrame(rows, "a double, b double, c double"), a=F.col("a"), b=F.col("b"), c=F.col("c")).collect()}
    for k, name in enumerate("ab"):
        values = sorted(r[k] for r in rows if r[k] is not None)
        assert got.get(name) == (pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2) if values else None)
    assert "c" not in got


def test_augmenting_twice_is_an_error(rows_of):
    rows = rows_of([(1, "a x b y", "x", "y", "per:spouse")])
    once = aug.augment(rows, ["swap_sentence"])
    with pytest.raises(Exception, match="augmented already"):
        aug.augment(once.drop("origin_id"), ["swap_sentence"]).collect()


def test_special_tokens():
    tokens = rules.special_tokens()
    assert len(tokens) == len(set(tokens)) == 51
    assert tokens[11:13] == ["[S:PER]", "[/S:PER]"]
    assert len(rules.LABELS) == 30 and len(rules.TYPE_RULES) == 12 and len(rules.OBJECT_TYPE_RULES) == 24
