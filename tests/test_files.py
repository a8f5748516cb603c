"""Sources, sinks, whole jobs and streams."""

import gzip

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relloom.catalog import cleaning
from relloom.corpus import raw, relations, scored, spread, test_relations as unlabelled
from relloom.operators.evaluate import predict_labels
from relloom.plans import prepare as plans
from relloom.plans.config import Config
from relloom.plans.prepare import (
    ensemble_files, integer_tables, prepare, prepare_files, test_table as encode_test, training_rows, training_table,
)
from relloom.rules import special_tokens
from relloom.sources.relations import SCHEMAS, read_relations, read_stop_words, write_relations
from relloom.sources import runs
from relloom.sources.runs import checkpoint_score, name_weight, parse_probs, probs_text, read_runs
from relloom.streaming.clean_stream import clean_stream, stream_relations, write_stream
from tests.conftest import SF


def test_csv_keeps_quotes_commas_and_breaks(spark, tmp_path):
    texts = ['say "hi", then', "line one\nline two", "back\\slash", "", "plain"]
    rows = spark.createDataFrame(
        [(i, t, "{}", "{}", "no_relation", "web") for i, t in enumerate(texts)],
        "id long, sentence string, subject_entity string, object_entity string, label string, source string",
    )
    write_relations(rows, str(tmp_path / "c"))
    back = read_relations(spark, str(tmp_path / "c"))
    assert [r.sentence for r in back.orderBy("id").collect()] == texts
    assert back.columns == rows.columns


def test_bad_line_stops_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,sentence,subject_entity,object_entity,label,source\nx,a,b,c,d,e\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_relations(spark, str(tmp_path / "bad.csv")).collect()


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes("a\r\n b \r\n\r\na\r\ntwo words\r\n".encode())
    assert {r.word for r in read_stop_words(spark, str(tmp_path / "w.txt")).collect()} == {"a", "b", "two words"}


def test_runs(spark, tmp_path):
    body = "id,pred_label,probs\n1,no_relation,\"[0.1, 2e-05, 0.9]\"\n"
    name = "05-16_14.27.21_CJW_23_EP5____86.7762_.csv"
    (tmp_path / name).write_text(body)
    (tmp_path / ".hidden_1_.csv").write_text(body)
    (tmp_path / "epoch=4-f1=94.26291_80_.csv").write_text(body)
    rows = {r.run: r for r in read_runs(spark, str(tmp_path)).collect()}
    assert rows[name].weight == 86.7762
    assert rows[name].probs == [0.1, 2e-05, 0.9]
    assert len(rows) == 2
    assert rows["epoch=4-f1=94.26291_80_.csv"].checkpoint_score == "94.2629"


def test_names(spark):
    df = spark.createDataFrame([("a_1.5_.csv", "epoch=4-f1=94.2629.ckpt"), ("x.csv", "none")], "a string, b string")
    got = df.select(name_weight(F.col("a")), checkpoint_score(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.5, "94.2629"), (None, "")]


def test_probs_text_round_trip(spark):
    df = spark.createDataFrame([([0.1, 1e-7, 0.0],)], "probs array<double>")
    assert df.withColumn("probs", probs_text()).select(parse_probs()).first()[0] == [0.1, 1e-7, 0.0]


def test_ensemble_of_files(spark, tmp_path):
    rows = relations(spark, SF).select("id", "label_num")
    for run, weight in ((1, 86.0), (2, 87.5)):
        part = predict_labels(scored(rows, run)).select("id", "pred_label", probs_text().alias("probs"))
        part.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / f"r{run}"))
        source = next((tmp_path / f"r{run}").glob("part-*.csv"))
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"run{run}_{weight}_.csv").write_bytes(source.read_bytes())
    out = ensemble_files(spark, str(tmp_path / "all"))
    assert out.columns == ["id", "pred_label", "probs"]
    assert out.count() == rows.count()


def test_prepare_drops_copies_of_train_only(spark):
    rows = raw(relations(spark, SF)).limit(20)
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + 1_000_000_000))
    train, test = prepare(twice, twice)
    assert test.count() == 40
    assert train.count() == rows.dropDuplicates(["sentence", "subject_entity", "object_entity", "source", "label"]).count()


def test_prepare_files(spark, tmp_path):
    rows = raw(relations(spark, SF))
    write_relations(rows, str(tmp_path / "train"))
    write_relations(raw(unlabelled(spark, SF).withColumn("label", F.lit("100"))), str(tmp_path / "test"))
    prepare_files(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "new_test")).where("label = '100'").count() > 0


CONFIG = {
    "name": "n", "seed": 7,
    "train": {"test_size": 0.25, "token_max_len": 30, "no_valid": False, "adverse_valid": False, "batch_size": 32},
    "option": {"short_tokenizing": True},
    "select_DC": ["remove_duplicated", "add_only_punct"],
    "select_DA": None,
}


def test_config():
    cfg = Config.from_mapping(CONFIG)
    assert (cfg.seed, cfg.test_size, cfg.token_max_len, cfg.short_tokenizing) == (7, 0.25, 30, True)
    assert cfg.select_DA == [] and cfg.select_DC == CONFIG["select_DC"]


def parsed(spark):
    return relations(spark, SF).drop("label_num")


def test_training_table(spark):
    out = training_table(parsed(spark), Config.from_mapping(CONFIG))
    row = out.agg(
        F.min(F.size("tokens")).alias("lo"), F.max(F.size("tokens")).alias("hi"),
        F.count_if(F.col("split") == "valid").alias("valid"), F.count_if(F.col("label_num").isNull()).alias("none"),
    ).first()
    assert row.lo == row.hi == 30 and row.valid > 0 and row.none == 0
    assert "label" not in encode_test(parsed(spark).drop("label"), Config.from_mapping(CONFIG)).columns


@pytest.mark.parametrize("settings", [{"valid_split_beforehand": True}, {"augment_after_split": True}])
def test_augmented_rows_stay_out_of_valid(spark, settings):
    cfg = Config(select_DA=["swap_sentence"], **settings)
    out = training_rows(parsed(spark), cfg)
    assert out.groupBy("id").count().where("count > 1").count() == 0
    assert out.where("split = 'valid'").where("id <> origin_id").count() == 0
    assert out.where("split = 'train'").groupBy("origin_id").count().where("count > 1").count() > 0
    assert training_rows(parsed(spark), Config(no_valid=True)).where("split <> 'train'").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = relations(spark, SF).drop("label_num")
    steps = ["normalize_class", "add_entity_tokens_detail", "add_others_tokens"]
    batch = clean_stream(rows, steps).select("id", "sentence", "object_type")
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = clean_stream(stream_relations(spark, str(tmp_path / "in")), steps)
        write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "sentence", "object_type")
    assert sorted(got.collect()) == sorted(batch.collect())
    with pytest.raises(ValueError):
        clean_stream(rows, ["remove_duplicated"])
    words = spark.createDataFrame([("a",)], "word string")
    with pytest.raises(ValueError, match="stop_words"):
        clean_stream(rows, [("stop_words", {"stop_words": words})])
    assert clean_stream(rows, [("stop_words", {"stop_words": ["a"]})]).columns == rows.columns


def test_corpus_of_one_row_group_is_spread(spark, tmp_path):
    """A file of many splits whose rows are all in one row group gives work to all cores."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 10).alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = spark.read.parquet(str(tmp_path / "docs"))
        assert rows.rdd.getNumPartitions() >= cores
        placed = spread(rows, "doc_id")
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= cores and max(sizes) <= 2000 and sorted(placed.collect()) == sorted(rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(4000, numPartitions=cores).withColumnRenamed("id", "doc_id")
    assert spread(even, "doc_id") is even


def test_stream_query_splits_with_the_corpus(spark, monkeypatch):
    """The files of the stream are those of the corpus, not a fixed number of growing ones."""
    seen = []
    monkeypatch.setattr(cleaning, "stream_relations", lambda s, p, **k: seen.append(len(s.read.parquet(p).inputFiles())) or stream_relations(s, p, **k))
    out = cleaning.stream(spark, SF)
    assert out.count() == parsed(spark).count()
    assert seen[0] >= min(spark.sparkContext.defaultParallelism, len(relations(spark, SF).inputFiles())) > 4


def test_submissions_are_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "FILE_ROWS", 40)
    rows = spark.range(100, numPartitions=1).select(
        "id", F.lit("a").alias("pred_label"), F.array(F.col("id") / 7, F.lit(0.1)).alias("probs"))
    runs.write_submission(rows, str(tmp_path), "x_0.5_y")
    files = sorted((tmp_path / "run=x_0.5_y").glob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".csv.gz") for f in files)
    got = read_runs(spark, str(tmp_path), layout="folders")
    assert sorted(got.select("id", "pred_label", "probs").collect()) == sorted(rows.collect())


def test_submissions_are_compressed_fast(spark, tmp_path):
    """Files are what gzip's fastest level makes of their text, not the smaller ones of its usual level."""
    rows = spark.range(2000, numPartitions=1).select(
        "id", F.lit("a").alias("pred_label"), F.transform(F.sequence(F.lit(1), F.lit(30)), lambda c: (F.col("id") + c) / 2077).alias("probs"))
    runs.write_submission(rows, str(tmp_path), "x_0.5_y")
    (file,) = (tmp_path / "run=x_0.5_y").glob("part-*.csv.gz")
    text = gzip.decompress(file.read_bytes())
    fast, usual = (len(gzip.compress(text, level)) for level in (1, 6))
    assert abs(file.stat().st_size - fast) < abs(file.stat().st_size - usual)


def test_names_without_patterns(spark):
    """Facts in the name of a run are told for every row, so no pattern is matched there; odd names give what the patterns gave."""
    names = ["a_1.5_.csv", "x.csv", "_", "1_2", "__", "a__b", "_3_", "", None, "epoch=4-f1=94.26291_80_.csv", "=", "a=", "a=b=",
             "e=123456789_7_x", "=_=", "한=글글글글글글글글_2_", "a_b=c\n_d"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(checkpoint_score(F.col("n")), runs.name_field(F.col("n"))).collect()
    want = df.select(F.regexp_extract("n", "=([^=]{0,7})[^=]*$", 1), F.try_element_at(F.split("n", "_"), F.lit(-2))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    plan = df.select(checkpoint_score(F.col("n")), name_weight(F.col("n")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split" not in plan


def test_table_of_test_rows_alone(spark, monkeypatch):
    """The table to predict is the same without train rows being encoded, and kept columns are those asked for."""
    cfg = Config(token_max_len=20, vocab_size=50, select_DC=["remove_duplicated"])
    rows, test = parsed(spark), unlabelled(spark, SF)
    train, both = integer_tables(rows, test, cfg, keep=["id", "label", "split"])
    assert set(train.columns) == {"id", "label", "split", "label_num", "input_ids", "token_type_ids", "attention_mask"}
    whole, _ = integer_tables(rows, test, cfg)
    assert sorted(train.collect()) == sorted(whole.select(train.columns).collect())
    encoded = []
    real = plans.encode_tokens
    monkeypatch.setattr(plans, "encode_tokens", lambda *a: encoded.append(1) or real(*a))
    alone = plans.integer_test_table(rows, test, cfg)
    assert len(encoded) == 1
    assert sorted(alone.collect()) == sorted(both.collect())


def test_train_rows_are_scored_once(spark, monkeypatch):
    written = []
    real = plans.materialise
    monkeypatch.setattr(plans, "materialise", lambda df: written.append(df.columns) or real(df))
    plans.adversarial_split(parsed(spark).limit(500), unlabelled(spark, SF))
    assert any("prob_1" in c for c in written)


def test_stream_works_in_batches(spark, tmp_path):
    rows = relations(spark, SF).drop("label_num").select(*[f.split()[0] for f in SCHEMAS["parsed"].split(", ")])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = clean_stream(stream_relations(spark, str(tmp_path / "in"), max_files=1), ["strip_blanks"])
    running = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    running.awaitTermination()
    batches = [p for p in running.recentProgress if p["numInputRows"]]
    assert len(batches) == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_integer_tables(spark):
    cfg = Config(token_max_len=20, vocab_size=50, select_DC=["add_entity_tokens_base"])
    rows = parsed(spark)
    train, test = integer_tables(rows, unlabelled(spark, SF), cfg)
    got = train.collect()
    assert len({r.id for r in got}) == len(got) == rows.count()
    for r in got[:200]:
        n = sum(r.attention_mask)
        assert len(r.input_ids) == len(r.token_type_ids) == len(r.attention_mask) == 20
        assert all(x > 0 for x in r.input_ids[:n]) and not any(r.input_ids[n:]) and r.input_ids[0] == 2
    assert max(max(r.input_ids) for r in got) < 5 + 50 + len(special_tokens())
    assert test.count() == unlabelled(spark, SF).count() and "label_num" not in test.columns


def test_prepare_splits_files_without_breaks(spark, tmp_path):
    rows = raw(relations(spark, SF))
    for name in ("train", "test"):
        write_relations(rows, str(tmp_path / name))
    for multi in (True, False):
        prepare_files(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / f"out{multi}"), multi_line=multi)
    one, two = (spark.read.parquet(str(tmp_path / f"out{m}" / "new_train")) for m in (True, False))
    assert sorted(one.collect()) == sorted(two.collect())
