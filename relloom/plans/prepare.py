"""The jobs of a relation corpus, each one plan of DataFrame steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.adversarial import adversarial_scores
from relloom.operators.augment import augment
from relloom.operators.clean import clean
from relloom.operators.dedup import dedup
from relloom.operators.ensemble import ensemble_submission
from relloom.operators.parse import encode_labels, parse_entities
from relloom.operators.split import no_split, score_split, stratified_split
from relloom.operators.tokens import build_vocab, encode_tokens, pad_truncate, pair_input
from relloom.plans.config import Config
from relloom.rules import PAD, RESERVED, special_tokens
from relloom.session import lookup, materialise
from relloom.sources.relations import read_relations, write_relations
from relloom.sources.runs import read_runs


def prepare(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows -> parsed rows; exact copies go, from the train side only, before parsing."""
    return parse_entities(dedup(train)), parse_entities(test)


def prepare_files(
    spark: SparkSession, train_path: str, test_path: str, out_path: str, fmt: str = "parquet", multi_line: bool = True
) -> None:
    """Raw CSV files in, ``new_train`` and ``new_test`` out.

    ``multi_line=False`` splits large files between tasks; their texts must hold no line breaks.
    """
    raw = [read_relations(spark, path, multi_line=multi_line) for path in (train_path, test_path)]
    parts = prepare(*raw)
    for name, rows in zip(("new_train", "new_test"), parts):
        write_relations(rows, f"{out_path}/{name}", fmt)


def split_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    if cfg.no_valid:
        return no_split(rows)
    if cfg.adverse_valid:
        return score_split(rows, test_size=0.2)
    return stratified_split(rows, test_size=cfg.test_size, seed=cfg.seed)


def training_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    """Clean, augment and split parsed rows; column ``split`` tells the parts apart.

    As a rule augmentation precedes the split. ``valid_split_beforehand`` splits first, and
    valid rows then get neither the steps for training rows nor augmentation;
    ``augment_after_split`` keeps only augmented rows out of the valid part.
    """
    if cfg.valid_split_beforehand or cfg.augment_after_split:
        if not cfg.valid_split_beforehand:
            rows = materialise(clean(rows, cfg.select_DC, train=True))
        parts = split_rows(rows, cfg)
        train, valid = parts.where("split = 'train'"), parts.where("split = 'valid'")
        if cfg.valid_split_beforehand:
            train, valid = clean(train, cfg.select_DC, train=True), clean(valid, cfg.select_DC)
        more = augment(train, cfg.select_DA)
        if "origin_id" in more.columns:
            valid = valid.withColumn("origin_id", F.col("id"))
        return more.unionByName(valid)
    # A split reads its input more than once, so what was cleaned is written first.
    return split_rows(materialise(augment(clean(rows, cfg.select_DC, train=True), cfg.select_DA)), cfg)


def encoded_rows(rows: DataFrame, cfg: Config) -> DataFrame:
    """Token arrays, segment ids and masks, cut and padded."""
    return pad_truncate(pair_input(rows, single=cfg.short_tokenizing), cfg.token_max_len)


def training_table(rows: DataFrame, cfg: Config) -> DataFrame:
    """Parsed rows -> encoded train and valid rows with label numbers."""
    return encode_labels(encoded_rows(training_rows(rows, cfg), cfg))


def test_table(rows: DataFrame, cfg: Config) -> DataFrame:
    return encoded_rows(clean(rows, cfg.select_DC), cfg)


def fitted_vocab(rows: DataFrame, cfg: Config) -> DataFrame:
    """Vocabulary of the train part of ``training_rows``: reserved tokens, frequent ones, tags."""
    tokens = pair_input(rows.where("split = 'train'"), single=cfg.short_tokenizing)
    return lookup(build_vocab(tokens, size=cfg.vocab_size, tags=special_tokens()))


def integer_rows(
    rows: DataFrame, vocab: DataFrame, cfg: Config, part: str | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Rows with ``input_ids``, ``token_type_ids`` and ``attention_mask``, padded to the longest row of their part.

    ``keep``: the columns that go on, ``id`` and ``part`` among them; all, if it is not given.
    """
    tokens = pair_input(rows, single=cfg.short_tokenizing)
    cut = tokens.withColumns({c: F.slice(c, 1, cfg.token_max_len) for c in ("tokens", "segment_ids")})
    if keep is not None:
        cut = cut.select(*keep, "tokens", "segment_ids")
    # An encoding explodes the rows, so they are not encoded again to find the longest one.
    ids = materialise(encode_tokens(cut, vocab, cfg.vocab_size + len(special_tokens())).drop("tokens"))
    padded = pad_truncate(ids, cfg.token_max_len, "input_ids", F.lit(RESERVED.index(PAD)), part)
    return padded.withColumnRenamed("segment_ids", "token_type_ids")


def fitted_rows(train: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Training rows and the vocabulary of their train part."""
    rows = training_rows(train, cfg)
    if cfg.valid_split_beforehand or cfg.augment_after_split:
        # Otherwise they are a split of rows that are written already.
        rows = materialise(rows)
    return rows, fitted_vocab(rows, cfg)


def integer_tables(
    train: DataFrame, test: DataFrame, cfg: Config, keep: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parsed train and test rows -> the tables a model reads, by one vocabulary fitted on the train part.

    The first holds train and valid rows (``split``) with label numbers, each part padded on its own; ``keep``: the
    columns of its rows that go on, ``id``, ``label`` and ``split`` among them; all, if it is not given.
    """
    rows, vocab = fitted_rows(train, cfg)
    return (
        encode_labels(integer_rows(rows, vocab, cfg, "split", keep)),
        integer_rows(clean(test, cfg.select_DC), vocab, cfg),
    )


def integer_test_table(train: DataFrame, test: DataFrame, cfg: Config) -> DataFrame:
    """The second of ``integer_tables`` alone: train rows are not encoded for it."""
    _, vocab = fitted_rows(train, cfg)
    return integer_rows(clean(test, cfg.select_DC), vocab, cfg)


def adversarial_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Score train rows by their likeness to test rows, then split on that score."""
    # The split reads its input more than once, so rows are scored once and written.
    return score_split(materialise(adversarial_scores(train, test)))


def ensemble_files(
    spark: SparkSession, path: str, layout: str = "files", expected: int | None = None
) -> DataFrame:
    """Folder of prediction files -> one submission table; an id that a run lacks or repeats is an error."""
    return ensemble_submission(read_runs(spark, path, layout), expected=expected)
