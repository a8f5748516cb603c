import contextlib
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@contextlib.contextmanager
def no_broadcast(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "relloom-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


PARSED = (
    "id long, sentence string, subject_entity string, subject_start_idx int, subject_end_idx int,"
    " subject_type string, object_entity string, object_start_idx int, object_end_idx int,"
    " object_type string, label string, source string"
)


@pytest.fixture(scope="session")
def rows_of(spark):
    """Parsed rows from (id, sentence, subject, object, label[, types]); spans by first occurrence."""

    def build(rows):
        out = []
        for row in rows:
            id_, sentence, subject, obj, label, *types = row
            s_type, o_type = types or ("PER", "ORG")
            s, o = sentence.index(subject), sentence.index(obj)
            out.append(
                (id_, sentence, subject, s, s + len(subject) - 1, s_type,
                 obj, o, o + len(obj) - 1, o_type, label, "web")
            )
        return spark.createDataFrame(out, PARSED)

    return build
