"""Every registered query with SQL, against that SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quaere import plans

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    values = (tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in frame[columns].values.tolist())
    return sorted(values, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours, theirs = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stream(spark):
    assert plans.QUERIES["stream_topic_state"](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stream_is_read_to_its_end_with_all_subjects(spark, tmp_path, monkeypatch):
    import shutil

    from pyspark.sql.streaming import StreamingQuery

    for name in ("nation", "region", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    name = spark.read.parquet(f"{SF}/supplier.parquet").first().s_name
    said = [(c, k, "user", text) for c in range(40) for k, text in enumerate([f"Which country is {name} based in?", "and where?"])]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    wait = StreamingQuery.awaitTermination
    # a wait with a limit runs out at once
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    got = plans.QUERIES["stream_topic_state"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.topic) for r in got) == [(c, k, name) for c in range(40) for k in range(2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_replies_are_given_all_turns_and_documents(spark, monkeypatch):
    from quaere.operators import dialogue
    from quaere.plans import tables

    given = {}
    monkeypatch.setattr(dialogue, "respond", lambda turns, **more: given.update(more, turns=turns))
    plans.QUERIES["reply_route"](spark, SF)
    assert given["turns"].count() == tables.turns(spark, SF).count()
    assert given["documents"].count() == spark.read.parquet(f"{SF}/documents.parquet").count()
