"""Segments with lines across splits, and a stream that fails between its batches."""

import duckdb
import pytest

from memlake.plans import streams
from memlake.plans.registry import Tables
from memlake.streaming import events as E

DATA = "/root/testdata/sf0.001"


def said(name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return sorted(con.execute(streams.ORACLES[name]).fetchall())


def test_lines_across_splits_are_read_once(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = streams.QUERIES["segment_files"](spark, DATA)
        got = sorted(map(tuple, out.collect()))
        parts = [p for p in out.inputFiles()]
        lines = spark.read.option("recursiveFileLookup", "true").text(parts)
        assert lines.rdd.getNumPartitions() > 3 * len(parts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == said("segment_files") and sum(r[2] for r in got) > 0


def test_a_stream_that_fails_goes_on_from_its_checkpoint(spark, tmp_path):
    runs = []

    def failing(path):
        write = E.append_once(path)

        def once(batch, batch_id):
            runs.append(batch_id)
            if len(runs) == 3:
                write(batch.limit(1), batch_id)  # half a batch is there when it fails
                raise RuntimeError("lost")
            write(batch, batch_id)

        return once

    with pytest.raises(Exception, match="lost"):
        streams.last_states(Tables(spark, DATA), str(tmp_path), failing)
    failed = runs[-1]
    out = streams.last_states(Tables(spark, DATA), str(tmp_path), failing)
    assert runs[3] == failed and len(runs) > 4
    got = sorted(map(tuple, out.collect()))
    assert got == said("review_timers_streamed") and len({s for _, s in got}) > 1
