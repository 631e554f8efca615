"""Tables written once have an owner: after the command line has written its results none is left."""

from __future__ import annotations

import os
import subprocess
import sys

import pyarrow.parquet as pq

from tallyforge.sources import shared


def test_clear_written_deletes_what_was_written(spark):
    shared.clear_written(spark)
    table = shared.written_once(spark.range(5), "some")
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 5 and os.path.isdir(path)
    assert shared.clear_written(spark) == 1 and not os.path.exists(path)
    assert shared.clear_written(spark) == 0


def test_command_line_leaves_no_tables(sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    scratch = tmp_path / "scratch"
    scratch.mkdir()
    code = f"import sys; from pyspark.sql import SparkSession; SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', 'file://{scratch}').config('spark.sql.shuffle.partitions', '2').getOrCreate(); from tallyforge.__main__ import main; sys.exit(main(sys.argv[1:]))"
    env = dict(os.environ, PYTHONPATH=os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x))
    run = subprocess.run([sys.executable, "-c", code, sf_dir, str(tmp_path / "out"), "leaderboard", "model_boosting"], capture_output=True, text=True, env=env, cwd=root, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert pq.read_table(tmp_path / "out" / "leaderboard").num_rows == 4
    assert [p for p in scratch.rglob("*.parquet")] == []
