"""Scratch tables and folders go when the driver ends; what jobs write stays."""

import os
import subprocess
import sys
import time
from pathlib import Path

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from marlstone.session import new_folder, scratch_folder, written
assert written(spark.range(5)).count() == 5
spark.range(3).write.parquet(scratch_folder(spark))
spark.range(3).write.parquet(new_folder(spark, "stays"))
"""


def test_scratch_goes_with_the_driver(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    for _ in range(60):  # the JVM ends a little later than Python
        left = [p.name for p in tmp_path.iterdir() if p.name.startswith("marlstone-")]
        if not left:
            break
        time.sleep(1)
    assert left == [] and sum(p.name.startswith("stays-") for p in tmp_path.iterdir()) == 1
