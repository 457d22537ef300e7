"""Tables in the shared folder go when they are discarded or when the driver ends."""

import os
import subprocess
import sys

from rankweave.operators.shared import discard, materialize

SCRIPT = """
import os
import sys
from pyspark.sql import SparkSession
from rankweave.operators.shared import materialize
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print(materialize(spark.range(5), "five").count(), sum(f.startswith("five-") for f in os.listdir(sys.argv[1])))
spark.stop()
"""


def test_discarded_tables_are_gone(spark):
    df = materialize(spark.range(3), "three")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 3 and os.path.isdir(folder)
    discard(df)
    assert not os.path.exists(folder)


def test_tables_go_when_the_driver_ends(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300).stdout
    assert said.split()[-2:] == ["5", "1"] and not [f for f in os.listdir(tmp_path) if f.startswith("five-")]
