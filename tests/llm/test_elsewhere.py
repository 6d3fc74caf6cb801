"""Workers find the package although they start in a folder that does not hold it."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pinfold.llm.decontamination import leaked_items
words = " ".join("w%d" % i for i in range(20))
docs = spark.createDataFrame([(1, words), (2, "x")], "doc_id long, text string")
items = spark.createDataFrame([(7, words)], "item_id long, text string")
print("FOUND", [tuple(r)[:2] for r in leaked_items(docs, items).collect()])
"""


def test_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "FOUND [(1, 7)]" in done.stdout, done.stderr[-2000:]
