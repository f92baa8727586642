"""Queries in sessions of their own: no checkpoint folder set, another working folder, executors in other processes."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
b = SparkSession.builder.master({master!r}).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
for k, v in {conf!r}.items():
    b = b.config(k, v)
spark = b.getOrCreate()
import __spark_entry__ as entry
for name in {names!r}:
    print("ROWS", name, entry.queries()[name](spark, {data!r}).count())
"""


def spark_home(folder):
    """A Spark home of its own: links to the installed one, with a real folder for the workers' files."""
    import pyspark

    home = folder / "home"
    (home / "work").mkdir(parents=True, exist_ok=True)
    for entry in os.listdir(installed := os.path.dirname(pyspark.__file__)):
        if entry != "work" and not (home / entry).is_symlink():
            (home / entry).symlink_to(f"{installed}/{entry}")
    return str(home)


def run(folder, master, names, conf=None):
    """Rows per query, in a new process without settings of this machine."""
    (folder / "conf").mkdir(exist_ok=True)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")} | {"SPARK_CONF_DIR": str(folder / "conf"), "SPARK_HOME": spark_home(folder), "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, master=master, names=names, data=DATA, conf=conf or {})], cwd=folder, env=env | {"PYTHONPATH": extra_path()}, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    return {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("ROWS")}


def extra_path():
    """Folders of modules that aren't installed, without this repository."""
    return os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT))


def test_plain_local_session(tmp_path):
    assert run(tmp_path, "local[4]", ["auction_rebuild", "alerts_told_once"]) == {"auction_rebuild": 1500, "alerts_told_once": 2}


def test_executors_elsewhere(tmp_path):
    got = run(tmp_path, "local-cluster[2,1,1024]", ["parse_filings"], {"spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.executor.memory": "1g"})
    assert got == {"parse_filings": 1500}
