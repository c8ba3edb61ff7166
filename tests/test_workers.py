"""Python workers get no copy of this library: queries must run where only the driver can import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from recordloom.session import build_session
spark = build_session("workers", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}})
spark.sparkContext.setLogLevel("ERROR")
{imports}
for name in {names!r}:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, flush=True)
"""


def run_elsewhere(tmp_path, imports, names):
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT.format(repo=REPO, imports=imports, names=names))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split("\n")[:-1] == [f"{n} True" for n in names]


def test_queries_run_on_workers_without_the_library(tmp_path):
    run_elsewhere(tmp_path, "from recordloom.plans.catalog import QUERIES", ["duplicate_clusters", "duplicate_chips", "group_cards", "duplicate_pair_counts", "text_search"])
