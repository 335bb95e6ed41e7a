"""The shared folder, and components, in sessions set up in other ways than the tests' own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PLAIN = """
from cohortry.session import local_session
from cohortry.llm.common import Written, shared_dir
from cohortry.llm.line_dedup import drop_common_lines

spark = local_session(2, "plain", "2g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark)
df = spark.createDataFrame([(i, f"all\\n{i}") for i in range(12)], "doc_id long, text string")
assert {r["n_dropped"] for r in drop_common_lines(df).collect()} == {1}
print("ok")
"""


def test_a_session_without_a_shared_folder(tmp_path):
    """An empty configuration folder names no checkpoint folder, as a plain local install."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "COHORTRY_SHUFFLE": "2"}
    got = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert got.stdout.strip().endswith("ok"), got.stderr[-2000:]


def test_other_masters_must_name_one():
    from cohortry.llm.common import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "a"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
    Session.sparkContext.master = "local[3]"
    assert os.path.isdir(shared_dir(Session())) and shared_dir(Session()) == shared_dir(Session())
