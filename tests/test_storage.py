import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
from kbforge.functions.session import local_session
from kbforge.functions.storage import clear, materialize, shared_dir

spark = local_session(1, "1g", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_dir(spark)
rows = materialize(spark.range(10), "t")
assert rows.count() == 10 and shared_dir(spark) == first and all(first in f for f in rows.inputFiles())
clear(spark)
print("fine")
"""


def test_a_local_session_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=Path(__file__).parents[1], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]
