"""The work folder of sessions with and without a preset checkpoint folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from locusweave.session import WORK_KEY, local_session, materialize, release, work_folder
spark = local_session("bare", "2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = materialize(spark.range(5))
folder = work_folder(spark)
assert folder == spark.conf.get(WORK_KEY) == work_folder(spark)
assert df.count() == 5 and df.inputFiles()[0].startswith("file:" + folder) or df.inputFiles()[0].startswith("file://" + folder)
release()
print("fine")
"""


def test_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr[-2000:]


def test_a_preset_folder_is_used(spark):
    from locusweave.session import WORK_KEY, work_folder

    preset = spark.conf.get("spark.checkpoint.dir", None)
    assert work_folder(spark) == (preset or spark.conf.get(WORK_KEY))
