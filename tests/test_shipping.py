"""The workers find the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.checkpoint.dir", sys.argv[3]).config("spark.executor.memory", "900m").getOrCreate())
print("ROWS", entry.queries()["row_fidelity"](spark, sys.argv[2]).count())
"""


def test_row_fidelity_runs_from_another_folder_without_a_path(tmp_path, sf_dir):
    home = tmp_path / "empty"
    home.mkdir()
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    command = [sys.executable, "-c", CODE, ROOT, sf_dir, str(shared)]
    said = []
    for _ in range(2):  # once more where the JVM itself did not come up; its own output is shown
        run = subprocess.run(command, cwd=home, env=env, capture_output=True, text=True, timeout=300)
        said.append(f"exit {run.returncode}\n{run.stdout}\n{run.stderr}")
        if "Py4JNetworkError" not in run.stderr and "JAVA_GATEWAY_EXITED" not in run.stderr:
            break
    assert "ROWS 1473" in run.stdout, "\n".join(said)[-6000:]
