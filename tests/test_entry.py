import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.entry(s).count())
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 300" in out.stdout, out.stderr[-2000:]


def test_runs_without_the_subpackage(tmp_path):
    import shutil

    for part in ("spanwise", "__spark_entry__.py"):
        src = ROOT / part
        shutil.copytree(src, tmp_path / part) if src.is_dir() else shutil.copy(src, tmp_path / part)
    shutil.rmtree(tmp_path / "spanwise/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 40, any(n[0] == 'p' and n[1].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr[-2000:]
