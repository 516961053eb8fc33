"""The entry points with and without the parts that may be taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [["wavecairn/llm", "tests/llm"], ["corpus_pipeline.py"], ["wavecairn/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_works_without(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "metastore_db", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    public = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.abspath(p) != ROOT]
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env | {"PYTHONPATH": ":".join(public)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, operators, pipeline = out.stdout.split()
    has_llm = (copy / "wavecairn/llm").exists()
    assert pipeline == "False" and int(operators) == 10 * has_llm and int(total) >= 50
