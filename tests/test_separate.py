"""The binding-data part stands without the text operators and their pipeline."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_text_operators(tmp_path):
    for name in (x for x in ("bindframe", "__spark_entry__.py", "corpus_pipeline.py") if os.path.exists(f"{REPO}/{x}")):
        (shutil.copytree if os.path.isdir(f"{REPO}/{name}") else shutil.copy)(f"{REPO}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "bindframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
