"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values()) and all(isinstance(s, str) for s in o.values())


def test_without_training_data(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q, any(n[:2] == 'op' and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1:] == ["False", "False"]


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(HERE, "kinledger")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        text = f.read()
                    assert "kinledger.llm" not in text and "corpus_pipeline" not in text


def test_flagship(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() == 321
