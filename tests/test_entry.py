"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(x.startswith('op') or x == 'pipeline' for x in q))"


def within(folder) -> dict[str, str]:
    """The environment with the copy first on the path, and what was on it behind."""
    return os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (str(folder), os.environ.get("PYTHONPATH")) if x)}


def shown(folder) -> list[int]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, env=within(folder))
    assert out.returncode == 0, out.stderr
    return [int(x) for x in out.stdout.split()]


def test_entry_without_corpus_operators(tmp_path):
    """Any part of them may be missing; the other queries stay."""
    whole = tmp_path / "whole"
    shutil.copytree(TOP, whole, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    plain = sum(1 for _ in __import__("wattline.plans.queries", fromlist=["QUERIES"]).QUERIES)
    shutil.rmtree(whole / "wattline" / "llm", ignore_errors=True)
    assert shown(whole) == [plain, 0]
    (whole / "corpus_pipeline.py").unlink(missing_ok=True)
    shutil.rmtree(whole / "tests" / "llm", ignore_errors=True)
    assert shown(whole) == [plain, 0]
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_sources.py::test_sql_options", "tests/test_streaming.py::test_supervisor", "tests/test_job.py::test_ddl_twice", "tests/test_contract.py"], cwd=whole, capture_output=True, text=True, env=within(whole))
    assert found.returncode == 0, found.stdout + found.stderr
