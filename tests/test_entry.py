"""The entry point when the training-data operators can't be imported."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; from palimpsest.plans.registry import queries; q = e.queries(); print(len(q) - len(queries()), len(set(e.oracle_sql()) - set(q)))"
HIDE = "import sys; sys.modules['regex'] = None\n"


def counts(folder, before=""):
    return subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True, timeout=120).stdout.split()


@pytest.fixture
def checkout(tmp_path):
    for name in ("palimpsest", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    return tmp_path


def test_without_the_folder(checkout):
    shutil.rmtree(checkout / "palimpsest/llm", ignore_errors=True)
    assert counts(checkout) == ["0", "0"]


def test_with_what_a_cache_left_behind(checkout):
    shutil.rmtree(checkout / "palimpsest/llm", ignore_errors=True)
    (checkout / "palimpsest/llm/__pycache__").mkdir(parents=True)
    assert counts(checkout) == ["0", "0"]


def test_without_a_library(checkout):
    assert counts(checkout, HIDE) in (["0", "0"], ["10", "0"])
