"""The entry without the training-data folder, and with its bytecode left behind."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_without_training_data_folder(tmp_path, leftover):
    shutil.copytree(ROOT / "quirework", tmp_path / "quirework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover:
        (tmp_path / "quirework/llm/__pycache__").mkdir(parents=True)
        (tmp_path / "quirework/llm/__pycache__/registry.cpython-313.pyc").write_bytes(b"")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()), len(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-500:]


@pytest.mark.parametrize("blocked", ["public_tokenizers", "tokenizers"])
def test_entry_without_what_training_data_needs(tmp_path, blocked):
    """What the optional part imports is missing: the other queries stay, and the reason is logged."""
    (tmp_path / f"{blocked}.py").write_text(f"raise ModuleNotFoundError('no {blocked}', name='{blocked}')")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; from quirework.plans.queries import QUERIES; assert set(QUERIES) <= set(e.queries()); print(len(e.queries()) - len(QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
    if (ROOT / "quirework/llm/registry.py").exists() and blocked == "public_tokenizers":
        assert done.stdout.strip() == "0" and "no public_tokenizers" in done.stderr
