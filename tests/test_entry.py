import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import shutil, sys
root, to = sys.argv[1:]
shutil.copytree(root + "/framequery", to + "/framequery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
shutil.copy(root + "/__spark_entry__.py", to)
sys.path.insert(0, to)
import __spark_entry__ as e
assert e.__file__.startswith(to) and not e.HAS_LLM
assert len(e.queries()) > 40 and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_stands_without_the_corpus_operators(tmp_path):
    done = subprocess.run([sys.executable, "-c", WITHOUT, str(ROOT), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_stands_with_a_hollow_folder(tmp_path):
    """What is left of a deleted folder may be no more than compiled files."""
    (tmp_path / "framequery" / "llm" / "__pycache__").mkdir(parents=True)
    hollow = WITHOUT.replace("shutil.copytree(", "shutil.rmtree(to + '/framequery'); shutil.copytree(", 1) + "\n"
    hollow = hollow.replace("sys.path.insert(0, to)", "import os; os.makedirs(to + '/framequery/llm/__pycache__'); sys.path.insert(0, to)")
    done = subprocess.run([sys.executable, "-c", hollow, str(ROOT), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_no_other_module_imports_the_corpus_operators():
    for path in (ROOT / "framequery").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_sql_stands_beside_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
