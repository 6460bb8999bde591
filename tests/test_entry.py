"""The entry points without the training-data operators: nothing else needs them."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import importlib.abc, sys
class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
names = set(e.queries())
assert "knn_csls" in names and "chat_duplicates" in names and set(e.oracle_sql()) <= names
print("op1_jaccard_join" in names, "pipeline" in names)
"""


def run(hidden):
    return subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden, root=str(ROOT))], capture_output=True, text=True)


def test_entry_without_the_training_data_operators():
    for hidden in ("loquent.llm", "corpus_pipeline"):
        got = run(hidden)
        assert got.returncode == 0 and got.stdout.split() == ["False", "False"], got.stderr[-500:]


def test_a_broken_library_is_told():
    got = run("pyarrow")
    assert got.returncode != 0 and "pyarrow" in got.stderr
