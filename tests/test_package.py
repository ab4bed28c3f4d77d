"""The package away from its folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHORT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tidemark.session import local_session
spark = local_session(2)
def where(batches):
    import tidemark.functions.fixed_values as f
    for b in batches:
        yield b
print("rows", spark.range(3).mapInPandas(where, "id long").count())
"""
LACKING = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("public_tokenizers", "zstandard", "xxhash"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print("queries", len(e.queries()), "op1_imatch_fingerprints" in e.queries())
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_workers_find_the_package_from_another_folder(tmp_path):
    assert "rows 3" in run(SHORT, tmp_path)


def test_queries_without_the_corpus_libraries(tmp_path):
    said = run(LACKING, tmp_path).split()
    assert int(said[said.index("queries") + 1]) > 100 and said[-1] == "False"
