"""The entry module in installations that lack parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("no " + name, name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""


def run(name):
    return subprocess.run([sys.executable, "-c", PROGRAM.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("name", ["storyloom.llm", "corpus_pipeline", "tokenizers", "zstandard"])
def test_core_queries_stay_when_the_corpus_operators_cannot_be_imported(name):
    done = run(name)
    assert done.returncode == 0, done.stderr
    n, corpus = done.stdout.split()
    assert int(n) > 140 and (corpus == "False" or name == "corpus_pipeline")


def test_a_missing_core_module_is_an_error():
    assert run("storyloom.operators.metrics").returncode != 0
