"""The entry module without its optional parts."""

import os
import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {root!r})
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
print(len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]))
"""


@pytest.mark.parametrize("names", [["public_tokenizers"], ["scriptmill.llm"], ["corpus_pipeline"], ["scriptmill.llm", "corpus_pipeline"]])
def test_other_queries_are_there(names):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, names=names)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 270, done.stderr
