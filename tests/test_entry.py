"""The entry module works where the optional text subpackage is not there."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "kithgraph.llm" or name.startswith("kithgraph.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name == "kithgraph.llm" else real(name, package)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
assert "r01_unresolved_commitments" in names and len(names) > 200
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= names
"""


def test_queries_without_the_text_subpackage():
    done = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
