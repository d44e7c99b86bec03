"""The entry point where the subpackage on training text lacks a library."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
sys.modules["zstandard"] = None  # its import fails
import __spark_entry__ as entry
names = set(entry.queries())
assert "overview_orders" in names and not any(n.startswith("op1_") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
"""


def test_core_queries_without_a_library_of_the_subpackage():
    done = subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
