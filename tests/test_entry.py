"""The entry module without the operators of the training-data pipeline."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDDEN = """
import sys, warnings
warnings.simplefilter("ignore")
for name in {names}:
    sys.modules[name] = None
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
print(len(entry.queries()))
"""


def _left(*names):
    found = subprocess.run([sys.executable, "-c", HIDDEN.format(names=list(names))], cwd=ROOT,
                           capture_output=True, text=True, check=True)
    hidden, count = found.stdout.splitlines()[-2:]
    return hidden, int(count)


def test_without_the_package():
    hidden, count = _left("glyphloom.llm")
    assert hidden == "[]" and count > 40


def test_without_what_the_package_needs():
    """A module that only the operators need takes none of the other queries down."""
    assert _left("glyphloom.llm.common")[0] == "[]"
