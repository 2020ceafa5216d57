"""The entry without the training-data subpackage, or without what that needs."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PLAIN = "names = set(e.queries()) - {'pipeline'}; assert len(names) == 178 == len(e.oracle_sql()), len(names)"


@pytest.mark.parametrize("absent", ["public_tokenizers", "pricelens.llm", "pricelens.llm.queries"])
def test_entry_without(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; {PLAIN}"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
