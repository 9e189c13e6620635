"""The queries of this subpackage run where the workers lack the repository."""

import subprocess
import sys
from pathlib import Path

from loomtext.llm import queries

HERE = Path(__file__).parents[1]


def test_queries_without_the_repository(tmp_path, sf):
    done = subprocess.run([sys.executable, str(HERE / "shipping.py"), str(HERE.parent), sf, *queries.QUERIES], cwd=tmp_path, capture_output=True, text=True, timeout=1200)
    assert done.stdout.split() == ["DONE"], done.stdout[-3000:] + done.stderr[-1000:]
