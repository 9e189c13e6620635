"""Every query runs where the workers lack the repository: the package ships itself."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).parent


def run(tmp_path, sf, names):
    done = subprocess.run([sys.executable, str(HERE / "shipping.py"), str(HERE.parent), sf, *names], cwd=tmp_path, capture_output=True, text=True, timeout=1200)
    assert done.stdout.split() == ["DONE"], done.stdout[-3000:] + done.stderr[-1000:]


def test_queries_without_the_repository(tmp_path, sf):
    run(tmp_path, sf, [n for n, f in entry.queries().items() if f.__module__.split(".")[1] != "llm"])
