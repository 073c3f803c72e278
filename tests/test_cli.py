"""The command line runs the application's jobs."""

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_dashboard_command_prints_one_record():
    out = subprocess.run([sys.executable, "-m", "motorlytics", "dashboard", "--tables", SF_SMALL, "--master", "local[2]"],
                         cwd=ROOT, capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr[-2000:]
    rec = json.loads(out.stdout.strip().splitlines()[-1])
    assert set(rec) == {"dashboard", "categories", "turnaround"}
    assert len(rec["categories"]) == 3
