"""Task retries give the same results (executor or task loss)."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import SF_SMALL


def test_results_survive_task_retries():
    script = os.path.join(os.path.dirname(__file__), "retry_check.py")
    out = subprocess.run(
        [sys.executable, script, SF_SMALL], capture_output=True, text=True, timeout=900
    )
    assert "OK" in out.stdout, out.stdout[-2000:] + out.stderr[-2000:]
