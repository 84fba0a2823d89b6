"""The entry point works before there is a session, and names its queries and their SQL alike."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_need_no_session():
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; print('fine')"
    done = subprocess.run([sys.executable, "-c", said], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_flagship(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["platform", "tier", "n", "mean_score"] and out.count() > 0
