"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_some_queries_run(spark, sf):
    import __spark_entry__

    found = __spark_entry__.queries()
    for name in ("ufunc_arithmetic", "nd_sum", "nd_cumsum", "nd_unique", "ma_sum", "poly_fit", "stream_windowed_statistics"):
        assert found[name](spark, sf).count() > 0
