"""Run registered queries against their oracles: ``python tests/check_oracles.py <sf_dir> [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from demandspark.plans.registry import load_all  # noqa: E402
from demandspark.session import build_session  # noqa: E402
from tests.oracle import connect, differences, rows_of  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, q in load_all().items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            got = rows_of(q.run(spark, sf_dir))
            took = time.time() - began
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            want = con.execute(q.sql).df()
            problems = differences(got, want)
            widths = [f"{c}: {got[c].dtype} / {want[c].dtype}" for c in sorted(got) if c in want and got[c].dtype.kind != "M" and str(got[c].dtype).lower() != str(want[c].dtype).lower()]
            if widths:
                print(f"note  {name}: {widths}", flush=True)
        except Exception as e:  # noqa: BLE001
            took, problems, got = time.time() - began, [f"{type(e).__name__}: {str(e)[:1500]}"], []
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += bool(problems)
        print(f"{'FAIL ' if problems else 'ok   '} {name}: {len(got)} rows {took:.1f}s", *problems, sep="\n      ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
