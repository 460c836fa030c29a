"""Check queries against their SQL: python tests/run_oracle.py [sf] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from mockloom.session import local_session  # noqa: E402
from tests.oracle import LAST, compare, duck  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                problem = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:600]}"
            if wanted:
                traceback.print_exc()
        failed += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s spark {LAST['spark']:5.2f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)
