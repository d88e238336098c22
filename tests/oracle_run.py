"""Run every registered query next to its DuckDB oracle and print the verdicts.

usage: python tests/oracle_run.py [sf_dir] [name-substring ...]
"""

import sys
import time

sys.path.insert(0, ".")

from codelens.plans.check import compare, duck_connection  # noqa: E402
from codelens.plans.registry import load_all  # noqa: E402
from codelens.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pats = sys.argv[2:]
spark = local_session()
con = duck_connection(sf_dir)
bad = 0
for name, (fn, sql) in sorted(load_all().items()):
    if pats and not any(p in name for p in pats):
        continue
    t = time.time()
    try:
        if sql is None:
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name:28s} spark={n} ({time.time()-t:.1f}s)")
            continue
        r = compare(spark, name, fn, sql, sf_dir, con)
        tag = "OK  " if r.ok else "FAIL"
        bad += not r.ok
        print(f"{tag}  {name:28s} spark={r.spark_rows} oracle={r.oracle_rows} ({time.time()-t:.1f}s) {r.detail[:600]}")
    except Exception as e:  # report and go on
        bad += 1
        print(f"ERR   {name:28s} {type(e).__name__}: {str(e)[:800]}")
print("failures:", bad)
sys.exit(1 if bad else 0)
