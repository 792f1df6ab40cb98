"""Run named queries against their SQL twins: python tests/check_queries.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mailprism.plans.oracles import ORACLES  # noqa: E402
from mailprism.plans.queries import QUERIES  # noqa: E402
from mailprism.session import local_session  # noqa: E402
from tests.compare import differences, run_sql  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or [n for n in QUERIES if n in ORACLES]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, f"/root/testdata/sf{sf}").toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            bad = differences(got, run_sql(ORACLES[name], f"/root/testdata/sf{sf}"))
            print("BAD " if bad else "ok  ", name, len(got), f"{took:.1f}s", *bad[:6], sep=" ", flush=True)
        except Exception as error:
            print("FAIL", name, str(error)[:700], flush=True)
