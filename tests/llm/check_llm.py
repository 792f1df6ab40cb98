"""Run queries of the folder against their SQL twins: python tests/llm/check_llm.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from mailprism.llm.oracles import ORACLES  # noqa: E402
from mailprism.llm.queries import QUERIES  # noqa: E402
from mailprism.session import local_session  # noqa: E402
from tests.compare import differences, run_sql  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    spark = local_session("8")
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        got = QUERIES[name](spark, f"/root/testdata/sf{sf}").toPandas()
        took = f"{time.time() - start:.1f}s"
        if name not in ORACLES:
            print("rows", name, len(got), took, flush=True)
            continue
        bad = differences(got, run_sql(ORACLES[name], f"/root/testdata/sf{sf}"))
        print("BAD " if bad else "ok  ", name, len(got), took, *bad[:6], flush=True)
