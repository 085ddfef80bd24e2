"""python -m tests.run_oracle [sf or folder] [query or module ..]: compare queries with their SQL, print time and outcome.

SHUFFLED=1 turns broadcast joins off.
"""

import os
import sys
import time
import traceback

from pressroute.queries import ORACLE, QUERIES
from pressroute.session import local_session
from tests.oracle import compare, connect


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    base = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    extra = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if os.environ.get("SHUFFLED") else {}
    spark, con = local_session(**extra), connect(base)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name == w or run.__module__.endswith(w) or QUERY_MODULES.get(name, "").endswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLE:
                outcome = compare(spark, con, run, ORACLE[name], base)
            else:
                outcome = None if run(spark, base).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            outcome = "".join(traceback.format_exception_only(e))[:900]
        took = time.time() - start
        bad += outcome is not None
        print(f"{'ok  ' if outcome is None else 'FAIL'} {took:5.1f}s {'' if name in ORACLE else '(rows only) '}{name}"
              + (f"\n      {outcome}" if outcome else ""), flush=True)
    print(f"{bad} failed")


from pressroute.queries.registry import MODULES as QUERY_MODULES  # noqa: E402

if __name__ == "__main__":
    main()
