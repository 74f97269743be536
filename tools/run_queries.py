"""Run registered queries on a test data folder and report failures and times.

usage: python tools/run_queries.py [sf_dir] [name ...]
"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyfield.catalog.queries import all_queries  # noqa: E402
from tests.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = set(sys.argv[2:])
    spark = local_session()
    for name, query in all_queries().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            rows = query(spark, sf_dir).toPandas()
            print(f"ok   {name:36s} {len(rows):7d} rows {time.time() - started:6.2f}s", flush=True)
        except Exception as e:
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            if chosen:
                traceback.print_exc()


if __name__ == "__main__":
    main()
