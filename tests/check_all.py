"""Compare every registered query with its SQL: ``python tests/check_all.py [folder] [key ...]``."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from folkscope.session import build_session, clear_scratch  # noqa: E402
from oracle import compare, connect  # noqa: E402

from folkscope.queries import ORACLES, QUERIES  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for key in keys:
        try:
            ok, detail, took = compare(spark, con, folder, QUERIES[key], ORACLES.get(key))
        except Exception as error:  # report and go on with the next query
            ok, detail, took = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {key:24s} {took:6.2f}s {detail}", flush=True)
    clear_scratch(spark)
    print(f"{len(keys) - bad} of {len(keys)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main())
