"""Run every query against its SQL: python tests/check_queries.py [folder] [name …]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from loomwork.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", 8, {"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start, sql = time.time(), entry.oracle_sql().get(name)
        try:
            df = entry.queries()[name](spark, folder)
            problem = compare(df, con, sql) if sql else None
            note = f"{df.count()} rows" if not sql else "equal"
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:7.2f}s  {problem or note}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
