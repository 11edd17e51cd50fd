"""Run every catalog query against its DuckDB twin: ``python tests/run_oracle.py [sf_dir] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck  # noqa: E402

from cohortlab.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    d = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    digits = int(os.environ.get("DIGITS", "9"))
    import __spark_entry__ as E
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = []
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, d)
            if name in oracle:
                ok, info = compare(df, oracle[name], con, digits)
            else:
                ok, info = True, {"rows_only": df.count()}
        except Exception as e:  # noqa: BLE001
            ok, info = False, {"error": str(e).splitlines()[0][:300]}
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'OK ' if ok else 'BAD'} {name:34s} {time.time() - t:6.1f}s {info}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
