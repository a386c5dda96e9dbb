"""Run registered queries against their SQL: verify.py [sf_dir] [name-part ...]"""

import os
import pathlib
import sys
import time

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent.parent), str(pathlib.Path(__file__).resolve().parent)]

import __spark_entry__ as entry  # noqa: E402
from limpid.session import build_session, release_stages  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from oracle import connect, differences  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    if os.environ.get("PLAIN"):  # a session that knows nothing of this package
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
            "spark.sql.session.timeZone", os.environ["PLAIN"]).config(
            "spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session(master="local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                diff = differences(df, con, sqls[name])
                state = "ok" if not diff else "DIFF"
            else:
                diff, state = [], f"rows={df.count()}"
        except Exception as exc:  # noqa: BLE001
            diff, state = [f"{type(exc).__name__}: {str(exc)[:1500]}"], "ERROR"
        bad += state in ("DIFF", "ERROR")
        print(f"{state:6} {name} {time.time() - start:.1f}s", flush=True)
        for x in diff:
            print("      ", x, flush=True)
    release_stages(spark)
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
