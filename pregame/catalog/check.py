"""Compare registered queries with their SQL twins in the reference query engine."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def compare(spark, folder: str, names=None, show: int = 3) -> list[str]:
    """Names of the queries whose rows differ."""
    import duckdb

    from pregame.catalog import load

    queries, sql = load()
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = [tuple(_cell(r[c]) for c in sorted(df.columns)) for r in df.collect()]
            took = time.time() - start
            if name not in sql:
                print(f"     {name}: {len(got)} rows, no twin, {took:.1f}s", flush=True)
                continue
            result = engine.execute(sql[name])
            columns = [d[0] for d in result.description]
            order = sorted(range(len(columns)), key=lambda i: columns[i])
            want = [tuple(_cell(r[i]) for i in order) for r in result.fetchall()]
            same = sorted(columns) == sorted(df.columns) and sorted(got) == sorted(want)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:600]}", flush=True)
            failed.append(name)
            continue
        print(f"{'ok  ' if same else 'FAIL'} {name}: {len(got)} rows vs {len(want)}, {took:.1f}s", flush=True)
        if not same:
            failed.append(name)
            if sorted(columns) != sorted(df.columns):
                print("   columns", sorted(set(columns) ^ set(df.columns)))
            else:
                extra, lacking = sorted(set(got) - set(want)), sorted(set(want) - set(got))
                names_ = sorted(df.columns)
                print(f"   {len(extra)} only ours, {len(lacking)} only theirs; columns {names_ if len(names_) < 15 else ''}")
                for a, b in list(zip(extra, lacking))[:show]:
                    print("   ", [(n, x, y) for n, x, y in zip(names_, a, b) if x != y or n.endswith("key") or n == "game_id"])
    return failed


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = compare(spark, sys.argv[1], sys.argv[2:] or None)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
