"""Run registered queries and their SQL checks side by side and compare the rows.

usage: python tools/check_oracles.py [data folder] [query name …]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from galewise.plans.registry import all_oracles, all_queries  # noqa: E402
from galewise.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def rows_of(table):
    table = table.select(sorted(table.column_names))
    out = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_columns else []
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    oracles, queries = all_oracles(), all_queries()
    bad = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf).toArrow()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {got.num_rows} rows, {took:.2f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(oracles[name]).to_arrow_table()
            sql = time.time() - start
            types = {f.name: (str(f.type), str(want.schema.field(f.name).type) if f.name in want.column_names else "-") for f in got.schema}
            diff = {k: v for k, v in types.items() if v[0] != v[1]}
            a, b = rows_of(got), rows_of(want)
            wrong = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
            ok = len(a) == len(b) and not wrong and sorted(got.column_names) == sorted(want.column_names) and not diff
            print(f"{'ok   ' if ok else 'FAIL '} {name}: {len(a)} rows / {len(b)}, spark {took:.2f}s sql {sql:.2f}s {diff or ''} {wrong[:2] if wrong else ''}", flush=True)
            if not ok:
                bad.append(name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
