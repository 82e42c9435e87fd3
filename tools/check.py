"""Compare registered queries with their SQL twins: python tools/check.py [sf_dir] [name-or-id ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.plans import registry  # noqa: E402
from millrace.session import TABLES, build_session  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None:
            return "\\N"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        return str(v)

    lines = sorted("|".join(text(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], lines


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = set(sys.argv[2:])
    if wanted:
        modules = [m for m in registry.MODULES if m in wanted] or registry.MODULES
        registry.MODULES = tuple(modules)
        wanted -= set(modules)
    todo = registry.load_all()
    if wanted:
        todo = {n: q for n, q in todo.items() if n in wanted or wanted & set(q.covers)}
    spark = build_session("local[8]", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, q in todo.items():
        start = time.time()
        try:
            df = q.run(spark, sf)
            cols = df.columns
            mine = df.collect()
            took = time.time() - start
            if not q.sql:
                print(f"rows  {name} {len(mine)} {took:.2f}s", flush=True)
                continue
            res = con.execute(q.sql)
            theirs = res.fetchall()
            oracle_cols = [d[0] for d in res.description]
            types = {d[0]: str(d[1]) for d in res.description}
            a, b = canonical(mine, cols), canonical(theirs, oracle_cols)
            if a == b:
                kinds = [f"{n}:{t}/{types.get(n)}" for n, t in df.dtypes if (t, types.get(n)) not in OK]
                empty = " EMPTY" if not mine else ""
                print(f"ok    {name} {len(mine)} {took:.2f}s{empty} {' '.join(kinds)}", flush=True)
            else:
                bad += 1
                print(f"DIFF  {name} {len(mine)} vs {len(theirs)} {took:.2f}s cols {a[0]} vs {b[0]}", flush=True)
                left = [x for x in a[1] if x not in set(b[1])][:4]
                right = [x for x in b[1] if x not in set(a[1])][:4]
                for x in left:
                    print("   spark ", x[:400])
                for x in right:
                    print("   duckdb", x[:400], flush=True)
        except Exception as exc:
            bad += 1
            lines = str(exc).splitlines()
            print(f"FAIL  {name} {type(exc).__name__} {' '.join(lines[:3])[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(todo)} queries, {bad} bad")
    return bad


OK = {
    ("bigint", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"), ("int", "INTEGER"),
    ("date", "DATE"), ("timestamp_ntz", "TIMESTAMP"),
}

if __name__ == "__main__":
    sys.exit(main())
