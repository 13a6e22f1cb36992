"""Compare every registered query with its SQL on one scale-factor folder: ``python -m checks.verify [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from custodia.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str | None, sf_dir: str) -> tuple[str, str]:
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return ("rows", f"{len(got)} rows") if got else ("EMPTY", "0 rows")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLS", f"spark {sorted(df.columns)} sql {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ("ok", f"{len(a)} rows") if a else ("EMPTY", "0 rows")
    sa, sb = set(a), set(b)
    return "DIFF", f"rows {len(a)} vs {len(b)}\n   spark only {sorted(sa - sb)[:3]}\n   sql only   {sorted(sb - sa)[:3]}"


def main() -> int:
    from checks import ORACLES, QUERIES
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            status, note = compare(spark, con, query, ORACLES.get(name), sf_dir)
        except Exception as exc:  # report and go on
            status, note = "ERROR", str(exc)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:6} {name:36} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
