"""Compare registered queries with their SQL on a data folder: ``python tests/check_sql.py DIR [name ...]``."""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(cell, v)) + "]"
        return str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    df = fn(spark, folder)
    names, mine = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    other_names, other = canonical(rel.fetchall(), cols)
    if names != other_names:
        return f"columns {names} != {other_names}", len(mine)
    if mine != other:
        extra, lack = [r for r in mine if r not in set(other)][:3], [r for r in other if r not in set(mine)][:3]
        return f"{len(mine)} rows against {len(other)}; {names}\n   spark {extra}\n   sql   {lack}", len(mine)
    return None, len(mine)


def main(folder, only):
    from catalog import QUERIES, SQL
    from tidemark.session import local_session

    spark = local_session("check")
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(folder), 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        at = time.time()
        try:
            if name in SQL:
                problem, n = compare(spark, con, folder, fn, SQL[name])
            else:
                problem, n = None, len(fn(spark, folder).collect())
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:400]}", -1
        bad += problem is not None
        kind = "ok" if name in SQL else "rows"
        print(f"{'FAIL' if problem else kind:5}{name:34}{n:8}{time.time() - at:7.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
