"""Runs registered queries and their SQL side by side: python tools/check.py [sf_dir] [name ...]"""

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return repr(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when both agree, else what differs."""
    rel = con.execute(sql)
    theirs_types = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    names = [d[0] for d in rel.description]
    mine = df.collect()
    mine_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if sorted(mine_types) != sorted(names):
        return f"columns {sorted(set(mine_types) ^ set(names))[:6]}"
    wrong = {n: (mine_types[n], theirs_types[n]) for n in names if mine_types[n] != theirs_types[n]}
    if wrong:
        return f"types {dict(list(wrong.items())[:5])}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: only here {[x for x in a if x not in set(b)][:2]} only there {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cols = [(n, p, q) for n, p, q in zip(sorted(names), x, y) if p != q]
        return f"{len(bad)} rows differ, first: {cols[:4]} in {x[:3]}"
    return None


def main(argv):
    from dossier.session import local_session
    from dossier.workload import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                note = f"{df.count()} rows" if problem is None else problem
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name:24} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
