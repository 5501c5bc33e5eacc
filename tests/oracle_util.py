"""Compare a registered query against its DuckDB oracle (order-free)."""

import math


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def assert_matches_oracle(spark, con, name, sf_dir):
    import __spark_entry__ as ent

    df = ent.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(ent.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols), (df.columns, dcols)
    assert len(srows) == len(drows), (len(srows), len(drows))
    a, b = rows_of(df.columns, srows), rows_of(dcols, drows)
    diff = [x for x, y in zip(a, b) if x != y][:3]
    assert a == b, diff
    return len(srows)
