"""Run registered queries beside their SQL and compare rows, values and column types."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def differences(spark, con, make, sql, sf_dir):
    """Empty text if both sides agree exactly, else what differs."""
    df = make(spark, sf_dir)
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    want = dict(zip(rel.columns, map(str, rel.types)))
    if set(got) != set(want):
        return f"columns {sorted(set(got) ^ set(want))}"
    wrong = [f"{c}: {got[c]} / {want[c]}" for c in got if TYPES.get(got[c], got[c]) != want[c]]
    if wrong:
        return "types " + ", ".join(wrong)
    names = sorted(got)
    ours = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    theirs = sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows of {len(ours)}, first {dict(zip(names, zip(*bad[0])))}" if bad else ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from leakgauge import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("OFF")
    con, makers, oracles = connect(sf_dir), queries(), oracle_sql()
    for name in wanted or oracles:
        start = time.time()
        try:
            said = differences(spark, con, makers[name], oracles[name], sf_dir) or "ok"
        except Exception as error:
            said = f"ERROR {str(error)[:700]}"
        print(f"{name:32s} {time.time() - start:6.2f}s {said[:900]}", flush=True)


if __name__ == "__main__":
    main()
