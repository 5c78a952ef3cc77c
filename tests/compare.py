"""Run registered queries against their SQL in DuckDB: python tests/compare.py [PREFIX...]"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def check(spark, con, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    right = rows_of([c[0] for c in found.description], found.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} {right[0]}"
    if left[1] != right[1]:
        other = [(a, b) for a, b in zip(left[1], right[1], strict=False) if a != b][:2]
        return f"{len(left[1])} and {len(right[1])} rows, first differences {other}"
    if not left[1]:
        return "no rows"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from tessera.plans import catalog

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    where = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    connection, good = connect(where), 0
    for name, sql in catalog.oracle_sql().items():
        if len(sys.argv) > 1 and not name.startswith(tuple(sys.argv[1:])):
            continue
        try:
            said = check(session, connection, catalog.queries()[name], sql, where)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__} {str(e)[:500]}"
        good += said is None
        if said:
            print("BAD", name, said, flush=True)
    print("good", good)
