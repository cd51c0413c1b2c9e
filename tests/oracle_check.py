"""Run queries and their SQL side by side: ``python tests/oracle_check.py SF_DIR [names]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE",
         "decimal(38,4)": "DECIMAL(38,4)", "timestamp": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """Problem text, or None when both sides agree on names, types and rows."""
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    sql = entry.oracle_sql()[name]
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(kinds) != columns:
        return f"columns {columns} against {sorted(kinds)}"
    wrong = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS[t] != kinds[c]}
    if wrong:
        return f"types {wrong}"
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {listed} FROM ({sql})").fetchall()
    key = lambda row: tuple((v is None, str(v)) for v in row)
    if sorted(map(key, got)) != sorted(map(key, want)):
        missing, extra = set(map(key, want)) - set(map(key, got)), set(map(key, got)) - set(map(key, want))
        return f"rows {len(got)} against {len(want)}; only SQL {str(sorted(missing)[:2])[:400]}; only Spark {str(sorted(extra)[:2])[:400]}"
    if not got:
        return "no rows on either side"
    return None


if __name__ == "__main__":
    from trainscope.session import builder

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (builder().master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir) if name in entry.oracle_sql() else "no SQL"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print("failed", failed, "of", len(names))
