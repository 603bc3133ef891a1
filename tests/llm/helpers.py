import duckdb


def sql_rows(sql, **tables):
    """Rows of DuckDB SQL over tables given as lists of dicts or paths of Parquet files."""
    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{t}')")
        else:
            con.register(name, t)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()), key=str)


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
