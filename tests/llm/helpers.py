"""Small tables with every awkward row, and a DuckDB comparison."""

import os

import duckdb

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "n_words int, score string, kept int, label string, ids string, rank int")


def docs_of(spark, rows):
    """Documents (doc_id, text) with extra columns whose names operators use for their own results."""
    return spark.createDataFrame(
        [(i, t, "en", "src0", None if t is None else len(t), 1, "x", 0, None, "y", 7) for i, t in rows], DOC_SCHEMA)


LONG = " ".join(f"w{k % 977}x" for k in range(60_000))
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "a row without an id"), (6, LONG),
           (7, "é ü\x1c日本 🙂 İΣς"), (8, "...!?"), (9, "Case CASE case")]


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        path = path if os.path.isfile(path) else path + "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()
