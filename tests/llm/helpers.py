"""Shared fixtures of the text operators' tests: odd rows, oracle compare, plain reference code."""

import re

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, rep long, mark long, digest string, "
          "score double, w array<string>, component string, a int, b int, key int, `odd name` string, own_sha string, "
          "gone_id long, Bad_Id string, bad_mark long, own_score double, id long, t string, h long, y int, __id long")
LONG = " ".join(f"w{k % 977}x{k // 977}" for k in range(60_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix boxing gloves at noon"


def docs(spark, rows, repeat=1):
    """Rows (doc_id, text) with extra columns whose names operators use inside."""
    full = [(i, t, "en", "s", 0, 1, 2, "d", 0.5, ["w"], "c", 3, 4, 5, "o", "s", 1, "b", 2, 0.5, 1, "t", 2, 1, 3) for i, t in rows] * repeat
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, BASE), (5, BASE), (6, BASE.upper()), (7, LONG), (8, LONG + " end"),
       (9, "a"), (10, "ÉÉ ñandú 漢字 \U0001F600 'tis we'll"), (10, "other text of the same id"), (11, "x\x00y \u2028 z"),
       (12, "dup"), (12, "dup"), (None, "no id"), (None, BASE), (13, "a" * 3000), (14, "\\ # </turn> ### x: \\l")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def matches_oracle(spark, query, sql, sf=SMALL):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(map(tuple, cur.fetchall()), key=repr)
    assert rows_of(got.select(*names)) == want
