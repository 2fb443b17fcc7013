"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_rows(sql: str, columns: list[str], sf_dir: str) -> list[tuple]:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = ", ".join(f'"{c}"' for c in columns)
    return db.execute(f"SELECT {names} FROM ({sql})").fetchall()


def _plain(row) -> tuple:
    return tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in row)


def differences(df, sql: str, sf_dir: str) -> tuple[list, list, int]:
    ours = [_plain(r) for r in df.collect()]
    theirs = [_plain(r) for r in oracle_rows(sql, df.columns, sf_dir)]
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return list((a - b).elements()), list((b - a).elements()), len(ours)
