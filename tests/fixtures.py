"""Folders of test tables: empty ones, and ones with nulls everywhere, repeats, odd texts and an extra column."""

from __future__ import annotations

import datetime
import glob
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
LONG = "The clerk met Mr. Smith. " * 4000


def empty_tables(folder: Path) -> str:
    for f in glob.glob(f"{DATA}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), folder / os.path.basename(f))
    return str(folder)


def odd_tables(folder: Path) -> str:
    """Forty rows of each table twice, a row of nulls, one with empty texts, one with very long ones, and columns n, key, rank, text_ beside."""
    for f in glob.glob(f"{DATA}/*.parquet"):
        t = pq.read_table(f).slice(0, 40)
        rows = t.to_pylist()
        blank = [{k: None for k in t.column_names}]
        for value in ("", " \n ", LONG):
            row = dict(rows[0]) if rows else {}
            for c in t.schema:
                if pa.types.is_string(c.type) and not c.name.endswith("_id") and c.name not in ("id", "file"):
                    row[c.name] = value
            blank.append(row)
        out = pa.Table.from_pylist(rows + rows + blank, schema=t.schema)
        for extra in ("n", "rank", "token", "group"):
            if extra not in out.column_names:
                out = out.append_column(extra, pa.array([datetime.date(2024, 1, 1)] * len(out)))
        pq.write_table(out, folder / os.path.basename(f))
    return str(folder)
