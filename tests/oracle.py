"""Strict comparison of a registered query with its SQL oracle: names, types by kind, row count and every value."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pyarrow as pa

#: Integers stay integers where a column holds nulls, or nothing else.
NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(df) -> pd.DataFrame:
    """The rows of a Spark DataFrame with the types of its schema, whatever the values are."""
    table = df.toArrow()
    zoned = {f.name: i for i, f in enumerate(table.schema) if pa.types.is_timestamp(f.type) and f.type.tz}
    for name, i in zoned.items():
        table = table.set_column(i, name, table.column(i).cast(pa.timestamp("us")))
    return table.to_pandas(types_mapper=NULLABLE.get)


def _kind(series: pd.Series) -> str:
    name = str(series.dtype)
    if name.startswith("datetime"):
        return "time"
    if name == "bool":
        return "bool"
    return {"i": "int", "u": "int", "f": "float"}.get(series.dtype.kind, "object")


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = _kind(df[c])
        if kind == "time":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind == "float":
            df[c] = [None if pd.isna(v) else repr(float(v) + 0.0) for v in df[c]]
        else:
            df[c] = [None if v is None or v is pd.NA or (not isinstance(v, (list, dict)) and pd.isna(v)) else str(v) for v in df[c]]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if len(got) and len(want):
        for c in sorted(got.columns):
            a, b = _kind(got[c]), _kind(want[c])
            if a != b and "object" not in (a, b):
                out.append(f"kind of {c}: {a} != {b}")
    if len(got) == len(want):
        g, w = _normal(got), _normal(want)
        for c in g.columns:
            bad = (g[c].fillna("<null>") != w[c].fillna("<null>"))
            if bad.any():
                i = bad.idxmax()
                out.append(f"{c}: {int(bad.sum())} values differ, first got {g.loc[i].to_dict()} want {w.loc[i].to_dict()}")
    return out
