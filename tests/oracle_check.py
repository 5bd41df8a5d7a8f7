"""Run registered queries against their SQL oracles: python tests/oracle_check.py SF_DIR [name ...]."""

import math
import sys
import time

import duckdb
import pandas as pd

from tallyline.plans import catalog
from tallyline.plans.views import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, pd.Timestamp):
        return x.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(x, bool):
        return int(x)
    return round(x, 9) if isinstance(x, float) else (x.isoformat() if hasattr(x, "isoformat") else x)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_cell(x) for x in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in t))


def compare(spark_pdf, oracle_pdf):
    ca, a = rows_of(spark_pdf)
    cb, b = rows_of(oracle_pdf)
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, e.g.\n   spark  {diff[0][0]}\n   oracle {diff[0][1]}"
    return None


def main(sf_dir, names):
    from tallyline.session import local_session

    spark, con = local_session("8"), connect(sf_dir)
    bad = []
    for name, fn in catalog.QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        try:
            t = time.time()
            pdf = fn(spark, sf_dir).toPandas()
            t1 = time.time() - t
            if name not in catalog.ORACLES:
                print(f"{name}: {len(pdf)} rows, no oracle, {t1:.1f}s", flush=True)
                continue
            t = time.time()
            ref = con.execute(catalog.ORACLES[name]).df()
            t2 = time.time() - t
            problem = compare(pdf, ref)
            note = "" if len(pdf) else " (EMPTY)"
            print(f"{name}: {'OK' if not problem else 'FAIL ' + problem} {len(pdf)} rows{note} spark {t1:.1f}s duckdb {t2:.1f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            problem = str(error)[:700]
            print(f"{name}: ERROR {problem}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
