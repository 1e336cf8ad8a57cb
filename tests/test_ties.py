"""Rows that a query's SQL leaves in open order: the same result whatever the order of the files."""

import shutil
from pathlib import Path

import pandas as pd

from gleaner.catalog import QUERIES

TABLES = Path("/root/testdata/sf0.001")


def test_sponsor_rollup_does_not_depend_on_row_order(spark, tmp_path):
    lines = pd.read_parquet(TABLES / "lineitem.parquet")
    last = lines[(lines.l_linenumber == 1) & (lines.l_shipdate == lines.groupby("l_orderkey").l_shipdate.transform("max"))].head(20)
    other = last.assign(l_linestatus=last.l_linestatus.map({"O": "F", "F": "O"}))
    got = []
    for order in ([lines, other], [other, lines]):
        folder = tmp_path / str(len(got))
        folder.mkdir()
        for name in ("customer", "orders", "part", "supplier", "nation"):
            shutil.copyfile(TABLES / f"{name}.parquet", folder / f"{name}.parquet")
        pd.concat(order).astype({"l_shipdate": "datetime64[us]"}).to_parquet(folder / "lineitem.parquet", index=False)
        got.append(sorted(map(str, QUERIES["sponsor_rollup"](spark, str(folder)).collect())))
    assert len(got[0]) > 0 and got[0] == got[1]
