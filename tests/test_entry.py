"""The driver contract."""

import importlib
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quaestor import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_contract_without_the_optional_part(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("quaestor.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("quaestor.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)


def norm(frame):
    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False)
    return sorted(str([None if pd.isna(v) else round(float(v), 4) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, wanted = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert norm(found) == norm(wanted)
