"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    return repr(float(v)) if isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool | np.bool_) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_without_the_corpus(monkeypatch):
    """The contract file works where the corpus folder is gone."""
    import importlib
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("orrery.llm", "corpus_pipeline")) else real(n, *a))
    module = importlib.reload(__spark_entry__)
    assert set(module.queries()) == set(registry.QUERIES) and set(module.oracle_sql()) <= set(module.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
