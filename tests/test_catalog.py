import math
import os

import duckdb
import pytest

from loomvar.plans import catalog, reports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.execute(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def test_upper_bound():
    assert math.isclose(reports.upper_bound(0, 10), 0.3084971, abs_tol=1e-6)
    assert math.isclose(reports.upper_bound(5, 100), 0.1128349, abs_tol=1e-6)
    assert reports.upper_bound(3, 3) == 1.0 and reports.upper_bound(0, 0) == 1.0


def test_entry_without_llm(monkeypatch):
    """The entry works where the training-data modules are not there, and does not hide that one of them cannot be imported."""
    import importlib
    import importlib.util
    import sys

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *more: None if name.startswith(("corpus_pipeline", "loomvar.llm")) else real(name, *more))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    sys.modules.pop("__spark_entry__", None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_annotation_sees_rare_terms(spark):
    """The projections reach what the registered annotation queries are to compare."""
    terms = {r.term for r in catalog.queries()["annotate_all"](spark, SF).collect()}
    assert {"frameshift_variant", "inframe_insertion", "inframe_deletion", "missense_variant", "NMD_transcript_variant", "splice_donor_variant", "5_prime_UTR_variant", "coding_sequence_variant"} <= terms
    terms = {r.term for r in catalog.queries()["coding_with_bases"](spark, SF).collect()}
    assert {"missense_variant", "synonymous_variant", "stop_gained", "stop_lost", "start_lost"} <= terms
