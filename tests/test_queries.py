"""Every registered variant query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import database, differences

from svlake.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_equals_sql(spark, sf_dir, db, name):
    f, sql = REGISTRY[name]
    assert differences(f(spark, sf_dir), db, sql) == ""


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_has_rows(spark, sf_dir, name):
    assert REGISTRY[name][0](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["same", "dif1", "dif2"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_resize_multiplies_in_single_precision(spark, tmp_path):
    """Values whose hundredfold is a half in single precision, but not in double, round as the SQL does."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = (np.arange(0, 4000, dtype=np.float32) + np.float32(0.5)) / np.float32(100)
    x = np.concatenate([np.nextafter(x, np.float32(-1)), x, np.nextafter(x, np.float32(99))])
    x = np.resize(x[(np.rint(x * np.float32(100) * 2) == x * np.float32(100) * 2) & (x.astype(np.float64) * 100 != x * np.float32(100))], 64 * 20)
    rows = pa.FixedSizeListArray.from_arrays(pa.array(x, pa.float32()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(20), pa.int64()), "embedding": rows}), tmp_path / "embeddings.parquet")
    f, sql = REGISTRY["raster_row_resize"]
    assert differences(f(spark, str(tmp_path)), database(str(tmp_path)), sql) == ""
