import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("gapweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Build a panel from ``(species, year, strata, rpn, rpn_var[, rpw, rpw_var])`` rows."""
    from gapweave.spec import PANEL

    def build(rows):
        full = []
        for r in rows:
            species, year, strata, *values = r
            values = [None if v is None else float(v) for v in values]
            full.append((species, year, strata, *(values + [None] * (4 - len(values)))))
        schema = PANEL.schema()
        by_name = {"species": 0, "year": 1, "strata": 2, "rpn": 3, "rpn_var": 4, "rpw": 5, "rpw_var": 6}
        order = [by_name[n] for n in schema.fieldNames()]
        return spark.createDataFrame([tuple(r[i] for i in order) for r in full], schema)

    return build


def as_dict(df, *values, key=("species", "strata", "year")):
    """Rows as ``{key: value or tuple of values}``."""
    out = {}
    for r in df.collect():
        k = tuple(r[c] for c in key)
        assert k not in out, f"two rows for {k}"
        out[k] = r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)
    return out
