from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lonja.runtime import build_session  # noqa: E402
from lonja.schema import OPERATIONS_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "operation_id": "op",
    "client_id": "C1",
    "client_name": "client",
    "buyer_id": "B1",
    "buyer_name": "buyer",
    "buyer_city": "Cali",
    "seller_id": "S1",
    "seller_name": "seller",
    "seller_city": "Neiva",
    "product": "maize",
    "business_value": 100.0,
    "commission": 10.0,
    "referrer": 1,
    "pct_ref_sale": 10.0,
    "pct_ref_purchase": 5.0,
    "principal": "V",
    "operation_type": "RSG",
    "month_name": "enero",
    "year": 2025,
    "registered_on": dt.date(2025, 1, 6),
}


@pytest.fixture(scope="session")
def make_ops(spark):
    """An operations table of rows that differ from a default row as given."""

    def make(*rows: dict):
        names = OPERATIONS_SCHEMA.fieldNames()
        full = [tuple({**DEFAULTS, **row}[name] for name in names) for row in rows]
        return spark.createDataFrame(full, OPERATIONS_SCHEMA)

    return make
