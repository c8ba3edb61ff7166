import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recordloom.session import build_session

    session = build_session("recordloom-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.structuredLogging.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def resources(spark):
    """Build resource rows out of JSON dictionaries of one source and patient."""
    import json

    from recordloom.functions.json_fields import parse_once

    def build(*items, source="s1"):
        rows = [(source, "p1", n, r["resourceType"], r.get("id"), json.dumps(r)) for n, r in enumerate(items)]
        df = spark.createDataFrame(rows, "source_id string, patient_id string, input_pos bigint, resource_type string, id string, json string")
        return parse_once(df, "json")

    return build
