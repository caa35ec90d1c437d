import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnledger.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "6g",
                                                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


TURN = ("account string, session_id string, source string, project string, ord long, ts_ms long, model string, "
        "input_tokens long, output_tokens long, cache_read long, cache_creation long, cache_1h long, tools array<string>")


def turn_rows(spark, rows):
    """Turns from dicts with defaults."""
    base = dict(account="a", session_id="s", source="src", project="p", model="claude-opus-4-8", input_tokens=0,
                output_tokens=1, cache_read=0, cache_creation=0, cache_1h=0, tools=[])
    names = [c.split()[0] for c in TURN.split(", ")]
    data = []
    for i, r in enumerate(rows):
        full = {**base, "ord": i, **r}
        data.append(tuple(full[n] for n in names))
    return spark.createDataFrame(data, TURN)
