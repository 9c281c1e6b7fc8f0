import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session
from tidemark.streaming.admission import ROCKSDB


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def event(spark):
    """Build canonical events from short keyword rows."""
    from datetime import datetime

    from tidemark.schema import CANONICAL

    def build(*rows):
        full = []
        for number, row in enumerate(rows, 1):
            values = {
                "event_id": number,
                "event_type": "WatchEvent",
                "created_at": "2024-05-06 10:00:00",
                "actor_id": number,
                "actor_login": f"user{number}",
                "repo_id": 7,
                "repo_name": "team/tool",
                "org_id": 0,
                "language": "",
                "payload_size": 20,
                "ref": "",
                **row,
            }
            values["created_at"] = datetime.fromisoformat(values["created_at"])
            full.append(tuple(values[f.name] for f in CANONICAL.fields))
        return spark.createDataFrame(full, CANONICAL)

    return build


@pytest.fixture
def eight_events(event):
    """Four stars (one with a language), two pushes, a fork and an issue on one repository."""
    return event(
        {"language": "python"},
        {},
        {"created_at": "2024-05-06 11:30:00"},
        {"created_at": "2024-05-07 09:00:00"},
        {"event_type": "PushEvent"},
        {"event_type": "PushEvent"},
        {"event_type": "ForkEvent"},
        {"event_type": "IssuesEvent"},
    )
