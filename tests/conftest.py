from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from windrow.session import session

    scratch = tmp_path_factory.mktemp("spark")
    made = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__local__dir=str(scratch), spark__sql__warehouse__dir=f"{scratch}/warehouse")
    made.sparkContext.setLogLevel("ERROR")
    made.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    yield made
    made.stop()
