import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestone.session import session

    made = session(cpus=4, shuffle_partitions=4)
    made.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")
    yield made
    made.stop()
