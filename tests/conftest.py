import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from codequarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", memory="4g")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from (repo, path, text-or-bytes) rows."""
    from codequarry.sources.tables import from_content

    def build(*rows):
        data = [(r, p, bytearray(t if isinstance(t, bytes) else t.encode())) for r, p, t in rows]
        return from_content(spark.createDataFrame(data, "repo string, path string, content binary"))

    return build
