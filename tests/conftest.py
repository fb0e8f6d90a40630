import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from basketry.session import local_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    s = local_session(cores=8, shuffle_partitions=8, app="basketry-tests", warehouse=warehouse)
    yield s
    s.stop()


@pytest.fixture
def write_lines(tmp_path):
    """Write text lines to ``tmp_path/<folder>/<name>``; returns the folder."""

    def _w(folder, name, lines, newline="\n", final_newline=True):
        d = tmp_path / folder
        d.mkdir(parents=True, exist_ok=True)
        body = newline.join(lines) + (newline if final_newline else "")
        (d / name).write_bytes(body.encode("utf-8"))
        return str(d)

    return _w
