import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sourcetally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g")


@pytest.fixture(scope="session")
def files_of(spark):
    """files table from {path: content} or {path: (content, length)}"""
    def make(tree):
        rows = []
        for path, content in tree.items():
            content, length = content if isinstance(content, tuple) else (content, len((content or "").encode()))
            rows.append((path.split("/")[0], path, length, content))
        return spark.createDataFrame(rows, "root string, path string, length bigint, content string")
    return make


def column(df, *names):
    """Sorted values (or tuples) of columns."""
    got = [tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect()]
    return sorted(got, key=repr)
