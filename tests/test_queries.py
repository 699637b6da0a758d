"""Every registered query of the engine against its SQL."""

import pytest

from tests.helpers import same
from tidemark import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir), duck.execute(registry.ORACLES[name]))


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parents[1])).returncode == 0
