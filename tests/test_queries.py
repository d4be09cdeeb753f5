"""Every query of the catalogue against its oracle; those without one must give rows of a stable schema."""

import pytest

from lumora.plans import registry
from tests.oracle import connect, same_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        same_rows(con, registry.ORACLES[name], df)
    else:
        assert df.schema == registry.QUERIES[name](spark, sf).schema
        df.count()


def test_entry_imports_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(registry.__file__).parents[2]
    shutil.copytree(root / "lumora", tmp_path / "lumora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(registry.QUERIES)
