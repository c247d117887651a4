"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150
    for n in (1, 3, 6):
        assert f"p{n}_found" in q


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["table_name", "edge_id", "endpoint", "kind", "period"]


def test_nothing_imports_the_llm_subpackage():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "weftgraph"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
