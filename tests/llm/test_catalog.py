"""SQL checks of the corpus operators are SQL."""

from hallwatch.llm import catalog


def test_checks_are_text():
    assert all(isinstance(sql, str) for sql in catalog.SQL.values())
