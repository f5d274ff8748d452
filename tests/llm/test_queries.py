"""Every query of this package has check SQL or tests that are named."""

import os

from rankloom.llm import queries

HERE = os.path.dirname(os.path.abspath(__file__))


def test_sql_or_named_tests():
    assert queries.QUERIES.keys() | {"pipeline"} == queries.CHECKS.keys() | queries.TESTED.keys()
    assert not queries.CHECKS.keys() & queries.TESTED.keys()


def test_named_tests_exist():
    for tests in queries.TESTED.values():
        for test in tests:
            file, name = test.split("::")
            with open(os.path.join(HERE, file)) as source:
                assert f"def {name}(" in source.read(), test
