import __spark_entry__
from textloom.llm import queries


def test_all_operators_and_the_pipeline_are_registered():
    names = {k for k in __spark_entry__.queries() if k.startswith("op") and k[2].isdigit()}
    assert names == set(queries.QUERIES) and len(names) == 13 and "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
