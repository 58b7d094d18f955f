import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_every_query_runs(spark):
    import __spark_entry__

    from textquarry.llm import queries

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.SQL) <= set(queries.QUERIES)
    columns = {
        "p1_found": ["chunk_ord", "term"], "p2_found": ["chunk_ord_a", "chunk_ord_b"], "p4_found": ["question_id", "defect"],
        "p5_found": ["chunk_ord", "first_character_index", "last_character_index"], "p6_found": ["term", "mark"],
        "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "span_start", "span_end"],
    }
    before = None
    for name, query in queries.QUERIES.items():
        df = query(spark, SF)
        if before is not None:  # what is derived from a result can be read after another query has run
            assert before.count() >= 0
        before = df.limit(2)
        rows = df.collect()
        if name in columns:
            assert df.columns == columns[name] and len(rows) == len(set(rows)), name
