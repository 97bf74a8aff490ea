import __spark_entry__ as entry
from cribra.llm import queries


def test_queries_are_registered_and_those_without_sql_are_known():
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert set(queries.QUERIES) - set(queries.ORACLE) == {
        "op2_token_counts", "op3_lang_id", "op4_fingerprints", "op5_byte_bpe", "op7_secret_scan",
        "op10_lm_score", "pipeline"}
