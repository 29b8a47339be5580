"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents embeddings benchmark conversations".split()
NAMES = ["N9_drop_noisy_labels", "G4_entities_after_chain", "G12_batch_labels", "R12_relation_prune", "E11_entity_prune",
         "P17_reverse_frontier", "C6_first_terminal", "L8_parse_sufficiency", "V9_numeric_answer_rule", "F7_run_summary",
         "Q7_merge_step_history", "M1_chain_search", "M1_chain_search_scores", "M1_chain_search_properties", "G3_relations_after_chain",
         "G8_match_pattern", "A2_read_triples", "A2_read_triples_counts", "A4_read_step_logs", "A6_write_details", "V2_answer_match"]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = [tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(text)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
