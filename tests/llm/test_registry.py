import duckdb
import pytest

from cytomix.llm import registry

TABLES = "documents embeddings pages labels".split()


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001" if name == "op7_suffixes" else "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert len(got) == len(want) > 0 and got.sort_values(key, ignore_index=True).equals(want.sort_values(key, ignore_index=True).astype(got.dtypes.to_dict()))


@pytest.mark.parametrize(("name", "table"), [("op3_pieces", "documents"), ("op4_html", "pages"), ("op5_mixing", "documents"), ("op6_simhash", "documents"), ("op8_toxicity", "documents"), ("op9_lines", "documents"), ("op10_secrets", "documents"), ("op12_quality", "documents")])
def test_a_row_for_each_row(spark, name, table):
    sf = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, sf).toPandas()
    key = got.columns[0]
    assert sorted(got[key]) == sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())
