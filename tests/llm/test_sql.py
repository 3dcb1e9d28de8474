"""The queries with a DuckDB text against it, on the whole sf0.001 and sf0.01 tables."""

import duckdb
import pytest

from demandcast.llm.queries import ORACLE_SQL, QUERIES


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    out = QUERIES[name](spark, folder)
    assert sorted(out.columns) == sorted(columns)
    got = sorted((tuple(map(plain, r)) for r in out.select(*columns).collect()), key=str)
    assert got == want


def test_terms_equal_their_sql(spark, tmp_path):
    """A corpus in which terms do disclose entities."""
    from demandcast.llm.privacy import personal_spans
    from test_native_operators import term_corpus
    rows = term_corpus() + [(300, None), (301, "zorblatt 1.2.3.4 and zorblatt 1.2.3.4"),
                            (302, "zorblatt 1.2.3.4 once more, zorblatt")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[-1] for r in con.execute(ORACLE_SQL["op4_pii"]).fetchall()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)
           for r in personal_spans(docs).collect()}
    assert got == want and any("term" in v for v in want.values())
