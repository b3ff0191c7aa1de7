"""The operators that SQL can express against DuckDB, on all rows."""

from pathlib import Path

import duckdb
import pytest

from ashlar.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_oracles_on_odd_texts():
    """The SQL itself against the definitions: empty and null texts, one word, stripes of 32 bytes, letters of any script."""
    import xxhash

    from tests.llm.test_llm_operators import print_by_force, removed_by_force

    texts = ["", None, "one", "two words", "a b c", "ÄB  \t\nCd e f " * 9, "x" * 31, "y" * 32 + " z", "w " * 200, "Ω" * 64 + " q r s", "a  b c" * 30, "ab" * 300, "ab" * 30]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    oracle = registry.oracle_sql()
    got = {r[0]: r[1] for r in con.execute(oracle["op9_simhash_near_dedup"]).fetchall()}
    assert got == {i: f"{print_by_force(t):016x}" for i, t in enumerate(texts)} and xxhash.xxh64_intdigest(b"", 42)
    assert sorted(con.execute(oracle["op1_suffix_array_dedup"]).fetchall(), key=repr) == removed_by_force(list(enumerate(texts)))
