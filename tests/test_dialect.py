import pytest

from ashlar.dialect import rewrite, tokens
from ashlar.errors import DialectError

VIEW = lambda n: "v" if n.rpartition(".")[2] in ("parquet", "avro") else None


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1", "SELECT 1"),
        ("SELECT 1 AS one, 'a' AS letter;", "SELECT 1 AS one, 'a' AS letter"),
        ("SELECT *", "SELECT * FROM d"),
        ("select a where b = 'FROM x' limit 3", "select a FROM d where b = 'FROM x' limit 3"),
        ("SELECT COUNT(*) /* FROM */", "SELECT COUNT(*) FROM d /* FROM */"),
        ("SELECT a -- FROM x\nORDER BY a", "SELECT a FROM d -- FROM x\nORDER BY a"),
        ("SELECT * FROM t.parquet WHERE x = 't.parquet'", "SELECT * FROM v WHERE x = 't.parquet'"),
        ("SELECT * FROM 'a b/c.avro' x JOIN \"y.parquet\" y ON x.a = y.a", "SELECT * FROM v x JOIN v y ON x.a = y.a"),
        ("SELECT * FROM db.tab", "SELECT * FROM db.tab"),
        ("WITH q AS (SELECT a FROM t.parquet) SELECT * FROM q", "WITH q AS (SELECT a FROM v) SELECT * FROM q"),
        ("SELECT (SELECT max(x) FROM z) AS m, a", "SELECT (SELECT max(x) FROM z) AS m, a FROM d"),
        ("SELECT sum(x) GROUP BY y", "SELECT sum(x) FROM d GROUP BY y"),
    ],
)
def test_rewrite(sql, want):
    assert rewrite(sql, VIEW, "d") == want


def test_errors():
    with pytest.raises(DialectError):
        rewrite("SELECT * FROM 'nothing'", VIEW, None)
    with pytest.raises(DialectError):
        tokens("SELECT 'open")


def test_tokens():
    assert [t for k, t in tokens("a<>1.23e-4 -- x\n'it''s'") if k != "space"] == ["a", "<>", "1.23e-4", "'it''s'"]
