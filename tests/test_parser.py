"""Statements to trees, and what the grammar refuses."""

import pytest

from tessera.errors import ParseError
from tessera.plans import ast as A
from tessera.plans.parser import parse, split_statements


def test_select():
    s = parse("SELECT t.a, COUNT(*) AS n FROM t LEFT OUTER JOIN u ON t.a = u.b WHERE (a >= 1 OR b <> 'x''y') AND c BETWEEN 1 AND 2.5 GROUP BY t.a ORDER BY n DESC, a LIMIT 3; ignored")
    assert s.table == "t" and s.joins == (A.Join("left", "u", A.Name("a", "t"), A.Name("b", "u")),) and s.limit == 3
    assert s.items[1] == A.Item("aggregate", None, "count", "n") and s.order[0] == A.Key(A.Name("n"), True)
    either, between = s.where.parts
    assert either.parts[1] == A.Compare(A.Name("b"), "!=", "x'y") and between == A.Between(A.Name("c"), 1, 2.5)


def test_search():
    s = parse("SELECT id, SCORE() FROM t WHERE SIMILAR_TO([1, -0.5], k=2) AND x = word USING IVF WITH METRIC = coseno")
    assert s.where.parts[0] == A.Similar((1.0, -0.5), 2) and s.where.parts[1].value == "word" and (s.using, s.metric) == ("ivf", "cosine")
    s = parse("select * from t where match(body, 'a b') using tfidf")
    assert s.where == A.Match("body", "a b") and s.using == "tf_idf"
    s = parse("SELECT * FROM t WHERE DISTANCIA(ubicacion, @casa, euclidiana) < 5 ORDER BY DISTANCE(p, POINT(-12, -77)) DESC")
    assert s.where.left == A.Distance("ubicacion", "casa", "euclidean") and s.order[0].by.point == (-12.0, -77.0)
    assert len(parse("SELECT * FROM t WHERE DENTRO_DE(p, POLYGON((0 0, 0 1, -1 1)))").where.ring) == 3


def test_definitions():
    c = parse("CREATE TABLE IF NOT EXISTS T (a INT, b VARCHAR(5) NOT NULL, c DECIMAL(8,2), d DOUBLE PRECISION, PRIMARY KEY (b)) USING SEQUENTIAL")
    assert c.key == "b" and c.storage == "sequential" and c.columns[1][1] == A.Type("string", 5) and c.if_missing
    i = parse("CREATE UNIQUE INDEX i ON t (a) USING EXTENDIBLE_HASH")
    assert i.unique and i.kind == "hash"
    assert parse("CREATE INDEX ON t(lat, lon) USING GIST").columns == ("lat", "lon")
    assert parse("INSERT INTO t VALUES (1, EXTRACT_FEATURES('a.png', 'image'), NULL, true)").values == (1, A.Features("a.png", "image"), None, True)
    assert parse("UPDATE t SET a = -1, b = 'z' WHERE c = 2").changes == (("a", -1), ("b", "z"))
    assert parse("EXPLAIN ANALYZE DELETE FROM t").analyze
    assert [parse(x).action for x in ("BEGIN", "START TRANSACTION", "END", "COMMIT WORK", "ROLLBACK")] == ["begin", "begin", "commit", "commit", "rollback"]
    assert split_statements("a = 1; -- c;\n 'x;y' ;; b") == ["a = 1", "-- c;\n 'x;y'", "b"]


@pytest.mark.parametrize(
    "text",
    [
        "", "SELECT", "SELECT FROM t", "SELECT * FROM t WHERE", "SELECT * FROM t LIMIT -1", "SELECT * FROM t LIMIT 1.5", "SELECT a FROM t GROUP BY a HAVING a > 1",
        "SELECT * FROM t UNION SELECT * FROM u", "SELECT * FROM t WHERE a LIKE 'x'", "SELECT SUM(*) FROM t", "SELECT * FROM t WHERE MATCH(a, '')",
        "SELECT * FROM t WHERE MATCH(a,'x') OR b = 1", "SELECT * FROM t WHERE MATCH(a,'x') USING IVF", "SELECT * FROM t USING BM25", "SELECT * FROM t WHERE SIMILAR_TO([1], k=0)",
        "SELECT * FROM t WHERE MATCH(a,'x') AND SIMILAR_TO([1])", "SELECT * FROM t WHERE DISTANCIA(p, POINT(1,2)) > 3", "SELECT * FROM t WHERE DISTANCIA(p, POINT(99,2)) < 3",
        "CREATE TABLE t (a DATE)", "CREATE TABLE t (a INT, a INT)", "CREATE INDEX ON t(a) USING RTREE", "CREATE INDEX ON t(a) USING NOPE", "CREATE INDEX ON t(a) USING HASH WITH METRIC = cos",
        "SET x = POINT(91, 0)", "DROP VIEW v", "SELECT * FROM t JOIN u ON a < b", "SELECT * FROM t WHERE WITHIN(p, POLYGON((0 0, 1 1)))",
    ],
)
def test_refused(text):
    with pytest.raises(ParseError):
        parse(text)
