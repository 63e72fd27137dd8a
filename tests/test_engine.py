"""Statements end to end with literal results."""

import threading

import pytest

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.locks import KeyValueTransaction, LockManager, LockTimeout
from tessera.plans import ast as A
from tessera.sources import csvio, products


def fill(e, name, ddl, rows):
    e.execute(f"CREATE TABLE {name} ({ddl})", True)
    df = e.spark.createDataFrame(rows, e.catalog.schema(name))
    e.catalog.append(name, df)


@pytest.fixture(scope="module")
def school(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("school")))
    fill(e, "alumnos", "id INT PRIMARY KEY, nombre VARCHAR(20), nota FLOAT, carrera VARCHAR(10)", [(1, "Ana", 18.5, "CS"), (2, "Luis", 12.0, "CS"), (3, "Marta", 15.5, "DS"), (4, "Ivan", 9.5, "DS"), (5, "Rosa", 19.0, "CS"), (6, "Hugo", 14.0, "IA")])
    fill(e, "matriculas", "matricula INT PRIMARY KEY, id_alumno INT, nombre VARCHAR(10)", [(10, 1, "BD"), (11, 1, "IA"), (12, 3, "BD"), (13, 4, "SO"), (14, 6, "BD"), (15, 99, "SO")])
    return e


def rows(e, text):
    return e.execute(text, True).rows


def test_filters_and_order(school):
    assert [r["id"] for r in rows(school, "SELECT id FROM alumnos WHERE nota >= 14 ORDER BY id")] == [1, 3, 5, 6]
    assert [r["id"] for r in rows(school, "SELECT id FROM alumnos WHERE carrera = CS AND nota < 19 OR id = 6 ORDER BY nota DESC")] == [1, 6, 2]
    assert rows(school, "SELECT * FROM alumnos WHERE id = 999") == []
    assert school.execute("SELECT * FROM alumnos LIMIT 0").columns == ["id", "nombre", "nota", "carrera"]


def test_joins(school):
    j = rows(school, "SELECT * FROM alumnos JOIN matriculas ON alumnos.id = matriculas.id_alumno ORDER BY matricula")
    assert len(j) == 5 and j[0]["nombre"] == "Ana" and j[0]["matriculas.nombre"] == "BD"
    assert len(rows(school, "SELECT id FROM alumnos LEFT JOIN matriculas ON id = id_alumno")) == 7
    full = rows(school, "SELECT id, matricula FROM alumnos FULL JOIN matriculas ON id = id_alumno ORDER BY id DESC")
    assert len(full) == 8 and full[0]["id"] is None


def test_groups(school):
    assert rows(school, "SELECT carrera, COUNT(*) AS n, AVG(nota) FROM alumnos GROUP BY carrera ORDER BY n DESC") == [{"carrera": "CS", "n": 3, "avg_nota": 16.5}, {"carrera": "DS", "n": 2, "avg_nota": 12.5}, {"carrera": "IA", "n": 1, "avg_nota": 14.0}]
    assert rows(school, "SELECT COUNT(*), SUM(nota), MIN(nota) FROM alumnos WHERE id < 0") == [{"count_all": 0, "sum_nota": 0.0, "min_nota": None}]
    assert len(rows(school, "SELECT carrera FROM alumnos GROUP BY carrera")) == 3


@pytest.mark.parametrize("text", ["SELECT nope FROM alumnos", "SELECT * FROM nope", "SELECT id FROM alumnos ORDER BY nope", "SELECT id, COUNT(*) FROM alumnos", "SELECT * FROM alumnos GROUP BY id", "SELECT SCORE() FROM alumnos", "SELECT id FROM alumnos WHERE nota = 'abc'", "DELETE FROM alumnos WHERE MATCH(nombre, 'x')"])
def test_errors(school, text):
    r = school.execute(text)
    assert not r.success and r.error
    with pytest.raises(EngineError):
        school.execute(text, raise_on_error=True)


def test_writes_and_transactions(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    fill(e, "c", "id INT, saldo INT, nombre VARCHAR(3)", [(1, 100, "áéí"), (2, 5, "b")])
    assert rows(e, "SELECT nombre FROM c WHERE id = 1") == [{"nombre": "á"}]  # three bytes hold one and a half
    assert e.execute("UPDATE c SET saldo = 90 WHERE id = 1").affected_rows == 1
    assert not e.execute("INSERT INTO c VALUES (1, 1, 'x')").success and not e.execute("INSERT INTO c VALUES (3, 1)").success
    assert not e.execute("UPDATE c SET id = 2 WHERE id = 1").success
    for s in ("BEGIN", "DELETE FROM c", "CREATE TABLE d (k INT)", "CREATE INDEX i ON c(saldo) USING BPLUS_CLUSTERED"):
        assert e.execute(s).success, s
    assert not e.execute("BEGIN").success
    assert rows(e, "SELECT * FROM c") == []
    e.execute("ROLLBACK", True)
    assert len(rows(e, "SELECT * FROM c")) == 2 and "d" not in e.catalog.tables and "i" not in e.catalog.table("c")["indexes"]
    for s in ("BEGIN", "DROP TABLE c", "ROLLBACK", "BEGIN", "INSERT INTO c VALUES (7, 7, z)", "COMMIT"):
        e.execute(s, True)
    back = Engine(spark, str(tmp_path))  # another session reads the manifest
    assert sorted(r["id"] for r in rows(back, "SELECT id FROM c")) == [1, 2, 7]
    assert not back.execute("DROP INDEX pk_c").success and back.execute("DROP TABLE IF EXISTS zzz").success
    assert back.execute("DROP TABLE c").success and not back.execute("SELECT * FROM c").success


def test_text_vector_space(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    fill(e, "d", "id INT, contenido VARCHAR(200), idioma VARCHAR(5)", [(1, "base de datos vectorial", "es"), (2, "machine learning", "en"), (3, "base de datos", "es")])
    assert [r["id"] for r in rows(e, "SELECT id, SCORE() AS s FROM d WHERE MATCH(contenido, 'base de datos') USING BM25")] == [3, 1]
    assert [r["id"] for r in rows(e, "SELECT id FROM d WHERE MATCH(contenido, 'base learning') AND idioma = en")] == [2]
    assert not e.execute("SELECT id FROM d WHERE MATCH(contenido, '!!')").success and not e.execute("SELECT id FROM d WHERE MATCH(contenido, 'x') AND idioma = fr").success
    fill(e, "v", "id INT, embedding VARCHAR(500), c VARCHAR(5)", [(1, "[1,0]", "a"), (2, "[0,1]", "b"), (3, "0.8,0.6", "b"), (4, "bad", "a")])
    for q, k, m, want in (("[1,0]", 2, "cosine", [1, 3]), ("[2,0]", 3, "euclidean", [1, 3, 2]), ("[2,0]", 2, "dot", [1, 3])):
        assert [r["id"] for r in rows(e, f"SELECT id FROM v WHERE SIMILAR_TO({q}, k={k}) USING HNSW WITH METRIC={m}")] == want
    assert {r["id"] for r in rows(e, "SELECT id FROM v WHERE SIMILAR_TO([1,0]) AND c = b")} == {2, 3}
    assert not e.execute("SELECT id FROM v WHERE SIMILAR_TO(c)").success and not e.execute("SELECT id FROM v WHERE SIMILAR_TO('a.png')").success
    with pytest.raises(Exception):
        rows(e, "SELECT id FROM v WHERE SIMILAR_TO([1,0,0])")
    fill(e, "t", "id INT, lat FLOAT, lon FLOAT", [(1, 0.0, 0.0), (2, 0.0, 0.01), (3, 1.0, 1.0), (4, 0.5, 0.0)])
    e.execute("CREATE INDEX g ON t(lat, lon) USING RTREE", True)
    e.execute("SET casa = POINT(0, 0)", True)
    assert [r["id"] for r in rows(e, "SELECT id FROM t WHERE DISTANCIA(ubicacion, @casa) <= 1200")] == [1, 2]
    assert [r["id"] for r in rows(e, "SELECT id FROM t WHERE id > 1 ORDER BY DISTANCIA(ubicacion, casa, euclidean) LIMIT 2")] == [2, 4]
    assert {r["id"] for r in rows(e, "SELECT id FROM t WHERE DENTRO_DE(ubicacion, POLYGON((0 0, 1 0, 1 1, 0 1)))")} == {1, 2, 3, 4}
    assert e.execute("DELETE FROM t WHERE DISTANCIA(ubicacion, casa) < 100").affected_rows == 1
    plan = e.execute("EXPLAIN ANALYZE SELECT id FROM t WHERE DISTANCIA(ubicacion, casa) <= 1200").execution_plan
    assert plan["planner_type"] == "spatial" and plan["analyze"]["rows"] == 1 and "PushedFilters" in plan["spark"]
    assert e.query(A.Query("t", where=A.Compare(A.Name("id"), "=", 3))).first()["lat"] == 1.0
    assert {t["name"]: t["rows"] for t in e.tables()}["t"] == 3


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text(' Id ,Nombre,Nota,Vacio\n1,"Pérez, Juan",12.9,\n2,Ana,,\n\nx,Bad,1,\n2,Twice,3,\n4,Short\n', encoding="utf-8")
    got = dict(csvio.infer(spark, str(f)))
    assert got["id"].kind == "string" and got["nota"].kind == "double" and got["vacio"].kind == "int"
    e = Engine(spark, str(tmp_path / "w"))
    e.execute("CREATE TABLE a (nota INT, id INT PRIMARY KEY, nombre VARCHAR(30))", True)
    r = csvio.import_into(e.catalog, "a", str(f))
    assert r["inserted"] == 2 and r["failed"] == 3 and r["errors"]
    assert rows(e, "SELECT nota, nombre FROM a WHERE id = 1") == [{"nota": 12, "nombre": "Pérez, Juan"}]
    with pytest.raises(EngineError):
        csvio.import_new(e.catalog, "b", str(f), "nombre")
    assert "b" not in e.catalog.tables


def test_locks():
    m = LockManager(0.05)
    m.acquire("a", "t", "S")
    m.acquire("b", "t", "S")
    with pytest.raises(LockTimeout):
        m.acquire("a", "t", "X")
    m.release("b")
    m.acquire("a", "t", "X")
    with pytest.raises(LockTimeout):
        m.acquire("b", "t", "S")
    store, locks = {"saldo": 100}, LockManager(5)

    def add(n):
        t = KeyValueTransaction(store, locks)
        t.write("saldo", t.read("saldo", for_update=True) + n)
        t.commit()

    threads = [threading.Thread(target=add, args=(n,)) for n in (-10, 100)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store["saldo"] == 190
    t = KeyValueTransaction(store, locks)
    t.write("saldo", 0), t.write("new", 1), t.rollback()
    assert store == {"saldo": 190}


def test_products(spark):
    df = spark.createDataFrame([("1", " A  b ", "1.234,56", "x_y"), ("2", "C", "S/ 1,234.5", ""), ("3", "D", "12", "z")], "SKU string, Title string, Price string, Category string")
    got = products.normalise(df).orderBy("id").collect()
    assert [r.precio for r in got] == [1234.56, 1234.5, 12.0] and got[0].categoria == "X Y" and got[1].categoria == "General" and got[0].nombre == "A b"
    with pytest.raises(EngineError):
        products.normalise(df.unionByName(df))
