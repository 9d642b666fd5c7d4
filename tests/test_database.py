import io
import json
import os
import uuid
from dataclasses import replace

import pytest

from tidemark import cli
from tidemark.catalog import Catalog, CatalogError, ConflictError
from tidemark.database import Database
from tidemark.functions import compat
from tidemark.plans import dialect
from tidemark.sources import tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return "file://" + str(tmp_path_factory.mktemp("databases"))


@pytest.fixture
def db(spark, root):
    return Database.create(spark, root, "d" + uuid.uuid4().hex)


USERS = "CREATE TABLE users (id INT PRIMARY KEY, username VARCHAR(10) NOT NULL UNIQUE, email TEXT, ok BOOLEAN, born DATE, at TIME)"


@pytest.fixture
def users(db):
    db.execute(USERS)
    db.execute("INSERT INTO users VALUES (1, 'ann', NULL, true, '2020-01-02', '10:20:30'), (0x10, 'bob', 'b@x', false, NULL, NULL)")
    return db


def one(db, text, session=None):
    return [tuple(r) for r in db.query(text, session).collect()]


@pytest.mark.parametrize(
    "statement",
    [
        "INSERT INTO users (id, username) VALUES (3, 'ann')",
        "INSERT INTO users (id, username) VALUES (3, 'cy'), (3, 'di')",
        "INSERT INTO users (id) VALUES (3)",
        "INSERT INTO users (id, username) VALUES (3, 'far too long for it')",
        "INSERT INTO users (id, username) VALUES ('x', 'cy')",
        "INSERT INTO users (id, username, ok) VALUES (3, 'cy', 'perhaps')",
        "INSERT INTO users (id, username, born) VALUES (3, 'cy', 'yesterday')",
        "INSERT INTO users (id, username, at) VALUES (3, 'cy', '25:00:00')",
        "INSERT INTO users (id, username) VALUES (3)",
        "INSERT INTO users (id, nope) VALUES (3, 'cy')",
        "UPDATE users SET id = 'x'",
        "UPDATE users SET username = 'same'",
        "UPDATE users SET nope = 1",
        "UPDATE users SET ok = true LIMIT 1",
        "DELETE FROM users ORDER BY id LIMIT 1",
        "DELETE FROM nobody",
        "CREATE TABLE users (id INT)",
        "CREATE TABLE odd (id GEOMETRY)",
        "DROP TABLE nobody",
        "ALTER TABLE users DROP COLUMN nope",
        "CREATE INDEX i ON users (nope)",
        "GRANT ALL ON users",
    ],
)
def test_refused(users, statement):
    before = one(users, "SELECT * FROM users ORDER BY id")
    with pytest.raises(Exception):
        users.execute(statement)
    assert one(users, "SELECT * FROM users ORDER BY id") == before


def test_update_delete_and_counts(users):
    assert users.execute("UPDATE users SET email = concat(username, '@m'), id = id + 1 WHERE ok = true") == 1
    assert one(users, "SELECT id, email FROM users ORDER BY id") == [(2, "ann@m"), (16, "b@x")]
    assert users.execute("DELETE FROM users WHERE email LIKE 'b%'") == 1
    assert users.execute("DELETE FROM users WHERE id = 99") == 0
    assert one(users, "SELECT username FROM users") == [("ann",)]


def test_update_rewrites_only_touched_snapshots(users):
    users.execute("INSERT INTO users (id, username) VALUES (50, 'eve')")
    before = users.manifest().table("users").snapshots
    users.execute("UPDATE users SET ok = true WHERE id = 50")
    after = users.manifest().table("users").snapshots
    assert before[0] in after and before[1] not in after


def test_alter(users):
    users.execute("ALTER TABLE users ADD COLUMN age INT")
    users.execute("ALTER TABLE users RENAME COLUMN email TO mail")
    users.execute("ALTER TABLE users DROP COLUMN born")
    users.execute("ALTER TABLE users ADD born TEXT")
    assert one(users, "SELECT mail, age, born FROM users WHERE id = 16") == [("b@x", None, None)]
    users.execute("ALTER TABLE users RENAME TO people")
    assert users.table_names() == ["people"]


def test_transactions(users):
    session = users.begin()
    users.execute("DELETE FROM users", session)
    assert one(users, "SELECT count(*) FROM users", session) == [(0,)]
    assert one(users, "SELECT count(*) FROM users") == [(2,)]
    users.rollback(session)
    first, second = users.begin(), users.begin()
    users.execute("INSERT INTO users (id, username) VALUES (7, 'x')", first)
    users.execute("INSERT INTO users (id, username) VALUES (8, 'y')", second)
    users.commit(first)
    with pytest.raises(ConflictError):
        users.commit(second)
    with pytest.raises(CatalogError):
        users.rollback(second)
    assert one(users, "SELECT max(id) FROM users WHERE id < 10") == [(7,)]


def test_versions_and_vacuum(users):
    version = users.manifest().version
    users.execute("DELETE FROM users")
    assert users.table("users").isEmpty() and users.table("users", version=version).count() == 2
    assert users.catalog.vacuum() == []  # all of them are younger than the grace
    assert not set(users.catalog.vacuum(0)) & {s for v in users.catalog.versions(users.name) for t in users.catalog.load(users.name, v).tables.values() for s in t.snapshots}


def test_vacuum_and_an_open_transaction(users):
    session = users.begin()
    users.execute("INSERT INTO users (id, username) VALUES (7, 'x')", session)
    users.catalog.vacuum()
    assert one(users, "SELECT count(*) FROM users", session) == [(3,)]
    users.catalog.vacuum(0)
    with pytest.raises(CatalogError, match="is gone"):
        users.commit(session)
    assert one(users, "SELECT count(*) FROM users") == [(2,)]


def test_half_a_manifest_is_never_read(users):
    before = users.manifest()
    folder = f"{users.catalog.root}/{users.name}".removeprefix("file://")
    with open(f"{folder}/.half.json", "w") as f:
        f.write('{"version":')
    assert users.manifest() == before
    with pytest.raises(ConflictError):
        users.catalog.publish(users.name, replace(before, version=before.version - 1))
    assert users.manifest() == before and not [n for n in os.listdir(folder) if n.startswith(".") and n.endswith(".json") and n != ".half.json"]
    with pytest.raises(Exception) as other:  # another failure is not taken for a conflict
        users.catalog.publish("no-such-folder/x" * 400, before)
    assert not isinstance(other.value, ConflictError)


def test_keys_over_several_columns(db):
    db.execute("CREATE TABLE t (UNIQUE (b, c), a INT, b INT, c TEXT, PRIMARY KEY (a, b))")
    db.execute("INSERT INTO t VALUES (1, 1, 'x'), (1, 2, 'x'), (2, 1, NULL), (3, 1, NULL)")
    for bad in ("(1, 2, 'new')", "(9, 1, 'x')", "(5, 5, 'y'), (6, 5, 'y')", "(NULL, 8, 'z')"):
        with pytest.raises(Exception):
            db.execute(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(Exception):
        db.execute("UPDATE t SET b = 1 WHERE b = 2")
    with pytest.raises(CatalogError):
        db.execute("ALTER TABLE t DROP COLUMN b")
    with pytest.raises(ValueError):
        db.execute("CREATE TABLE u (a INT, UNIQUE (a, nope))")
    assert one(db, "SELECT count(*) FROM t") == [(4,)]
    with pytest.raises(Exception):
        db.execute("CREATE UNIQUE INDEX i ON t (c)")
    db.execute("DELETE FROM t WHERE b = 2")
    db.execute("CREATE UNIQUE INDEX i ON t (c)")
    with pytest.raises(Exception):
        db.execute("INSERT INTO t VALUES (7, 7, 'x')")


def test_existence_clauses_and_create_database(db):
    db.execute("CREATE TABLE IF NOT EXISTS t (a INT)")
    db.execute("INSERT INTO t VALUES (1)")
    assert db.execute("CREATE TABLE IF NOT EXISTS t (b TEXT)") == 0 and one(db, "SELECT a FROM t") == [(1,)]
    db.execute("DROP TABLE IF EXISTS t")
    assert db.execute("DROP TABLE IF EXISTS t") == 0 and db.table_names() == []
    name = "n" + uuid.uuid4().hex
    db.execute(f"CREATE DATABASE {name}")
    db.execute(f"CREATE DATABASE IF NOT EXISTS {name}")
    with pytest.raises(CatalogError):
        db.execute(f"CREATE DATABASE {name}")
    assert Database(db.catalog.spark, db.catalog.root, name).table_names() == []


def test_names_of_result_columns(users):
    users.execute("CREATE TABLE pets (id INT, owner INT, name TEXT)")
    names = lambda text: users.query(text).columns
    whole = [f"users.{c}" for c in "id username email ok born at".split()]
    assert names("SELECT * FROM users") == whole
    assert names("SELECT DISTINCT u.*, p.name, count(*) OVER () FROM users u JOIN pets AS p ON u.id = p.owner ORDER BY 1 LIMIT 3")[:7] == [f"u.{c.split('.')[1]}" for c in whole] + ["p.name"]
    assert names("SELECT p.*, users.* FROM users, pets p") == ["p.id", "p.owner", "p.name", *whole]
    assert names("SELECT COUNT(*), sum(users.id), Avg(DISTINCT id), MAX(id) AS top, min(id + 1), username name FROM users GROUP BY username") == ["COUNT(*)", "SUM(id)", "AVG(DISTINCT id)", "top", "MIN(id + 1)", "name"]
    assert names("WITH a AS (SELECT id FROM users) SELECT a.id, 1 + 1 AS two FROM a UNION SELECT id, 2 FROM users") == ["a.id", "two"]
    with pytest.raises(Exception, match="(?i)ambiguous"):
        users.query("SELECT id FROM users JOIN pets ON users.id = pets.owner")
    assert [sorted(json.loads(r)) for r in users.rows("SELECT * FROM pets, users")] == []
    assert len(list(users.rows("SELECT id, id FROM users"))) == 2


def test_compaction(users):
    rows = "; ".join(f"INSERT INTO users (id, username) VALUES ({k}, 'u{k}')" for k in range(100, 132))
    assert all(error is None for _, error in users.run_script(rows))
    assert len(users.manifest().table("users").snapshots) == 1 and one(users, "SELECT count(*) FROM users") == [(34,)]
    assert users.compact("users") == 1


def test_update_with_a_subquery_and_chance(users):
    assert users.execute("UPDATE users SET email = 'top' WHERE id IN (SELECT max(id) FROM users)") == 1
    assert sorted(one(users, "SELECT id, email FROM users")) == [(1, None), (16, "top")]
    users.execute("UPDATE users SET email = 'luck' WHERE rand() < 0.5 OR id = 1")
    assert sorted(r[0] for r in one(users, "SELECT id FROM users")) == [1, 16]


def test_times_in_any_layout_within_sql(users):
    found = one(users, "SELECT id FROM users WHERE any_time('01/02/2020') = any_time('2020-01-02 00:00:00') AND born = any_time('01-02-2020')")
    assert found == [(1,)]


def test_command_line(spark, root, tmp_path, capsys, monkeypatch):
    name, run = "c" + uuid.uuid4().hex, lambda *a: cli.main(["--root", root, *a])
    assert run("create", name) == 0
    script = tmp_path / "script.sql"
    script.write_text("CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, NULL); SELECT broken;")
    assert run("migrate", name, str(script)) == 1
    assert run("query", name, "SELECT * FROM t ORDER BY a") == 0
    out = capsys.readouterr().out.splitlines()
    assert out[-2:] == ['{"t.a":1,"t.b":"x"}', '{"t.a":2,"t.b":null}'] and out[2].startswith("failed: ")
    assert run("execute", name, "DELETE FROM t WHERE a = 1") == 0 and run("execute", name, "SELECT a FROM t") == 0 and run("tables", name) == 0
    run("fork", name, name + "f")
    run("export", name, f"file://{tmp_path}/json")
    run("archive", name, f"file://{tmp_path}/archive")
    run("restore", name + "r", f"file://{tmp_path}/archive")
    run("create", name + "i")
    assert run("import", name + "i", f"file://{tmp_path}/json") == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("BEGIN;\nINSERT INTO t VALUES (5, 'y');\nROLLBACK;\nSELECT nope;\nSELECT count(*) FROM t;\n"))
    run("shell", name + "r")
    assert "|1       |" in capsys.readouterr().out
    assert run("drop", name + "f") == 0


def test_fork_and_drop(users):
    other = users.fork(users.name + "-fork")
    other.execute("DROP TABLE users")
    assert users.table_names() == ["users"] and other.table_names() == []
    users.catalog.drop(other.name)
    with pytest.raises(CatalogError):
        Database(users.catalog.spark, users.catalog.root, other.name)


def test_exports(users, tmp_path):
    path = f"file://{tmp_path}"
    rows = sorted(one(users, "SELECT * FROM users"))
    tables.export_database(users, f"{path}/json")
    copy = Database.create(users.catalog.spark, users.catalog.root, users.name + "-json")
    assert tables.import_database(copy, f"{path}/json") == {"users": 2}
    assert sorted(one(copy, "SELECT * FROM users")) == rows
    tables.export_archive(users, f"{path}/archive")
    assert sorted(one(tables.import_archive(users.catalog, f"{path}/archive", users.name + "-archive"), "SELECT * FROM users")) == rows


def test_owner(spark, root):
    own = Database.create(spark, root, "o" + uuid.uuid4().hex, signed=True)
    own.execute("CREATE TABLE t (a INT)")
    other = Database(spark, root, own.name)
    with pytest.raises(PermissionError):
        other.execute("DROP TABLE t")
    with pytest.raises(PermissionError):
        other.execute("DROP TABLE t", signature="00")
    assert one(other, "SELECT count(*) FROM t") == [(0,)]


def test_names_and_catalog(spark, root):
    catalog = Catalog(spark, root)
    with pytest.raises(CatalogError):
        catalog.create("../up")
    with pytest.raises(CatalogError):
        Database(spark, root, "nobody")


def test_scripts(db):
    out = db.run_script("""
      /* two; tables */ CREATE TABLE "My Orders" ("item-name" VARCHAR(100), "quantity" INT); -- ; not here
      INSERT INTO "My Orders" VALUES ('a;b -- ''c''', 0b101);
      SELECT broken FROM nowhere;
      BEGIN; DELETE FROM "My Orders"; ROLLBACK;
    """)
    assert [e is None for _, e in out] == [True, True, False, True, True, True]
    assert one(db, 'SELECT "item-name", "quantity" FROM "My Orders"') == [("a;b -- 'c'", 5)]
    assert db.execute('UPDATE "My Orders" SET "quantity" = "quantity" * 2 WHERE "item-name" LIKE \'a%\'') == 1
    assert one(db, 'SELECT "quantity" FROM "My Orders"') == [(10,)]


def test_sales_goldens(db):
    # The rows of the published sales table (id, category, region, amount, quantity) and their results.
    db.execute("CREATE TABLE sales (id INT, category VARCHAR(50), region VARCHAR(50), amount FLOAT, quantity INT)")
    db.execute("""INSERT INTO sales VALUES (1,'electronics','north',120.50,2),(2,'books','south',15.00,3),(3,'electronics','north',75.00,1),
      (4,'clothing','west',45.99,5),(5,'books','north',25.00,2),(6,'clothing','south',80.25,2),(7,'electronics','west',250.00,1),(8,'books','south',10.00,1)""")
    ids = lambda text: [r[0] for r in one(db, text)]
    assert ids("SELECT id FROM sales ORDER BY amount DESC") == [7, 1, 6, 3, 4, 5, 2, 8]
    assert ids("SELECT id FROM sales ORDER BY category, amount DESC") == [5, 2, 8, 6, 4, 7, 1, 3]
    assert ids("SELECT id FROM sales ORDER BY amount DESC LIMIT 3, 2") == [3, 4]
    assert ids("SELECT id FROM sales ORDER BY amount DESC LIMIT 1 UNION ALL SELECT id FROM sales WHERE id = 2") == [7, 2]
    assert one(db, "SELECT COUNT(*), SUM(quantity), AVG(amount), MIN(amount), MAX(amount) FROM sales") == [(8, 17, 77.7175, 10.0, 250.0)]
    assert sorted(one(db, "SELECT region, SUM(amount) FROM sales GROUP BY region")) == [("north", 220.5), ("south", 105.25), ("west", 295.99)]


def test_dialect():
    assert dialect.for_spark("SELECT 0xFF, '0xFF', 0b11 FROM t LIMIT 3, 2") == "SELECT 255, '0xFF', 3 FROM t LIMIT 2 OFFSET 3"
    assert dialect.statements("a; 'b;c' -- d;\n; /* ; */ e") == ["a", "'b;c'", "e"]
    assert dialect.split_top("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]


def test_compat(spark):
    df = spark.createDataFrame([("10", "10.0"), (None, None), ("a", "b")], "a string, b string")
    got = df.select(compat.null_equal(df.a, df.b), compat.number_equal(df.a, df.b)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, None), (False, False)]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("01/02/2024",), ("01-02-2024",), ("x",)], "t string")
    assert [r[0] is not None for r in times.select(compat.any_time(times.t)).collect()] == [True] * 5 + [False]
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert [r.x for r in compat.not_in_ignoring_nulls(rows, "x", keys, "k").collect()] == [2]
    assert compat.group_without_nulls(rows, "x").count().count() == 2
    none, known = keys.filter("false"), keys.filter("k is not null")
    got = [sorted(str(r.x) for r in compat.not_in(rows, "x", k, "k").collect()) for k in (keys, known, none)]
    assert got == [[], ["2"], ["1", "2", "None"]]
