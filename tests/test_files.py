import pytest

from quarrysql import DataSet, Frames, Jdbc, Locations, Trees, decodes
from quarrysql.operators.files import contents, decode, pattern
from quarrysql.types import struct


@pytest.fixture
def tree(tmp_path):
    for dept, lines in (("sales", ["id,full_name,pay", "1,Al,10", "2,Bea,20"]), ("ops", ["id,full_name,pay", "3,Cal,30"])):
        (tmp_path / dept).mkdir()
        (tmp_path / dept / "people.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "sales" / "note.txt").write_text("one\ntwo words\n")
    return str(tmp_path)


SCHEMA = [dict(name="dept", type="STRING"), dict(name="id", type="INTEGER"), dict(name="full_name", type="STRING"), dict(name="pay", type="INTEGER")]


def test_pattern():
    assert pattern("/r/{a}/{b}.csv") == ("^/r/([^/]*)/([^/]*)\\.csv", ["a", "b"])


def test_table_functions(spark, tree):
    ds = DataSet(spark)
    assert ds.sql(f"select count() as n from files('{tree}')").first()[0] == 3
    got = ds.sql(f"select dept, name from extract_path((files('{tree}')), '{tree}/{{dept}}/{{name}}.csv') order by dept").collect()
    assert [tuple(r) for r in got] == [("ops", "people"), ("sales", "people")]
    got = ds.sql(f"select contents from contents((select path from files('{tree}') where path like '%.txt'), 'path')").collect()
    assert [r[0] for r in got] == ["one\ntwo words\n"]
    got = ds.sql(f"select path, full_name from decode((select path from files('{tree}') where path like '%.csv'), 'text/csv') order by full_name").collect()
    assert [(r[0].rsplit("/", 2)[1], r[1]) for r in got] == [("sales", "Al"), ("sales", "Bea"), ("ops", "Cal")]


def test_tree_is_pruned_by_path(spark, tree):
    ds = DataSet(spark)
    ds.add_source(Trees(people=dict(root_dir=tree, pattern="{dept}/{file}.csv", decode="text/csv", schema=SCHEMA, filename_column="path")))
    q = "select dept, full_name, pay from people where dept = 'sales' and pay >= 15"
    assert [tuple(r) for r in ds.sql(q).collect()] == [("sales", "Bea", 20)]
    assert [tuple(r) for r in ds.sql("select full_name from people where dept = 'ops' or pay = 10 order by full_name").collect()] == [("Al",), ("Cal",)]
    assert [tuple(r) for r in ds.sql("select full_name from people where not dept = 'ops' and pay between 5 and 15").collect()] == [("Al",)]
    df = ds.sql("select full_name from people where dept = 'sales'")
    scans = df._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in scans


def test_tree_without_schema_reads_strings(spark, tree):
    ds = DataSet(spark)
    ds.add_source(Trees(people=dict(root_dir=tree, pattern="{dept}/{file}.csv", decode="auto")))
    assert ds.get_schema("people").names == ["dept", "file", "id", "full_name", "pay"]
    assert ds.sql("select pay from people where id = '3'").first()[0] == "30"
    with pytest.raises(ValueError):
        Trees(x=dict(root_dir=tree, nix=1))


def test_contents_tree_and_own_codec(spark, tree):
    @decodes("text/plain", schema=[dict(name="words", type="INTEGER"), dict(name="first", type="STRING")])
    def measured(f):
        return [(len(line.split()), line.split()[0]) for line in f if line.strip()]

    ds = DataSet(spark)
    ds.add_source(Trees(notes=dict(root_dir=tree, pattern="{dept}/{name}.txt", content_column="body", filename_column="path")))
    assert [tuple(r) for r in ds.sql("select dept, body from notes").collect()] == [("sales", "one\ntwo words\n")]
    got = ds.sql(f"select words, first from decode((select path from files('{tree}/sales') where path like '%.txt'), 'text/plain') order by words").collect()
    assert [tuple(r) for r in got] == [(1, "one"), (2, "two")]


def test_only_the_files_named_are_read(spark, tmp_path):
    ds = DataSet(spark)
    for day in ("1", "10", "[x] *"):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a b%20.csv").write_text(f"k,v\n{len(day)},one\n")
    (tmp_path / "day=1" / "other.csv").write_bytes(b"\xff\xfe,\n" * 3)
    low, high = str(tmp_path / "day=1" / "a b%20.csv"), str(tmp_path / "day=10" / "a b%20.csv")
    paths = spark.createDataFrame([(low, 1), (high, 2), (high, 3), (None, 4)], "path string, n int")
    ds.add_source(Frames(paths=paths))
    assert sorted(tuple(r) for r in ds.sql("select n, k, v from decode(paths, 'text/csv')").collect()) == [(1, "1", "one"), (2, "2", "one"), (3, "2", "one")]
    assert sorted(tuple(r) for r in ds.sql("select n, contents from contents(paths, 'path')").collect()) == [(1, "k,v\n1,one\n"), (2, "k,v\n2,one\n"), (3, "k,v\n2,one\n")]
    odd = spark.createDataFrame([(str(tmp_path / "day=[x] *" / "a b%20.csv"),)], "path string")
    assert [tuple(r)[1:] for r in decode(odd).collect()] == [("5", "one")]
    assert decode(paths.where("n > 4")).collect() == [] and contents(paths.where("n > 4")).collect() == []


@pytest.mark.parametrize("text, mime, want", [
    ("id;value\n1;a\n2;b\n", "text/csv", (["id", "value"], [("1", "a"), ("2", "b")])),
    ("name,city\nann,rome\n", "text/csv", (["column_0", "column_1"], [("ann", "rome")])),
    ("name,city\nann,rome\n", "text/csv; header=present", (["name", "city"], [("ann", "rome")])),
    ("1,2\n3,4\n", "text/csv; header=absent", (["column_0", "column_1"], [("1", "2"), ("3", "4")])),
    ('id,note\n1,"two\nlines, ""q"""\n2,x\n', "text/csv; header=present", (["id", "note"], [("1", 'two\nlines, "q"'), ("2", "x")])),
    ("id\tv\n1\tx y\n", "text/tab-separated-values; breaks=none; header=present", (["id", "v"], [("1", "x y")])),
])
def test_csv(spark, tmp_path, text, mime, want):
    (tmp_path / "x.csv").write_text(text)
    got = decode(spark.createDataFrame([(str(tmp_path / "x.csv"),)], "path string"), mime)
    assert (got.columns[1:], sorted(tuple(r)[1:] for r in got.collect())) == want


def test_csv_with_a_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text("v,id\nx,1\ny,2\n")
    paths = spark.createDataFrame([(str(tmp_path / "x.csv"),)], "path string")
    assert sorted(tuple(r)[1:] for r in decode(paths, schema=struct([dict(name="id", type="INTEGER"), dict(name="v", type="STRING")])).collect()) == [(1, "x"), (2, "y")]
    assert sorted(tuple(r)[1:] for r in decode(paths, schema=struct([dict(name="a", type="STRING"), dict(name="b", type="INTEGER")])).collect()) == [("x", 1), ("y", 2)]


def test_jdbc(spark):
    """The database that comes with Spark, in the memory of this JVM."""
    url, driver = "jdbc:derby:memory:shop;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark.range(20).selectExpr("id", "cast(id * 2 as double) as price").write.jdbc(url, "goods", properties={"driver": driver})
    except Exception as e:  # noqa: BLE001
        if "ClassNotFound" in str(e) or "EmbeddedDriver" in str(e):
            pytest.skip("no database on the class path")
        raise
    ds = DataSet(spark)
    ds.add_source(Jdbc(url, "goods", driver=driver))
    df = ds.sql("select id from goods where price > 30.0")
    assert sorted(r[0] for r in df.collect()) == [16, 17, 18, 19]
    assert "price" in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_locations_with_partitions(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.partitionBy("k").parquet(str(tmp_path / "t.parquet"))
    ds = DataSet(spark)
    ds.add_source(Locations())
    df = ds.sql(f"select distinct k from '{tmp_path}/t.parquet' where k = 'b'")
    assert [r[0] for r in df.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(k" in df._jdf.queryExecution().toString() or "PartitionFilters: [(k" in df._jdf.queryExecution().toString() or "k#" in df._jdf.queryExecution().toString()
