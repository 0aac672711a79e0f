import datetime as dt
import math

import pytest
from pyspark.sql import types as T

from quarrysql import DataSet, Dicts, Frames, replace_views
from quarrysql.plans.binder import BindError
from quarrysql.types import declared, struct

STAFF = dict(
    schema=dict(fields=[
        dict(name="id", type="INTEGER"), dict(name="name", type="STRING"), dict(name="since", type="DATE"), dict(name="boss", type="INTEGER"),
        dict(name="skills", type="STRING", mode="REPEATED"), dict(name="home", type="RECORD", fields=[dict(name="city", type="STRING"), dict(name="zip", type="INTEGER")]),
        dict(name="jobs", type="RECORD", mode="REPEATED", fields=[dict(name="at", type="STRING"), dict(name="years", type="INTEGER")]),
    ]),
    rows=[
        dict(id=1, name="Ada", since=dt.date(2001, 2, 3), skills=["x", "y"], home=dict(city="A", zip=1), jobs=[dict(at="p", years=2), dict(at="q", years=3)]),
        dict(id=2, name="Bo", since=dt.date(2005, 1, 1), boss=1, home=None),
        dict(id=3, name="Cy", since=dt.date(2003, 1, 1), boss=1, skills=["z"], home=dict(city="B", zip=None), jobs=[]),
    ],
)


@pytest.fixture
def ds(spark):
    ds = DataSet(spark)
    ds.add_source(Dicts(staff=STAFF, plain=[dict(a=1, b="u"), dict(a=2, b="v")]))
    ds.add_source(Dicts(**{"db.t": dict(schema=[dict(name="x", type="INTEGER")], rows=[dict(x=7)])}))
    return ds


def rows(ds, text, *params):
    return [tuple(r) for r in ds.sql(text, *params).collect()]


def test_dual_and_params(ds):
    assert rows(ds, "select 1, 'b' as b") == [(1, "b")]
    assert rows(ds, "select ?0 as v, ?1 as w", 5, "z") == [(5, "z")]
    assert ds.sql("select 1, 2").columns == ["?column?", "?column?_2"]


def test_null_safe_equality(ds):
    assert rows(ds, "select id from staff where boss = null") == [(1,)]
    assert sorted(rows(ds, "select id from staff where boss != null")) == [(2,), (3,)]
    assert sorted(rows(ds, "select id from staff where not boss = 1")) == [(1,)]
    assert rows(ds, "select a.id, b.id from staff a join staff b on a.boss = b.boss where a.boss is null") == [(1, 1)]


def test_floor_division(ds):
    assert rows(ds, "select -7 / 2 as a, 7 / -2 as b, 7 / 2 as c, 7.0 / 2 as d, -8 / 2 as e") == [(-4, -4, 3, 3.5, -4)]


def test_null_group_comes_first(ds):
    assert rows(ds, "select boss, count() from staff group by boss order by boss") == [(None, 1), (1, 2)]
    assert ds.sql("select boss, count() from staff group by boss").columns == ["boss", "count"]


def test_self_join_keeps_column_order_and_qualifiers(ds):
    q = "select e.name, m.name as boss from staff e join staff as m on e.boss = m.id order by e.id"
    assert rows(ds, q) == [("Bo", "Ada"), ("Cy", "Ada")]
    both = ds.sql("select * from (select id, boss from staff) e join (select id, name from staff) m on e.boss = m.id")
    assert both.columns == ["id", "boss", "id_2", "name"]
    assert rows(ds, "select m.* from staff e join (select id, name from staff) m on e.boss = m.id where e.id = 2") == [(1, "Ada")]


def test_left_join_with_empty_right(ds):
    assert rows(ds, "select a.id, b.id from staff a left join (select * from staff where id > 9) b on a.id = b.id order by $0") == [(1, None), (2, None), (3, None)]


def test_flatten(ds):
    assert sorted(rows(ds, "select id, skills from flatten(staff, 'skills')")) == [(1, "x"), (1, "y"), (3, "z")]
    assert sorted(rows(ds, "select id, home_city, home_zip from flatten(staff, 'home')")) == [(1, "A", 1), (3, "B", None)]
    assert ds.sql("select * from flatten(staff, 'home')").columns == ["id", "name", "since", "boss", "skills", "home_city", "home_zip", "jobs"]
    assert sorted(rows(ds, "select id, jobs_at, jobs_years from flatten((select id, jobs from staff), 'jobs')")) == [(1, "p", 2), (1, "q", 3)]
    with pytest.raises(ValueError):
        ds.sql("select * from flatten(staff, 'name')")


def test_order_limit_offset(ds):
    assert rows(ds, "select id from staff order by id limit 1 offset 1") == [(2,)]
    assert rows(ds, "select name from staff order by name desc") == [("Cy",), ("Bo",), ("Ada",)]
    assert rows(ds, "select id from staff order by since desc, 1") == [(2,), (3,), (1,)]
    assert rows(ds, "select id from staff order by boss desc, id") == [(2,), (3,), (1,)]
    assert rows(ds, "select name from staff order by id limit 1") == [("Ada",)]


def test_aggregates(ds):
    assert rows(ds, "select count(*) + 1 as n, min_by(name, since) as first, max(id) as m from staff") == [(4, "Ada", 3)]
    assert rows(ds, "select count() as n, max(id) as m from staff where id > 9") == [(0, None)]
    assert rows(ds, "select count(distinct boss) as n from staff") == [(1,)]
    assert rows(ds, "select boss, count(*) as n from staff group by boss having n > 1") == [(1, 2)]
    with pytest.raises(BindError):
        ds.sql("select name, count() from staff")
    assert sorted(rows(ds, "select boss, name from staff where id < 3 group by boss"), key=str) == [(1, "Bo"), (None, "Ada")]


def test_union_checks_types(ds):
    assert sorted(rows(ds, "select id from staff union all select a from plain")) == [(1,), (1,), (2,), (2,), (3,)]
    assert len(rows(ds, "select id from staff union all select null")) == 4
    with pytest.raises(BindError):
        ds.sql("select id from staff union all select name from staff")
    with pytest.raises(BindError):
        ds.sql("select id from staff union all select id, name from staff")


def test_names(ds):
    with pytest.raises(BindError, match="ambiguous"):
        ds.sql("select id from staff a join staff b on a.id = b.id")
    with pytest.raises(BindError, match="no column"):
        ds.sql("select nix from staff")
    with pytest.raises(LookupError):
        ds.sql("select * from nix")
    assert rows(ds, "select x from db.t") == [(7,)]
    assert rows(ds, "select $0, $1 from plain where $1 = 'v'") == [(2, "v")]


def test_views_bind_early(ds):
    ds.create_view("v", "select id, name from staff where id < 3")
    ds.create_view("w", "select name from v where id > 1")
    ds.create_view("staff", "select id from staff where id = 3")
    assert rows(ds, "select * from w") == [("Bo",)] and rows(ds, "select * from staff") == [(3,)]


def test_functions(ds):
    ds.add_function("twice", lambda x: None if x is None else 2 * x, dict(name="twice", type="INTEGER"))
    assert rows(ds, "select twice(id) from staff order by id") == [(2,), (4,), (6,)]
    with pytest.raises(ValueError):
        ds.add_function("twice", len)

    @ds.function(returns="string")
    def hello(x):
        return f"hi {x}"

    assert rows(ds, "select hello(name) as h from staff where id = 1") == [("hi Ada",)]
    ds.add_aggregate("joined", lambda s, x: s + [x], dict(name="joined", type="STRING"), initial=list, finalize=lambda s: "".join(sorted(s)))
    assert rows(ds, "select joined(name) as j, count(*) as n from staff") == [("AdaBoCy", 3)]

    @ds.aggregate(returns=dict(type="INTEGER"), initial=0)
    def tally(state):
        return state + 1

    assert rows(ds, "select tally() as n from staff") == [(3,)]
    ds.add_function("letters", lambda: ((c,) for c in "ab"), returns=lambda: [dict(name="c", type="STRING")])
    assert rows(ds, "select c from letters()") == [("a",), ("b",)]
    with pytest.raises(NameError):
        ds.sql("select nix(1)")


def resident(most, x):
    """The most MB that the process which folds held at its first row and every 50,000 rows."""
    if x % 50_000:
        return most
    with open("/proc/self/statm") as f:
        return max(most, int(f.read().split()[1]) * 4096 // 2**20)


def test_folds_take_large_groups_row_by_row(spark, ds):
    ds.add_source(Frames(many=spark.range(2_000_000)))
    ds.add_aggregate("resident", resident, "bigint", 0)
    ds.add_aggregate("total", lambda s, x: s + x, "bigint", 0)
    got = rows(ds, "select id < 0 as k, total(id) as t, count() as n, resident(id) as mb from many group by k")
    assert got[0][:3] == (False, 1_999_999_000_000, 2_000_000) and len(got) == 1
    assert got[0][3] < 500


def test_folds_over_batches_and_odd_keys(spark, ds):
    table = spark.range(30_000).selectExpr(
        "id", "id % 3 as g", "if(id % 5 = 0, null, id) as x", "if(id < 25000, 0, id) as uneven", "map('b', id % 2, 'a', 1) as m", "named_struct('p', array(map(id % 2, 1))) as s",
        "case id % 4 when 0 then double('NaN') when 1 then -0.0d when 2 then 0.0d end as d", "collate(if(id % 2 = 0, 'a', 'A'), 'UTF8_LCASE') as c", "timestamp_seconds(id) as at", "binary(string(id % 2)) as b",
    )
    ds.add_source(Frames(t=table, none=table.limit(0)))
    ds.add_aggregate("total", lambda s, x: s + (x or 0), "bigint", 0)
    ds.add_aggregate("tally", lambda s: [s[0] + 1], "bigint", lambda: [0], lambda s: s[0])
    ds.add_aggregate("best", lambda s, x, y: max(s, (y, x or 0)), "struct<y bigint, x bigint>", (-1, 0))
    ds.add_aggregate("last", lambda s, *args: repr(args), "string")
    for key in ("g", "x", "uneven", "m", "s", "d", "c", "null"):
        got = rows(ds, f"select {key} as k, tally() as n, count() as m, total(x) as t, sum(x) as u, best(x, id) as y, max(id) as z from t group by k")
        assert all(n == m and t == (u or 0) and y[0] == z for _, n, m, t, u, y, z in got)
        assert sum(n for _, n, *_ in got) == 30_000
        assert len(got) == {"g": 3, "x": 24_001, "uneven": 5_001, "m": 2, "s": 2, "d": 3, "c": 1, "null": 1}[key]
    assert rows(ds, "select tally() + 1 as n, total(x) from t") == [(30_001, 360_000_000)]
    assert rows(ds, "select tally(), total(x), count() as n from none") == [(0, 0, 0)] and rows(ds, "select g, tally() from none group by g") == []
    assert rows(ds, "select g from t group by g having total(id) > 149990000 order by total(id) desc") == [(2,), (1,)]
    assert rows(ds, "select last(1, null) as a, last(1.0, null) as b from t") == [("(1, None)", "(1.0, None)")]
    assert rows(ds, "select last(m, s, d, at, b) as a from t where id = 29996") == [("({'b': 0, 'a': 1}, Row(p=[{0: 1}]), nan, datetime.datetime(1970, 1, 1, 8, 19, 56), b'0')",)]
    with pytest.raises(BindError):
        ds.sql("select total(tally()) from t")


def test_folds_in_streams(spark, ds, tmp_path):
    from quarrysql.streaming import Streams

    spark.range(10).write.parquet(str(tmp_path / "in"))
    ds.add_source(Streams(flow=dict(format="parquet", path=str(tmp_path / "in"), schema="id long")))
    ds.add_aggregate("total", lambda s, x: s + x, "bigint", 0)
    q = ds.sql("select id > 4 as k, total(id) as t, count() as n from flow group by k").writeStream.format("memory").outputMode("complete").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == [(False, 10, 5), (True, 35, 5)]


def test_strings_and_mathematics(ds):
    got = rows(ds, "select capwords('  hello  wORLD '), length('abc'), find('abc', 'z'), rfind('abab', 'b'), zfill('-7', 4), swapcase('aB'), center('a', 4)")
    assert got == [("Hello World", 3, -1, 3, "-007", "Ab", " a  ")]
    got = rows(ds, "select gcd(12, 18), comb(5, 2), erf(0.5), log(8, 2), fmod(-7, 3), trunc(-2.7), isclose(1.0, 1.0000000001), copysign(3, -1), ldexp(1.5, 2), lgamma(4.5)")[0]
    want = (6, 10, math.erf(0.5), 3.0, -1.0, -2, True, -3.0, 6.0, math.lgamma(4.5))
    assert all(a == b or math.isclose(a, b) for a, b in zip(got, want)), got
    assert tuple(rows(ds, "select modf(2.5) as m")[0][0]) == (0.5, 2.0)


def test_results_that_do_not_fit(ds):
    assert rows(ds, "select comb(100, 50), lcm(4611686018427387904, 3), perm(5, 2), gamma(0), lgamma(-1)") == [(None, None, 20, None, None)]
    assert rows(ds, "select expandtabs('a\tb'), expandtabs('ab\tc', 4), expandtabs(null)") == [("a       b", "ab  c", None)]


def test_union_of_widths(spark, ds):
    ds.add_source(Frames(small=spark.sql("select 1s as k, 2.5f as f"), wide=spark.sql("select 5000000000 as k, 0.25d as f")))
    assert sorted(rows(ds, "select k, f from small union all select k, f from wide")) == [(1, 2.5), (5000000000, 0.25)]
    assert sorted(rows(ds, "select k, f from wide union all select k, f from small")) == [(1, 2.5), (5000000000, 0.25)]


def test_resolve_and_replace_views(ds):
    def twice(df, column):
        raise AssertionError

    twice.resolve = lambda fn, own, df, column: df.select(df[column] * 2)
    ds.add_function("twice", twice)
    assert sorted(r[0] for r in ds.sql("select * from twice(plain, 'a')").collect()) == [2, 4]
    ds.create_view("v", "select a from plain")
    tree = replace_views(ds.query("select a from v x join staff on a = id").node, ds)
    ds.views.clear()
    assert sorted(r[0] for r in ds.create_view("w", tree) or ds.sql("select * from w").collect()) == [1, 2]


def test_json(ds):
    assert rows(ds, """select '{"k": 69, "s": "t", "a": [1, 2]}' -> 'k' as a, '{"s": "t"}' -> 's' as b, '{"s": "t"}' ->> 's' as c, '[5, 6]' -> 1 as d""") == [("69", '"t"', "t", "6")]


def test_case_in_cast(ds):
    assert rows(ds, "select case when boss is null then 'top' else 'other' end as c from staff order by id") == [("top",), ("other",), ("other",)]
    assert rows(ds, "select id from staff where boss not in (1, 2)") == [(1,)]
    assert rows(ds, "select id from staff where boss in (null, 5)") == [(1,)]
    assert rows(ds, "select cast('12' as INTEGER) as i, cast(1 as STRING) as s, cast('2020-01-02' as DATE) as d") == [(12, "1", dt.date(2020, 1, 2))]


def test_builder(ds):
    b = ds.select("id, name").frm("staff")
    c = b.where("id > 1").where("name != 'Cy'")
    assert [tuple(r) for r in c] == [(2, "Bo")] and len(list(b)) == 3
    assert [tuple(r) for r in ds.select("id").frm("staff").order_by("id desc").offset(1).limit(1)] == [(2,)]
    assert [tuple(r) for r in ds.select("count()").frm("staff")] == [(3,)]
    assert [tuple(r) for r in ds.select("e.name").frm("staff e").join("staff m", on="e.boss = m.id").order_by("e.name")] == [("Bo",), ("Cy",)]
    ds.select("name").frm("staff").where("id = 1").create_view("one")
    assert rows(ds, "select * from one") == [("Ada",)]
    assert b.schema.names == ["id", "name"]


def test_hooks(ds):
    seen = []
    ds.set_dump_func(lambda schema, df: seen.append((schema.names, df.count())))
    ds.query("select id from staff").dump()
    assert seen == [(["id"], 3)]
    ds.set_compiler(lambda query: lambda ctx: ("ran", ctx["params"]))
    assert ds.execute("select 1", 4) == ("ran", (4,))
    assert ("plain", ds.get_schema("plain")) in ds.relations
    source = ds.sources[1]
    ds.add_source(source)
    assert ds.sources.count(source) == 1


def test_types():
    kinds = struct(STAFF["schema"])
    assert kinds["jobs"].dataType == T.ArrayType(T.StructType([T.StructField("at", T.StringType()), T.StructField("years", T.LongType())]))
    assert struct(declared(kinds)) == kinds


def test_frames_and_streams(spark, ds, tmp_path):
    from quarrysql.streaming import Streams

    spark.range(5).write.parquet(str(tmp_path / "in"))
    ds.add_source(Frames(five=spark.range(5)))
    ds.add_source(Streams(flow=dict(format="parquet", path=str(tmp_path / "in"), schema="id long")))
    assert rows(ds, "select count() from five") == [(5,)]
    q = ds.sql("select id + 1 as next from flow where id > 2").writeStream.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("out").collect()) == [4, 5]
