"""Registered queries of the dialect over the given tables, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import DataSet, Frames, Trees, api_queries
from .api_queries import dataset, work_folder


#: name: (statement of the dialect, DuckDB SQL; None where the statement is SQL as it stands)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "dual_select": ("select 1 as one, 'a' as a", None),
    "project_arith": ("select l_orderkey, l_linenumber, l_linenumber + 2 as more, l_linenumber - 5 as less, l_linenumber * 3 as thrice, -l_linenumber as minus, l_quantity / 4 as quarter from lineitem", None),
    "floor_div": ("select p_partkey, (p_size - 25) / 2 as half, (25 - p_size) / 3 as third from part", "select p_partkey, cast(floor((p_size - 25) / 2) as bigint) as half, cast(floor((25 - p_size) / 3) as bigint) as third from part"),
    "concat_plus": ("select c_custkey, c_name + '/' + c_mktsegment as label from customer", "select c_custkey, c_name || '/' || c_mktsegment as label from customer"),
    "filter_cmp": ("select o_orderkey, o_totalprice from orders where o_totalprice >= 150000.5 and o_orderdate < cast('1998-01-01' as DATE) and o_orderstatus != 'F'", None),
    "filter_bool": ("select p_partkey from part where p_size < 10 or p_size > 40 and not (p_brand = 'Brand#13')", None),
    "filter_in_between": ("select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_totalprice between 1000 and 90000 and o_orderpriority not in ('1-URGENT')", None),
    "filter_like": ("select p_partkey, p_type from part where p_type like '%STEEL%' or p_name not like '%a%'", None),
    "filter_rlike": ("select p_partkey, p_brand from part where p_brand rlike '^Brand#[12]' and p_type not rlike 'TIN$'", "select p_partkey, p_brand from part where regexp_matches(p_brand, '^Brand#[12]') and not regexp_matches(p_type, 'TIN$')"),
    "filter_regexp": ("select c_custkey from customer where c_name regexp '[13]$'", "select c_custkey from customer where regexp_matches(c_name, '[13]$')"),
    "filter_truthy": ("select n_nationkey from nation where n_regionkey", "select n_nationkey from nation where n_regionkey <> 0"),
    "null_safe_eq": (
        "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey where o_orderkey = null or o_orderkey != null and c_acctbal < 2000",
        "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey where o_orderkey is null or o_orderkey is not null and c_acctbal < 2000",
    ),
    "null_tests": ("select c_custkey, o_orderkey is null as lone from customer left join (select * from orders where o_totalprice > 300000) as big on c_custkey = o_custkey where o_orderstatus is not null or c_acctbal > 0", None),
    "case_when": ("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end as class, case when o_orderstatus = 'F' then 1 end as done from orders", None),
    "cast_types": ("select o_orderkey, cast(o_totalprice as BIGINT) as whole, cast(o_orderkey as STRING) as text, cast(cast(o_orderdate as DATE) as STRING) as day, cast('17' as INTEGER) + 1 as eighteen from orders", "select o_orderkey, cast(trunc(o_totalprice) as bigint) as whole, cast(o_orderkey as varchar) as text, cast(cast(o_orderdate as date) as varchar) as day, 18 as eighteen from orders"),
    "json_get": ("select event_id, props -> 'k' as k from events", "select event_id, cast(props -> '$.k' as varchar) as k from events"),
    "json_get_text": ("select event_id, cast(props ->> 'k' as INTEGER) + 1 as k from events where props ->> 'k' is not null", "select event_id, cast(props ->> '$.k' as bigint) + 1 as k from events where props ->> '$.k' is not null"),
    "inner_join": ("select c_name, n_name from customer join nation on c_nationkey = n_nationkey", None),
    "comma_join_on": ("select c_name, n_name from customer, nation on customer.c_nationkey = nation.n_nationkey where n_regionkey = 2", "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2"),
    "join_multikey": ("select a.l_orderkey, a.l_linenumber, b.l_partkey from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_quantity > 45", None),
    "theta_join": ("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey", None),
    "theta_range_join": ("select s_suppkey, n_nationkey from supplier join nation on s_nationkey < n_nationkey", None),
    "cross_join": ("select r_name, n_name from region, nation", None),
    "self_join": ("select x.*, y.n_name as other from nation as x join nation as y on x.n_regionkey = y.n_nationkey", None),
    "left_join": ("select n_name, count(s_suppkey) as suppliers from nation left join supplier on n_nationkey = s_nationkey group by n_name", None),
    "left_join_theta": ("select n.n_name, r_name from nation n left outer join region on n_regionkey = r_regionkey and r_name < 'B'", None),
    "left_join_empty": ("select r_name, n_name from region left join (select * from nation where n_nationkey < 0) none on r_regionkey = n_regionkey", None),
    "three_way_join": ("select c_name, r_name from customer join nation on c_nationkey = n_nationkey join region on nation.n_regionkey = region.r_regionkey where r_name = 'ASIA'", None),
    "four_way_agg": (
        "select n_name, count() as n, min(o_totalprice) as least from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_quantity > 30 group by n_name",
        "select n_name, count(*) as n, min(o_totalprice) as least from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_quantity > 30 group by n_name",
    ),
    "join_parenthesised": ("select c_name, place.r_name from customer join (nation join region on n_regionkey = r_regionkey) place on c_nationkey = place.n_nationkey", "select c_name, r_name from customer join (nation join region on n_regionkey = r_regionkey) on c_nationkey = n_nationkey"),
    "count_all": ("select count() as n from lineitem", "select count(*) as n from lineitem"),
    "count_star": ("select count(*) as n, count(l_tax) as taxed from lineitem where l_discount > 0.05", None),
    "group_count": ("select l_returnflag, count() from lineitem group by l_returnflag order by count", 'select l_returnflag, count(*) as "count" from lineitem group by l_returnflag'),
    "group_multi": ("select l_returnflag, l_linestatus, count(*) as n, max(l_quantity) as most, min(l_shipdate) as first from lineitem group by l_returnflag, l_linestatus", None),
    "group_expression": ("select p_size / 10 as decade, count(*) as n from part group by decade", "select cast(floor(p_size / 10) as bigint) as decade, count(*) as n from part group by 1"),
    "group_distinct_keys": ("select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus", None),
    "group_any_value": ("select n_nationkey, n_name, count(*) as n from nation join customer on n_nationkey = c_nationkey group by n_nationkey", "select n_nationkey, any_value(n_name) as n_name, count(*) as n from nation join customer on n_nationkey = c_nationkey group by n_nationkey"),
    "agg_expression": ("select o_orderstatus, count(*) + 1 as more, max(o_orderkey) - min(o_orderkey) as span from orders group by o_orderstatus", None),
    "min_max": ("select min(o_totalprice) as low, max(o_totalprice) as high, min(o_orderpriority) as first from orders", None),
    "min_by_max_by": ("select o_orderstatus, min_by(o_orderkey, o_totalprice) as cheapest, max_by(o_orderkey, o_totalprice) as dearest from orders group by o_orderstatus", None),
    "avg_sum": ("select l_linestatus, avg(l_linenumber) as mean, sum(l_linenumber) as total from lineitem group by l_linestatus", "select l_linestatus, avg(l_linenumber) as mean, cast(sum(l_linenumber) as bigint) as total from lineitem group by l_linestatus"),
    "count_distinct": ("select count(distinct o_custkey) as customers from orders", None),
    "having": ("select o_custkey, count(*) as n from orders group by o_custkey having n > 12 and max(o_totalprice) > 100000", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 100000"),
    "agg_empty": ("select count() as n, max(o_totalprice) as high from orders where o_orderkey < 0", "select count(*) as n, max(o_totalprice) as high from orders where o_orderkey < 0"),
    "distinct_rows": ("select distinct l_returnflag, l_shipdate from lineitem", None),
    "distinct_group": ("select distinct n from (select o_custkey, count(*) as n from orders group by o_custkey) t", None),
    "order_desc_limit": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", None),
    "order_string_date_desc": ("select o_orderkey, o_orderpriority, o_orderdate from orders order by o_orderpriority desc, o_orderdate desc, o_orderkey, 123 limit 30", "select o_orderkey, o_orderpriority, o_orderdate from orders order by o_orderpriority desc, o_orderdate desc, o_orderkey limit 30"),
    "limit_offset": ("select c_custkey from customer order by c_acctbal, c_custkey limit 10 offset 5", None),
    "union_all": ("select n_name as name from nation union all select r_name from region", None),
    "union_order_limit": ("select n_name as name from nation union all (select r_name from region order by r_name limit 2) order by name desc limit 12", None),
    "subselect_from": ("select t.n, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) t group by t.n", None),
    "str_funcs": ("select p_partkey, length(p_name) as n, upper(p_name) as up, lower(p_type) as low, replace(p_brand, '#', '-') as dash, find(p_type, 'S') as at, concat(p_brand, ':', p_type) as both, zfill(cast(p_size as STRING), 4) as wide from part", "select p_partkey, length(p_name) as n, upper(p_name) as up, lower(p_type) as low, replace(p_brand, '#', '-') as dash, strpos(p_type, 'S') - 1 as at, concat(p_brand, ':', p_type) as both, lpad(cast(p_size as varchar), 4, '0') as wide from part"),
    "hash_coalesce": ("select c_custkey, md5(c_name) as digest, coalesce(null, c_mktsegment) as segment from customer", None),
    "capwords": ("select p_partkey, capwords(lower(p_type)) as words from part", "select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as words from part"),
    "math_funcs": ("select p_partkey, ceil(p_retailprice) as up, floor(p_retailprice) as down, sqrt(p_size) as root, fabs(-p_size) as size, trunc(p_retailprice) as cut, gcd(p_size, 12) as g, isqrt(p_size) as whole, copysign(2, -p_size) as sign from part", "select p_partkey, cast(ceil(p_retailprice) as bigint) as up, cast(floor(p_retailprice) as bigint) as down, sqrt(p_size) as root, cast(p_size as double) as size, cast(trunc(p_retailprice) as bigint) as cut, gcd(p_size, 12) as g, cast(floor(sqrt(p_size)) as bigint) as whole, -2.0::double as sign from part"),
    "q1_pricing": (
        "select l_returnflag, l_linestatus, count(*) as n, min(l_extendedprice) as least, max(l_extendedprice) as most, sum(l_linenumber) as numbers from lineitem where l_shipdate <= cast('1998-09-02' as DATE) group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, count(*) as n, min(l_extendedprice) as least, max(l_extendedprice) as most, cast(sum(l_linenumber) as bigint) as numbers from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus",
    ),
    "flatten_scalar": ("select vec_id, embedding from flatten(embeddings, 'embedding') where embedding > 0.2", "select vec_id, embedding from (select vec_id, unnest(embedding) as embedding from embeddings) where embedding > 0.2"),
}


def _nested_views(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    ds.create_view("rich", "select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > 5000")
    ds.create_view("by_nation", "select c_nationkey, count(*) as n from rich group by c_nationkey")
    return ds.sql("select n_name, n from by_nation join nation on c_nationkey = n_nationkey")


def _params(spark, sf_dir):
    return dataset(spark, sf_dir).sql("select o_orderkey, ?1 as mark from orders where o_totalprice > ?0", 200000, "x")


def _positional(spark, sf_dir):
    return dataset(spark, sf_dir).sql("select $0, n_name from nation where $2 = 1 order by $0")


def _builder(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    orders = ds.select("o_custkey, count() as n").frm("orders").where("o_totalprice > 50000").where("o_orderstatus = 'O'").group_by("o_custkey")
    return ds.select("c_name, n").frm("customer").join(n_alias(orders, "o"), on="c_custkey = o.o_custkey").order_by("n desc, c_name").offset(3).limit(40).df()


def n_alias(builder, name: str):
    """A builder as a relation under a name."""
    from .plans.nodes import Alias

    class Named:
        node = Alias(builder.node, name)

    return Named()


def _scalar_udf(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    ds.add_function("shout", lambda s: None if s is None else s + "!", dict(name="shout", type="STRING"))
    return ds.sql("select c_custkey, shout(c_mktsegment) as loud from customer")


def _fold_udaf(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    ds.add_aggregate("odd", lambda state, x: state + x % 2, returns=dict(name="odd", type="INTEGER"), initial=0, finalize=lambda s: s)
    return ds.sql("select l_returnflag, odd(l_linenumber) as odd, count(*) as n from lineitem group by l_returnflag")


def _table_fn(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    ds.add_function("numbered", lambda rows, n: ((r.n_nationkey, n) for r in rows), returns=lambda df, n: [dict(name="key", type="INTEGER"), dict(name="n", type="INTEGER")])
    return ds.sql("select key, n from numbered((select * from nation where n_regionkey = 1), 7)")


def _nested(spark, sf_dir, query):
    ds = dataset(spark, sf_dir)
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"))).alias("info"))
    ds.add_source(Frames(records=base, repeated=base.withColumn("info", F.when(F.col("info").isNotNull(), F.array("info", "info")).otherwise(F.array()))))
    return ds.sql(query)


def _tree(spark, sf_dir, query):
    """Nations as CSV files in a folder for each region, written where all executors reach them."""
    root = work_folder(spark, "nations")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))
    nations.select(F.col("r_name").alias("region"), "n_nationkey", "n_name").coalesce(1).write.partitionBy("region").option("header", True).csv(root)
    ds = DataSet(spark)
    ds.add_source(Trees(nations=dict(root_dir=root.removeprefix("file://") if root.startswith("file:///") else root, pattern="region={region}/{file}.csv", decode="text/csv", schema=[dict(name="n_nationkey", type="INTEGER"), dict(name="n_name", type="STRING")])))
    return ds.sql(query)


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dataset(spark, sf_dir).sql(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(text) for name, (text, _) in STATEMENTS.items()} | {
    "view_nested": _nested_views,
    "params": _params,
    "positional": _positional,
    "builder": _builder,
    "scalar_udf": _scalar_udf,
    "fold_udaf": _fold_udaf,
    "table_fn": _table_fn,
    "flatten_record": lambda spark, d: _nested(spark, d, "select * from flatten(records, 'info')"),
    "flatten_repeated_record": lambda spark, d: _nested(spark, d, "select * from flatten(repeated, 'info')"),
    "dir_csv_pruned": lambda spark, d: _tree(spark, d, "select region, n_nationkey, n_name from nations where region = 'ASIA' and n_nationkey > 8"),
    "dir_csv_all": lambda spark, d: _tree(spark, d, "select region, count(*) as n from nations group by region"),
} | api_queries.QUERIES

SQL: dict[str, str] = {name: sql or text for name, (text, sql) in STATEMENTS.items()} | {
    "view_nested": "select n_name, n from (select c_nationkey, count(*) as n from customer where c_acctbal > 5000 group by c_nationkey) join nation on c_nationkey = n_nationkey",
    "params": "select o_orderkey, 'x' as mark from orders where o_totalprice > 200000",
    "positional": "select n_nationkey, n_name from nation where n_regionkey = 1",
    "builder": "select c_name, n from customer join (select o_custkey, count(*) as n from orders where o_totalprice > 50000 and o_orderstatus = 'O' group by o_custkey) o on c_custkey = o.o_custkey order by n desc, c_name limit 40 offset 3",
    "scalar_udf": "select c_custkey, c_mktsegment || '!' as loud from customer",
    "fold_udaf": "select l_returnflag, cast(sum(l_linenumber % 2) as bigint) as odd, count(*) as n from lineitem group by l_returnflag",
    "table_fn": "select n_nationkey as key, 7 as n from nation where n_regionkey = 1",
    "flatten_record": "select o_orderkey, o_custkey as info_cust, o_orderpriority as info_prio from orders where o_orderstatus <> 'P'",
    "flatten_repeated_record": "select o_orderkey, o_custkey as info_cust, o_orderpriority as info_prio from orders, (select unnest([1, 2])) where o_orderstatus <> 'P'",
    "dir_csv_pruned": "select r_name as region, n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_nationkey > 8",
    "dir_csv_all": "select r_name as region, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name",
} | api_queries.SQL
