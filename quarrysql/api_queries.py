"""Registered queries of what a session offers beside statements over stored tables, with DuckDB SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import DataSet, Dicts, Frames, Locations, Parquet, Source, Trees, decodes, replace_views
from .plans import parser
from .plans.nodes import Select

Run = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def dataset(spark: SparkSession, sf_dir: str, **options) -> DataSet:
    ds = DataSet(spark, **options)
    ds.add_source(Parquet(sf_dir, *TABLES))
    return ds


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder that all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _plain(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path


#: name: (statement, DuckDB SQL; None where the statement is SQL as it stands)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "true_false": ("select n_nationkey, TRUE as yes, FALSE as no from nation where (n_regionkey > 1) = TRUE", None),
    "unary_plus": ("select p_partkey, +p_size as size, 3 - -p_size as more from part", None),
    "not_between": ("select p_partkey from part where not p_size between 10 and 40", None),
    "parentheses_tuple": ("select p_partkey, (p_size + 1) * 2 as twice from part where (p_size, p_brand) = (7, 'Brand#13') or p_size in (1, 2, (3))", "select p_partkey, (p_size + 1) * 2 as twice from part where (p_size = 7 and p_brand = 'Brand#13') or p_size in (1, 2, 3)"),
    "null_order": (
        "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey order by o_orderkey, c_custkey limit 60",
        "select c_custkey, o_orderkey from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey order by o_orderkey nulls first, c_custkey limit 60",
    ),
    "null_order_desc": (
        "select c_custkey, o_totalprice from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey order by o_totalprice desc, c_custkey limit 90",
        "select c_custkey, o_totalprice from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey order by o_totalprice desc nulls last, c_custkey limit 90",
    ),
    "null_group": ("select o_orderstatus, count() as n from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey group by o_orderstatus", "select o_orderstatus, count(*) as n from customer left join (select * from orders where o_totalprice > 300000) big on c_custkey = o_custkey group by o_orderstatus"),
    "distinct_of_groups": ("select distinct count(*) as n, max(o_orderstatus) as status from orders group by o_custkey", None),
    "star_group": ("select * from nation group by n_nationkey", "select * from nation"),
    "union_all_widths": ("select n_nationkey as k from nation union all select c_custkey from customer union all select null", "select n_nationkey as k from nation union all select c_custkey from customer union all select null"),
    "spread_aggregates": ("select p_brand, floor(stddev(p_size) * 1000) as deviation, floor(variance(p_size) * 1000) as spread, approx_count_distinct(p_brand) as brands, first(p_brand) as brand from part group by p_brand", "select p_brand, cast(floor(stddev(p_size) * 1000) as bigint) as deviation, cast(floor(variance(p_size) * 1000) as bigint) as spread, count(distinct p_brand) as brands, p_brand as brand from part group by p_brand"),
    "collected": ("select n_nationkey, `join`(collect_list(n_name), '+') as names, `join`(collect_set(n_regionkey), '+') as regions from nation group by n_nationkey", "select n_nationkey, n_name as names, cast(n_regionkey as varchar) as regions from nation"),
    "trimmed": ("select p_partkey, strip('  ' + p_name + ' ') as a, lstrip('  ' + p_name) as b, rstrip(p_name + '  ') as c, trim(' x ') as d, ltrim(' x') as e, rtrim('x ') as f from part", "select p_partkey, p_name as a, p_name as b, p_name as c, 'x' as d, 'x' as e, 'x' as f from part"),
    "padded": ("select p_partkey, ljust(p_brand, 12) + '|' as a, rjust(p_brand, 12) as b, center('ab', 6) as c, ljust(p_brand, 2) as d, expandtabs('a\tb', 4) as e, expandtabs('ab\tc') as f from part", "select p_partkey, rpad(p_brand, 12, ' ') || '|' as a, lpad(p_brand, 12, ' ') as b, '  ab  ' as c, p_brand as d, 'a   b' as e, 'ab      c' as f from part"),
    "searched": ("select p_partkey, index(p_type, 'S') as a, rfind(p_type, 'E') as b, translate(p_brand, '#B', '-b') as c, `join`(split(p_type), '_') as d, `join`(split(p_brand, '#')) as e from part", "select p_partkey, strpos(p_type, 'S') - 1 as a, case when strpos(p_type, 'E') = 0 then -1 else length(p_type) - strpos(reverse(p_type), 'E') end as b, translate(p_brand, '#B', '-b') as c, replace(p_type, ' ', '_') as d, replace(p_brand, '#', ' ') as e from part"),
    "cased": ("select c_custkey, capitalize(lower(c_mktsegment)) as a, swapcase(capitalize(c_mktsegment)) as b, atoi(' 12 ') + c_custkey as c, atol('7') as d, atof(' 2.5 ') as e, reflect('java.lang.Long', 'toHexString', 255) as f from customer", "select c_custkey, upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] as a, lower(c_mktsegment[1]) || upper(c_mktsegment[2:]) as b, 12 + c_custkey as c, cast(7 as bigint) as d, cast(2.5 as double) as e, 'ff' as f from customer"),
    "tuple_mathematics": (
        "select n_nationkey, a_fraction, a_whole, b_mantissa, b_exponent, c, d, e from flatten((select * from flatten((select n_nationkey, modf(n_nationkey + 0.5) as a, frexp(8.0) as b, isinf(1.0) as c, isfinite(2.0) as d, isnan(1.0) as e from nation), 'a')), 'b')",
        "select n_nationkey, cast(0.5 as double) as a_fraction, cast(n_nationkey as double) as a_whole, cast(0.5 as double) as b_mantissa, cast(4 as double) as b_exponent, false as c, true as d, false as e from nation",
    ),
    "undefined_mathematics": ("select n_nationkey, comb(100, 50 + n_nationkey) as a, lgamma(0 - n_nationkey) as b, perm(5 + n_nationkey, 2) as c from nation where n_regionkey = 0 and n_nationkey < 1", "select n_nationkey, cast(null as bigint) as a, cast(null as double) as b, cast(20 as bigint) as c from nation where n_regionkey = 0 and n_nationkey < 1"),
}

_ARGUMENTS = {"atan2": "x, 2.0", "hypot": "x, 3.0", "pow": "x, 3.0", "log": "x + 1.0", "fmod": "x * 7.0, 3.0", "ldexp": "x, 3", "remainder": "x * 7.0, 3.0", "nextafter": "x, 9.0", "fma": "x, 2.0, 1.0", "isclose": "x, x + 0.1", "acosh": "x + 1.0", "copysign": "x, -2.0", "factorial": "cast(x * 8 as INTEGER)", "ulp": "x", "lcm": "cast(x * 8 as INTEGER), 12", "perm": "cast(x * 8 as INTEGER) + 3, 2", "comb": "cast(x * 8 as INTEGER) + 3, 2", "gcd": "cast(x * 8 as INTEGER), 12", "isqrt": "cast(x * 80 as INTEGER)"}
_EVERY = "acos acosh asin asinh atan atan2 atanh cbrt cos cosh degrees exp exp2 expm1 factorial hypot log10 log1p log2 radians sin sinh sqrt tan tanh pow ceil floor fabs trunc log fmod isqrt copysign ldexp erf erfc gamma lgamma remainder nextafter ulp fma gcd lcm comb perm isclose".split()
_POINTS = (0.125, 0.25, 0.5, 0.625, 0.75)


def _arguments(name: str, x: float) -> list[float]:
    return [eval(a, {"x": x}) for a in _ARGUMENTS.get(name, "x").replace("cast(", "int(").replace(" as INTEGER", "").split(", ")]  # noqa: S307


def _mathematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of one real number or a few, at some points; values to nine digits."""
    ds = DataSet(spark)
    ds.add_source(Dicts(points=dict(schema=[dict(name="x", type="FLOAT")], rows=[dict(x=x) for x in _POINTS])))
    digits = lambda f: f"floor({f} * 1000000000 + 0.5)" if f.split("(")[0] not in ("isclose",) else f
    return ds.sql("select x, " + ", ".join(f"{digits(f'{n}({_ARGUMENTS.get(n, 'x')})')} as f_{n}" for n in _EVERY) + " from points")


def _mathematics_sql() -> str:
    value = lambda n, x: getattr(math, n)(*_arguments(n, x))
    spell = lambda v: str(v).lower() if isinstance(v, bool) else f"cast({math.floor(v * 1000000000 + 0.5)} as bigint)"
    return " union all ".join(f"select cast({x} as double) as x, " + ", ".join(f"{spell(value(n, x))} as f_{n}" for n in _EVERY) for x in _POINTS)


def _dict_table(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    schema = [dict(name="n_nationkey", type="INTEGER"), dict(name="n_name", type="string"), dict(name="n_note", type="STRING"), dict(name="n_tags", type="STRING", mode="REPEATED")]
    ds = DataSet(spark)
    ds.add_source(Dicts(nations=dict(schema=dict(fields=schema), rows=[{k: r[k] for k in ("n_nationkey", "n_name")} | ({"n_tags": ["a", r["n_name"]]} if r["n_regionkey"] == 1 else {"n_note": "none"}) for r in rows])))
    return ds.sql("select n_nationkey, n_name, n_note, `join`(n_tags, '/') as tags from nations where n_note = null or n_nationkey > 5")


def _dict_inferred(spark, sf_dir):
    ds = DataSet(spark)
    ds.add_source(Dicts(regions=[dict(key=r.r_regionkey, name=r.r_name, even=r.r_regionkey % 2 == 0) for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]))
    return ds.sql("select key, name from regions where even = TRUE")


def _tree(spark, sf_dir) -> str:
    """Nations as CSV in folders whose names begin each other (1, 10, 19 and so on)."""
    root = work_folder(spark, "buckets")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("bucket", F.col("n_regionkey") * 9 + 1)
    nations.select("bucket", "n_nationkey", F.concat(F.col("n_name"), F.lit(',\n"x"')).alias("n_name")).coalesce(1).write.partitionBy("bucket").option("header", True).option("escape", '"').csv(root)
    return _plain(root)


def _over_tree(statement: str) -> Run:
    def run(spark, sf_dir):
        return dataset(spark, sf_dir).sql(statement.format(root=_tree(spark, sf_dir)))

    return run


@decodes("text/x-lines", schema=lambda f: [dict(name="number", type="INTEGER"), dict(name="line", type="STRING")])
def numbered_lines(f):
    """The lines of a text with their numbers."""
    for i, line in enumerate(f):
        yield dict(number=i, line=line.rstrip("\n"))


def _directory(spark, sf_dir):
    ds = DataSet(spark)
    ds.add_source(Trees(notes=dict(root_dir=_tree(spark, sf_dir), pattern="bucket={bucket}/{file}.csv", content_column="body", filename_column="path")))
    return ds.sql("select bucket, length(body) as size from notes")


def _location(spark, sf_dir):
    ds = DataSet(spark)
    ds.add_source(Locations())
    return ds.sql(f"select r_regionkey, r_name from '{sf_dir}/region.parquet' where r_regionkey != 2")


def _dotted(spark, sf_dir):
    ds = DataSet(spark)
    ds.add_source(Frames(**{"world.region": spark.read.parquet(f"{sf_dir}/region.parquet")}))
    return ds.sql("select r_name from world.region where r_regionkey < 3")


def _dumped(spark, sf_dir):
    seen: list[DataFrame] = []
    ds = dataset(spark, sf_dir)
    ds.set_dump_func(lambda schema, df: seen.append(df.select(*schema.names)))
    ds.query("select r_name, r_regionkey from region").dump()
    ds.select("n_name", "n_regionkey").frm("nation").where("n_regionkey = 1").dump()
    return seen[0].union(seen[1])


def _iterated(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    rows = [tuple(r) for r in ds.query("select r_name, r_regionkey from region")] + [tuple(r) for r in ds.select("n_name, n_regionkey").frm("nation")] + [tuple(r) for r in ds.execute("select r_name, r_regionkey from region where r_regionkey = ?0", 3)]
    return spark.createDataFrame(rows, "name string, region long")


def _legacy(spark, sf_dir):
    return dataset(spark, sf_dir, legacy_precedence=True).sql("select p_partkey from part where p_size < 10 or p_size > 40 and p_brand != 'Brand#13'")


def _refused(spark, sf_dir):
    """Statements that must not be bound, and that each one is refused."""
    ds, rows = dataset(spark, sf_dir), []
    for text in _REFUSED:
        try:
            ds.sql(text)
            rows.append((text, False))
        except (ValueError, LookupError, NameError, SyntaxError):
            rows.append((text, True))
    return spark.createDataFrame(rows, "statement string, refused boolean")


_REFUSED = [
    "select n_name, count(*) from nation", "select n_nationkey from nation union all select n_name from nation", "select n_nationkey, n_name from nation union all select n_nationkey from nation", "select * from flatten(nation, 'n_name')",
    "select * from nowhere", "select nothing from nation", "select n_name from nation a join nation b on a.n_nationkey = b.n_nationkey", "select unknown(n_name) from nation", "select n_name from nation where count(*) > 1", "select flatten from", "select n_name from nation union select r_name from region",
]


def _decorators(spark, sf_dir):
    ds = dataset(spark, sf_dir)

    @ds.function(returns=dict(name="initials", type="STRING"))
    def initials(name):
        return "".join(w[0] for w in name.split())

    @ds.function(name="plus", returns="bigint")
    def add(a, b):
        return a + b

    @ds.aggregate(returns=dict(name="longest", type="STRING"), initial="")
    def longest(state, name):
        return max(state, name, key=lambda x: (len(x), x))

    @ds.aggregate(name="tally", returns="bigint", initial=lambda: [0], finalize=lambda s: s[0])
    def counted(state):
        return [state[0] + 1]

    return ds.sql("select n_regionkey, longest(n_name) as longest, tally() as n, max(plus(n_nationkey, 1)) as top, min(initials(n_name)) as least from nation group by n_regionkey")


class _Squares(Source):
    """A source of its own: tables by what their names say."""

    def has(self, name):
        return name.startswith("squares_")

    def load(self, spark, name):
        return spark.range(int(name.removeprefix("squares_"))).selectExpr("id", "id * id as square")


def _plugins(spark, sf_dir):
    ds = dataset(spark, sf_dir)
    ds.add_source(_Squares())

    def doubled(df, column):
        raise AssertionError("resolve answers for it")

    doubled.resolve = lambda fn, own, df, column: df.withColumn(column, F.col(column) * 2)
    ds.add_function("doubled", doubled)
    ran = []
    ds.set_compiler(lambda query: lambda ctx: ran.append(query.df(*ctx["params"])) or ran[-1])
    return ds.execute("select n_name, square from doubled((select * from squares_9), 'square') join nation on id = n_nationkey where square > ?0", 4)


def _catalogue(spark, sf_dir):
    """What a session says of itself."""
    ds = dataset(spark, sf_dir)
    ds.create_view("pairs", "select r_regionkey as a, r_name as b from region")
    tree = replace_views(parser.parse_statement("select a from pairs"), ds)
    rows = [("relations", ",".join(sorted(name for name, _ in ds.relations))), ("schema", ",".join(ds.get_schema("pairs").names)), ("view", str(ds.get_view("pairs") is not None and ds.get_view("nix") is None)), ("relation", str(ds.get_relation("nix") is None)), ("source", type(ds.adapter_for("region")).__name__), ("replaced", f"{isinstance(tree, Select)} {type(tree.source).__name__}"), ("function", str(callable(ds.get_function("upper"))))]
    return spark.createDataFrame(rows, "what string, said string")


def _clauses(spark, sf_dir):
    """A builder from clauses, each read by the parser's own entry point, with a view made from it."""
    ds = dataset(spark, sf_dir)
    one = ds.select("o_custkey", "count() as n", "max(o_totalprice) as top").frm("orders o").where("o_orderstatus != 'F'").group_by("o_custkey")
    one.create_view("spending")
    parts = [parser.parse("n > 1 and top > 1000.5"), parser.parse_select("o_custkey, n"), parser.parse_from("spending s"), parser.parse_order_by("n desc, o_custkey")]
    ds.create_view("busy", Select(parts[1], parts[2], parts[0], (), None, parts[3]))
    return ds.select("c_name, n").frm("customer").join("busy b", on="c_custkey = b.o_custkey").order_by("n desc, c_name").limit(25).df()


QUERIES: dict[str, Run] = {name: (lambda text: lambda spark, sf_dir: dataset(spark, sf_dir).sql(text))(text) for name, (text, _) in STATEMENTS.items()} | {
    "mathematics": _mathematics,
    "dict_table": _dict_table,
    "dict_inferred": _dict_inferred,
    "files_listed": _over_tree("select bucket, count() as n from extract_path((select path from files('{root}') where path like '%.csv'), '{root}/bucket={{bucket}}/') group by bucket"),
    "extract_path": _over_tree("select bucket, ending from extract_path((files('{root}', 'name')), '{root}/bucket={{bucket}}/{{stem}}.{{ending}}', 'name') where ending = 'csv'"),
    "contents_named": _over_tree("select bucket, length(body) as size from extract_path((select * from contents((select path from files('{root}') where path like '%.csv'), 'path', 'body')), '{root}/bucket={{bucket}}/') where bucket in ('1', '10')"),
    "decode_csv": _over_tree("select bucket, n_nationkey, n_name from extract_path((select * from decode((select path from files('{root}') where path like '%.csv'), 'text/csv')), '{root}/bucket={{bucket}}/') where bucket in ('1', '10')"),
    "decode_own_codec": _over_tree("select number, count() as n from decode((select path from files('{root}') where path like '%bucket=1/%'), 'text/x-lines') group by number"),
    "directory_contents": _directory,
    "location": _location,
    "dotted_name": _dotted,
    "dumped": _dumped,
    "iterated": _iterated,
    "legacy_precedence": _legacy,
    "refused": _refused,
    "decorators": _decorators,
    "plugins": _plugins,
    "catalogue": _catalogue,
    "clauses": _clauses,
}

_LITERAL = lambda rows, *names: " union all ".join("select " + ", ".join(f"{v} as {n}" for v, n in zip(r, names)) for r in rows)
_TEXT = lambda x: "'" + x.replace("'", "''") + "'"
#: A written record is its key, a comma and the name in quotes, with its own two quotes doubled.
_FILE_SIZE = "cast(sum(length(cast(n_nationkey as varchar)) + 1 + 2 + length(n_name) + 8) + length('n_nationkey,n_name') + 1 as bigint)"

SQL: dict[str, str] = {name: sql or text for name, (text, sql) in STATEMENTS.items()} | {
    "mathematics": _mathematics_sql(),
    "dict_table": "select n_nationkey, n_name, case when n_regionkey <> 1 then 'none' end as n_note, case when n_regionkey = 1 then 'a/' || n_name else '' end as tags from nation where n_regionkey = 1 or n_nationkey > 5",
    "dict_inferred": "select cast(r_regionkey as bigint) as key, r_name as name from region where r_regionkey % 2 = 0",
    "files_listed": "select cast(n_regionkey * 9 + 1 as varchar) as bucket, count(distinct n_regionkey) as n from nation group by n_regionkey",
    "extract_path": "select distinct cast(n_regionkey * 9 + 1 as varchar) as bucket, 'csv' as ending from nation",
    "contents_named": f"select cast(n_regionkey * 9 + 1 as varchar) as bucket, {_FILE_SIZE} as size from nation where n_regionkey < 2 group by n_regionkey",
    "decode_csv": "select cast(n_regionkey * 9 + 1 as varchar) as bucket, cast(n_nationkey as varchar) as n_nationkey, n_name || ',' || chr(10) || '\"x\"' as n_name from nation where n_regionkey < 2",
    "decode_own_codec": "select cast(i as bigint) as number, cast(1 as bigint) as n from (select unnest(range(0, 1 + 2 * (select count(*) from nation where n_regionkey = 0))) as i)",
    "directory_contents": f"select cast(n_regionkey * 9 + 1 as varchar) as bucket, {_FILE_SIZE} as size from nation group by n_regionkey",
    "location": "select r_regionkey, r_name from region where r_regionkey <> 2",
    "dotted_name": "select r_name from region where r_regionkey < 3",
    "dumped": "select r_name, r_regionkey from region union all select n_name, n_regionkey from nation where n_regionkey = 1",
    "iterated": "select r_name as name, cast(r_regionkey as bigint) as region from region union all select n_name, n_regionkey from nation union all select r_name, r_regionkey from region where r_regionkey = 3",
    "legacy_precedence": "select p_partkey from part where (p_size < 10 or p_size > 40) and p_brand <> 'Brand#13'",
    "refused": _LITERAL([(_TEXT(x), "true") for x in _REFUSED], "statement", "refused"),
    "decorators": "select n_regionkey, max_by(n_name, struct_pack(l := length(n_name), n := n_name)) as longest, count(*) as n, max(n_nationkey) + 1 as top, min(array_to_string(list_transform(string_split(n_name, ' '), lambda x: x[1]), '')) as least from nation group by n_regionkey",
    "plugins": "select n_name, cast(2 * n_nationkey * n_nationkey as bigint) as square from nation where n_nationkey < 9 and 2 * n_nationkey * n_nationkey > 4",
    "catalogue": _LITERAL([("'relations'", _TEXT(",".join(sorted(TABLES)))), ("'schema'", "'a,b'"), ("'view'", "'True'"), ("'relation'", "'True'"), ("'source'", "'Parquet'"), ("'replaced'", "'True Frame'"), ("'function'", "'True'")], "what", "said"),
    "clauses": "select c_name, n from customer join (select o_custkey, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus <> 'F' group by o_custkey) b on c_custkey = b.o_custkey where n > 1 and top > 1000.5 order by n desc, c_name limit 25",
}
