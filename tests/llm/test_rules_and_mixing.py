import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrysql.llm import mixing, quality_rules, site_quality

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    con.execute(sql)
    names = [c[0] for c in con.description]
    want = con.fetchall()
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def measures(t):
    w = WORD.findall(t or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


TEXTS = [*ODD, (20, "a b c a b c d a b"), (21, "l\nl\n l\nm\nl\n"), (22, " ".join(f"the word{i} of place{i} and" for i in range(30))), (23, "THE!! %%% ### " * 40), (24, " ".join(f"n{i}" for i in range(300)))]


def test_quality_measures_and_sql(stored):
    docs = stored(TEXTS)
    got = quality_rules.query(docs)
    want = sorted(((i, *measures(t)) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()), key=repr) == want
    same(got, quality_rules.sql(), docs)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert 22 in kept and not kept & {20, 23, 24}


def test_quality_plan_is_native(stored):
    plan = quality_rules.query(stored([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_stage_keeps_clashing_columns(stored):
    docs = stored(TEXTS).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    out = quality_rules.stage(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.select("n_words", "kept").collect()} == {("mine", 7)}


def test_empty(empty):
    assert quality_rules.query(empty).collect() == [] and mixing.query(empty).collect() == []
    assert mixing.stage(empty).collect() == []


SOURCES = [(i, " ".join(["w"] * (i * 7 % 40)), f"s{i % 5}" if i % 11 else None) for i in range(400)]


def test_mixing_meets_its_targets(stored):
    docs = stored([*SOURCES, (None, "a b c", "s0"), (3, "again x y", "s1")])
    df = mixing.mix(docs)
    same(df, mixing.sql(), docs)
    rows = df.collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        x = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        x[0] += r.size
        x[1] += r.taken
    assert sum(x[2] for x in by.values()) == pytest.approx(1.5 * total)
    for size, taken, target, said in by.values():
        assert size == said and target <= 2 * size + 1e-6 and abs(taken - target) <= 3
    weights = dict(zip(sorted((s for s in by if s is not None)) + [None], [3, 1, 2, 3, 1, 2]))
    levels = {round(x[2] / weights[s], 6) for s, x in by.items() if x[2] < 2 * x[0] - 1e-6}
    assert len(levels) <= 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)


def test_water_filling_with_one_cap(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 0.5, 2).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx((1005 - 20) / 3) and got["c"] == pytest.approx(2 * (1005 - 20) / 3)
    got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 5, 2).collect()}
    assert got == {"a": 20, "b": 2000, "c": 2000}


def test_mixing_stage_repeats_documents(stored):
    docs = stored(SOURCES).withColumn("size", F.lit("own"))
    out = mixing.stage(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 2 and set(times) <= {i for i, t, _ in SOURCES if t}


def test_site_quality_learns_and_shrinks(spark, stored):
    good = "the cat and the dog of the house was in a garden that is by the sea and for all " * 3
    bad = "%%% ### BUY!! NOW!! *** $$$ " * 20
    rows, labels = [], []
    for i in range(240):
        site = f"s{i % 4}"
        q = int(i % 4 != 0 if i % 10 else i % 4 == 0)
        rows.append((i, (good if q else bad) + f" word{i}", site))
        labels.append((i, q))
    rows.append((999, good, "lonely"))
    docs = stored(rows)
    df = site_quality.score(docs, spark.createDataFrame([*labels, (None, 1), (5555, 0), (7, None)], "doc_id long, quality int"), F.col("source"), F.concat_ws("/", "source", "lang"))
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == 241
    truth = dict(labels)
    assert sum(got[i].kept == bool(q) for i, q in truth.items()) / len(truth) > 0.98
    assert got[1].host_posterior > got[0].host_posterior
    whole = sum(r.p for r in got.values()) / len(got)
    assert got[999].host_posterior == pytest.approx(whole, abs=0.02)


def test_site_quality_without_labels_or_rows(spark, stored, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.p == 0.5 and r.kept for r in site_quality.score(stored(ODD), none, F.col("source"), F.col("lang")).collect())
    assert site_quality.score(empty, none, F.col("source"), F.col("lang")).collect() == []
    assert site_quality.score(stored([(1, "a")]), none, F.lit(None), F.lit(None)).count() == 1


def test_posteriors_by_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None, "c"]), r.choice(["x", "y", None, f"s{i % 9}"]), round(r.uniform(0.01, 0.99), 3)) for i in range(200)]
    rows += [(i, "big", "one", 0.9) for i in range(200, 300)] + [(0, "lone", "z", 0.4), (0, "lone", "z", 0.4)]
    got = site_quality.posterior(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()

    def moments(groups, mean):
        own = [g for g in groups.values() if len(g) > 1]
        n, m = sum(map(len, own)), len(own)
        within = max(sum(sum(p * p for p in g) - sum(g) ** 2 / len(g) for g in own) / (n - m), 1e-9)
        between = (sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in own) / (m - 1) - within) / ((n - sum(len(g) ** 2 for g in own) / n) / (m - 1))
        return min(max(within / between, site_quality.LEAST_PRIOR), site_quality.MOST_PRIOR) if between > 0 else site_quality.MOST_PRIOR

    hosts, paths = defaultdict(list), defaultdict(list)
    for _, h, s, p in rows:
        hosts[h].append(p)
        paths[h, s].append(p)
    mean = sum(x[3] for x in rows) / len(rows)
    k_host, k_path = moments(hosts, mean), moments(paths, mean)
    want = []
    for i, h, s, p in rows:
        inside = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        odds = lambda x: math.log(x / (1 - x))
        host = inside((k_host * mean + sum(hosts[h]) - p) / (k_host + len(hosts[h]) - 1))
        path = inside((k_path * host + sum(paths[h, s]) - p) / (k_path + len(paths[h, s]) - 1))
        quality = 1 / (1 + math.exp(-(odds(p) + site_quality.SITE_WEIGHT * (odds(path) - odds(inside(mean))))))
        want.append((i, str(h), str(s), len(hosts[h]), len(paths[h, s]), host, path, quality))
    have = sorted((x.doc_id, str(x.host), str(x.path), x.n_host, x.n_path, x.host_posterior, x.path_posterior, x.quality) for x in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert all(x.kept == (x.quality >= site_quality.KEEP) for x in got)


def test_few_of_many_labels_train_the_model(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id % 3 as string) as host", "'p' as path", *[f"cast((id * {7 + i}) % 11 as double) as {n}" for i, n in enumerate(site_quality.FEATURES)])
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    one, two = site_quality.train(docs, labels, 500), site_quality.train(docs.repartition(7), labels.repartition(5), 500)
    assert one == two
