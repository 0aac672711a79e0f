"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Native: DataFrame operations only.

Every source gets a share of the budget in proportion to its weight. No source is repeated more than
``max_epochs`` times; what a capped source can't take is dealt to the others by weight until none is
above its cap. A source's target is then met by whole repetitions of all its documents and one
fractional repetition: its documents in the order of a seeded hash, up to the remaining words; the
document at the cut gives the part that is still missing. So a source's words meet its target to
within rounding, and reruns agree, however the rows are partitioned.

Defined cases: a null source is a source, ordered last; null or empty text has size 0 and takes
nothing; rows with the same doc_id have the same hash, so they share what the cut leaves in
proportion to their sizes; an empty table gives an empty result. Extra columns stay out of the
plan; ``stage()`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, words

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Bits of the hash that each refinement of a cut reads, and how many refinements there are.
RADIX_BITS, LEVELS = 10, 2
HASH_BITS = 60
#: Most sources whose table is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 10_000


def seeded(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of an MD5 digest, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target of every source in ``sizes`` (source, size).

    One row a source goes through the two windows, after a partial aggregation; documents don't.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(max_epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The level at which this source and all after it would share what those before it leave. Up to the
    # first source that is not capped there, sources are capped; its level is the greatest of such.
    per = per.withColumn("level", (F.sum("source_size").over(whole) * budget - before) / left)
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    return per.withColumn("final", F.max(open_).over(whole)).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def cuts(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of every source in ``wanted`` (source, need > 0): hash ``at`` of the document at the cut, the
    words ``part`` missing there and the size ``tied`` of the rows at that hash.

    Each refinement sums the words by the next bits of the hash and keeps the bucket in which the
    running sum crosses the need. Only rows of that bucket go on, so no task sorts a whole source.
    """
    rows = sizes.select("source", "size", "h").where("size > 0")
    wanted = wanted.select(F.col("source").alias("_s"), F.col("need").alias("_need"))
    shift = HASH_BITS
    for level in range(LEVELS + 1):
        shift -= RADIX_BITS
        bucket = F.shiftright("h", shift) if level < LEVELS else F.col("h")
        sums = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
        sums = sums.withColumn("run", run).join(_small(wanted), F.col("source").eqNullSafe(F.col("_s")))
        crossed = sums.where((F.col("run") >= F.col("_need")) & (F.col("run") - F.col("words") < F.col("_need")))
        crossed = crossed.select("_s", "b", (F.col("_need") - F.col("run") + F.col("words")).alias("_need"), "words")
        if level == LEVELS:
            return crossed.select(F.col("_s").alias("source"), F.col("b").alias("at"), F.col("_need").alias("part"), F.col("words").alias("tied"))
        # A row a source: the next level reads these, and the rows of one bucket in 2 to the RADIX_BITS.
        crossed = cut(crossed)
        wanted = crossed.select("_s", "_need")
        inside = _small(crossed.select("_s", F.col("b").alias("_b")))
        rows = rows.join(inside, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_b")), "left_semi")
    raise AssertionError


def _small(sources: DataFrame) -> DataFrame:
    """A table with a row a source, sent to all tasks if it has ``BROADCAST_SOURCES`` rows at most. Of
    more, the join is left to adaptive execution, which splits a hot source's partition."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row a source of ``sizes`` (source, size, h): its size, target, whole repetitions and cut."""
    per = targets(sizes, weights, budget, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = per.withColumn("whole", epochs)
    per = cut(per.withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    at = cuts(sizes, per.where("need > 0")).withColumnRenamed("source", "_cut")
    return cut(per.join(at, F.col("source").eqNullSafe(F.col("_cut")), "left").withColumnRenamed("source", "_source").drop("_cut"))


def _sized(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> dict[str, Column]:
    return {"_name": F.col(source), "_size": F.size(words(F.col(text))).cast("long"), "_h": seeded(F.col(doc_id), seed)}


def _taken(df: DataFrame, per: DataFrame) -> DataFrame:
    """``df`` (_name, _size, _h and others) with its source's plan and ``_taken``."""
    more = F.when(F.col("_h") < F.col("at"), F.col("_size")).when(F.col("_h") == F.col("at"), F.floor(F.col("part") * F.col("_size") / F.col("tied")))
    taken = F.col("whole") * F.col("_size") + F.coalesce(more, F.lit(0)).cast("long")
    return df.join(_small(per), F.col("_name").eqNullSafe(F.col("_source"))).withColumn("_taken", taken)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``."""
    sizes = cut(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in _sized(docs, seed, doc_id, text, source).items()]))
    per = plan(sizes.select(F.col("_name").alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h")), weights, budget, max_epochs)
    return _taken(sizes, per).select("doc_id", F.col("_name").alias("source"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def stage(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Every document as often as the mix takes it: its whole repetitions, and once more if it lies
    before its source's cut, or at it with half of its words or more. The texts aren't exchanged."""
    sized = _sized(docs, seed, "doc_id", "text", "source")
    per = plan(cut(docs.select(*[c.alias(n.lstrip("_").replace("name", "source")) for n, c in sized.items()])), weights, budget, max_epochs)
    own = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)], *[c.alias(n) for n, c in sized.items()])
    times = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    taken = _taken(own, per).withColumn("_times", times).where("_times > 0")
    return taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for ``query()``: the same levels, and running sums over whole sources."""
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
  from {docs}),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast([{weights}][cast((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as int)] as double) as weight,
             cast(source_size as double) * {float(MAX_EPOCHS)} as cap from s),
v as (select *, (cast(sum(source_size) over () as double) * {BUDGET} - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
             / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, coalesce(max(case when cap > level * weight then level end) over () * weight, cap)) as target from v),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
n as (select *, cast(round(target - whole * source_size) as bigint) as need from p),
r as (select source, h, cast(sum(size) as bigint) as words from d where size > 0 group by source, h),
c as (select *, cast(sum(words) over (partition by source order by h) as bigint) as run from r)
select d.doc_id, d.source, cast(d.size as bigint) as size, n.source_size, n.target,
       n.whole * d.size + case when c.h is null or c.run - c.words >= n.need then 0 when c.run <= n.need then d.size
         else cast(floor((n.need - (c.run - c.words)) * d.size / c.words) as bigint) end as taken
from d join n on d.source is not distinct from n.source
left join c on c.source is not distinct from d.source and c.h = d.h and d.size > 0"""
