"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every document of a source gets the same expected number of copies, target / source size. The whole part is
fixed; the fractional parts are rounded together. Buckets of documents are folded in order: the current
document and the next one exchange words, one giving and one taking, in a random direction chosen so that
expectations hold, until one of the two is whole. That leaves at most one fractional document in a bucket;
those go up a tree of buckets until each source has one, which is rounded by itself. The words taken of a
source thus differ from its target by less than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_PATTERN, discard, fresh, one_row_each, unit, written

#: Documents folded by one task step; the tree's fan-in.
FAN_IN = 64
#: The largest multiple of its own size that a source's target and a document's copies reach.
MOST = 3
WEIGHTS = (1, 2, 3)


def word_count(column: Column) -> Column:
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of the units (source, size).

    Sources by code point, null last, weigh `weights` in turn and share the whole size; a target stops at
    `most` times the source's size and the excess is shared again by weight until none is above.
    """
    # bytes of UTF-8 sort as code points do; the ranks are global positions found per range and then offset
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    keyed = by_source.select("*", F.col("source").isNull().alias("last"), F.encode(F.coalesce("source", F.lit("")), "UTF-8").alias("code"))
    ranged = written(keyed.repartitionByRange("last", "code").sortWithinPartitions("last", "code").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "sources")
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # one row per partition that has sources: as many rows as partitions, whatever the input
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = offsets.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("row") - F.col("first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = written(ranged.join(before, "part").select("source", "source_size", "n_docs", weight.alias("weight"), F.lit(False).alias("full")), "weights")
    discard(ranged)
    full = F.lit(False)
    while True:  # each round fills one source at least, few rounds in practice
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n_full"),
        ).first()
        if not row["all"] or not row["open"]:
            rate = 0.0
            break
        rate = (row["all"] - row["used"]) / row["open"]
        grown = full | (F.col("weight") * rate > F.col("source_size") * most)
        if table.filter(grown).count() == row["n_full"]:
            break
        full = grown
    target = F.when(full, F.col("source_size") * float(most)).otherwise(F.col("weight") * rate)
    return table.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


_FIELDS = ("key", "id", "tag", "nth", "size", "p", "base")


def _item(id_type: str) -> str:
    return f"struct<key:bigint,id:{id_type},tag:bigint,nth:bigint,size:bigint,p:double,base:bigint>"


def _changed(item: str, p: str) -> str:
    """SQL of an item with another p."""
    return "named_struct(" + ", ".join(f"'{f}', {p if f == 'p' else f'{item}.{f}'}" for f in _FIELDS) + ")"


#: One step of the fold: state s (current item s.cur, finished items s.done), next item x.
_MERGE = f"""
(s, x) -> if(s.cur is null, named_struct('cur', x, 'done', s.done),
 element_at(transform(array(named_struct(
     'up', least((1 - s.cur.p) * s.cur.size, x.p * x.size),
     'down', least(s.cur.p * s.cur.size, (1 - x.p) * x.size),
     'u', shiftrightunsigned(xxhash64(s.cur.key, x.key, {{seed}}, {{level}}), 11) / 9007199254740992D)),
   m -> element_at(transform(array(if(m.u * (m.up + m.down) < m.down,
       named_struct(
         'a', if((1 - s.cur.p) * s.cur.size <= x.p * x.size, 1D, s.cur.p + m.up / s.cur.size),
         'b', if(x.p * x.size <= (1 - s.cur.p) * s.cur.size, 0D, x.p - m.up / x.size)),
       named_struct(
         'a', if(s.cur.p * s.cur.size <= (1 - x.p) * x.size, 0D, s.cur.p - m.down / s.cur.size),
         'b', if((1 - x.p) * x.size <= s.cur.p * s.cur.size, 1D, x.p + m.down / x.size)))),
     w -> named_struct(
       'cur', cast(case when w.a > 0 and w.a < 1 then {_changed("s.cur", "w.a")}
                        when w.b > 0 and w.b < 1 then {_changed("x", "w.b")} end as {{item}}),
       'done', concat(s.done,
         if(w.a > 0 and w.a < 1, array(), array({_changed("s.cur", "w.a")})),
         if(w.b > 0 and w.b < 1, array(), array({_changed("x", "w.b")}))))), 1)), 1))
"""


def pivotal_round(items: DataFrame, largest: int, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """items (source, key, id, tag, nth, size > 0, p in (0, 1), base): the same rows with p rounded to 0 or 1.

    key: a hash of the item, which deals it out and decides ties. largest: the number of items of the largest
    source, from which the depth of the tree follows. Keeps each source's sum of p * size to within one item; the
    expectation of each p is its old value.
    """
    done, open_, level = [], items, 0
    kind = _item(items.schema["id"].dataType.simpleString())
    item = F.struct(*_FIELDS).cast(kind)
    while True:
        buckets = max(1, math.ceil(largest / fan_in))
        groups = open_.groupBy("source", F.pmod(F.xxhash64("key", F.lit(seed + level)), F.lit(buckets)).alias("bucket")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        start = f"named_struct('cur', cast(null as {kind}), 'done', cast(array() as array<{kind}>))"
        step = _MERGE.format(seed=seed, level=level, item=kind)
        folded = written(groups.select("source", F.expr(f"aggregate(items, {start}, {step})").alias("s")), f"pivot{level}")
        done.append(folded.select("source", F.explode("s.done").alias("i")).select("source", "i.*"))
        open_ = folded.filter("s.cur is not null").select("source", "s.cur.*")
        if buckets == 1:
            u = unit(F.col("key"), F.lit(seed), F.lit(-1))
            done.append(open_.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)).select(*done[0].columns))
            break
        largest, level = buckets, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: Repeats of a row that one array numbers.
_RUN = 4096


def _units(docs: DataFrame) -> DataFrame:
    """(id, source, tag, size, nth, key) of each row; nth numbers rows that are alike in all else, from 0."""
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("id"), "source", text.alias("tag"), word_count(F.col("text")).alias("size"))
    alike = rows.groupBy("id", "source", "tag", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_RUN}"))))
    in_run = F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)
    units = runs.select("id", "source", "tag", "size", F.explode(in_run).alias("nth"))
    return units.withColumn("key", F.xxhash64("id", "tag", "nth"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """Copies of each row in the mix: doc_id, source, tag, size, source_size, target, copies, taken.

    Every row is a document, repeated ones too, each with its own copies; tag is a hash of the text. A null text
    has size 0, and a document of size 0 takes nothing. A null source is a source. Long texts are counted whole;
    other columns, whatever their names, are ignored. Reruns give the same rows, however the table is dealt:
    ties of the fold go by a hash of id and text, then by all fields.
    """
    units = written(_units(docs), "sizes")
    targets = written(source_targets(units, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rates = targets.select("source", "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"))
    t = rates.withColumnRenamed("source", "_source")
    rows = units.join(t, units["source"].eqNullSafe(t["_source"])).drop("_source")
    rows = written(rows, "rates")
    # a rate of 2.999... by rounding of doubles is as good as whole: the fold moves it like any other
    open_ = rows.filter("size > 0 and p > 0")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    rounded = pivotal_round(open_.select("source", *_FIELDS), largest, seed)
    whole = rows.filter("not (size > 0 and p > 0)").withColumn("p", F.lit(0.0)).select("source", *_FIELDS)
    copies = (F.col("base") + F.col("p")).cast("long")
    s = targets.select(F.col("source").alias("_source"), "source_size", "target")
    out = rounded.unionByName(whole)
    out = out.join(s, out["source"].eqNullSafe(s["_source"]))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return out.select(F.col("id").alias("doc_id"), "source", "tag", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes its document; documents of size 0 stay once.

    With all of docs' columns, whatever their names. Rows alike in id, source and text are taken as often as the
    mix takes all of them, each time as the one of them that is least as JSON.
    """
    plan = mix_sources(docs, weights, most, seed)
    id_, source, tag, copies, copy = fresh(docs, "_id", "_src", "_tag", "_copies", "_copy")
    each = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    plan = plan.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("tag").alias(tag)).agg(F.sum(each).cast("int").alias(copies), F.count(F.lit(1)).alias("n"))
    plan = written(plan.filter(F.col(copies) > 0), "copies")
    text = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    if not plan.filter("n > 1").isEmpty():
        docs = one_row_each(docs, [docs["doc_id"], docs["source"], text])
        text = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    same = docs["doc_id"].eqNullSafe(plan[id_]) & docs["source"].eqNullSafe(plan[source]) & text.eqNullSafe(plan[tag])
    joined = docs.join(plan.drop("n"), same)
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.drop(id_, source, tag, copies, copy)
