"""Problem 5: the best representative of each group of duplicates.

The best text of a group is its most frequent one, then the shortest, then the first in code-point order; the
survivor is, among the rows with that text, the most complete, then the latest, then the one with the smallest
id. A record is also built field by field, of the latest value of each field that is neither null nor blank.

Rows without a time are placed by currency reasoning, which always runs. From the rows that have one, value
transitions are learnt: where the same entity went from value p to value q more often than back, q follows p, also
over other values, in the group or not. In each group that has rows without a time, these transitions between its
values make a partial order; a value is current if the group holds no value that follows it. Among rows without a
time, those with more current values come later, and a field without any timed value takes the most frequent of its
current ones. What is closed over chains of transitions are only those parts of the order that such groups touch.

A row whose text is null can't survive and counts for no text; a group of such rows only has no survivor. Ties
are settled as stated, rows of an entity with equal times give no transition, repeated ids count once, an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.operators.graph import connected_components
from twinline.session import cut


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & F.col(c).rlike(r"\S")


def precedence(rows: DataFrame, entity: list[str], fields: list[str], time: str) -> DataFrame:
    """(field, older, newer): value transitions that timed rows of the same entity show more often than their reverse.

    One sort of the rows by entity serves all fields; a field's older value is the last one filled. Entities and
    values are 64-bit hashes, so that a row shuffles one number a field, however long its values are.
    """
    timed = rows.filter(F.col(time).isNotNull()).select(F.xxhash64(*entity).alias("e"), F.col(time).alias("t"), *(F.when(_filled(f), F.xxhash64(f)).alias(f"v{i}") for i, f in enumerate(fields)))
    values = [f"v{i}" for i in range(len(fields))]
    w = Window.partitionBy("e").orderBy("t", *values).rowsBetween(Window.unboundedPreceding, -1)
    filled = [F.when(F.col(v).isNotNull(), F.struct("t", F.col(v).alias("v"))) for v in values]
    both = timed.select(*(F.struct(F.lit(f).alias("field"), F.last(x, ignorenulls=True).over(w).alias("old"), x.alias("new")).alias(f"m{i}") for i, (f, x) in enumerate(zip(fields, filled, strict=True))))
    moves = F.filter(F.array(*(f"m{i}" for i in range(len(fields)))), lambda m: (m["old"]["t"] < m["new"]["t"]) & (m["old"]["v"] != m["new"]["v"]))
    seen = both.select(F.explode(moves).alias("m"))
    older, newer = F.col("m.old.v"), F.col("m.new.v")
    one_way = F.when(older < newer, 1).otherwise(-1)
    counted = seen.groupBy(F.col("m.field").alias("field"), F.least(older, newer).alias("p"), F.greatest(older, newer).alias("q")).agg(F.sum(one_way).alias("balance"))
    forth = F.col("balance") > 0
    return counted.filter("balance <> 0").select("field", F.when(forth, F.col("p")).otherwise(F.col("q")).alias("older"), F.when(forth, F.col("q")).otherwise(F.col("p")).alias("newer"))


def closed(order: DataFrame) -> DataFrame:
    """order with the pairs that follow over other values, over chains of any length; what follows both ways is dropped.

    Each round doubles the length of the chains and is checkpointed; the last one is that which adds no pair.
    """
    order = cut(order.distinct())
    before, n = -1, order.count()
    while n not in (0, before):
        first = order.select("field", "older", F.col("newer").alias("via"))
        then = order.select("field", F.col("older").alias("via"), "newer")
        chained = first.join(then, ["field", "via"]).filter("older <> newer").select("field", "older", "newer")
        order = cut(order.unionByName(chained).distinct())
        before, n = n, order.count()
    back = order.select("field", F.col("newer").alias("older"), F.col("older").alias("newer"))
    return order.join(back, ["field", "older", "newer"], "left_anti")


def _values(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, value, n): the distinct filled values of each group."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(_filled(f), F.col(f)).alias("value")) for f in fields)))
    return rows.select(group, pairs.alias("x")).select(group, "x.*").filter("value IS NOT NULL").groupBy(group, "field", "value").agg(F.count("*").alias("n"))


def _touched(order: DataFrame, values: DataFrame) -> DataFrame:
    """The parts of the order, connected over any transitions, that hold one of the values."""
    parts = cut(connected_components(order.select(F.xxhash64("field", "older").alias("src"), F.xxhash64("field", "newer").alias("dst"))))
    kept = parts.join(values.select(F.xxhash64("field", "h").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    nodes = parts.join(kept, "component", "left_semi").select("node")
    return order.withColumn("node", F.xxhash64("field", "older")).join(nodes, "node", "left_semi").drop("node")


#: Rows of members that are broadcast at most, about 10 MB; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def undated_members(rows: DataFrame, members: DataFrame, group: str, entity: list[str], time: str) -> DataFrame:
    """The members, (group, entity), of groups that hold a row without a time."""
    places = rows.filter(F.col(time).isNull()).select(*entity).distinct()
    found = cut(members.join(members.join(places, entity, "left_semi").select(group).distinct(), group, "left_semi"))
    return F.broadcast(found) if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else found


def current_values(rows: DataFrame, group: str, fields: list[str], order: DataFrame) -> DataFrame:
    """(group, field, value, n): the values of each group that no other value of the group is known to follow.

    rows are all those of the groups that have rows without a time. order is that of precedence(); it is closed here,
    as far as the groups' values are concerned.
    """
    values = cut(_values(rows, group, fields).withColumn("h", F.xxhash64("value")))
    whole = closed(_touched(cut(order), values))
    later = values.select(group, "field", F.col("h").alias("newer"))
    passed = values.join(whole.withColumnRenamed("older", "h"), ["field", "h"]).join(later, [group, "field", "newer"], "left_semi").select(group, "field", "value").distinct()
    return cut(values.join(passed, [group, "field", "value"], "left_anti").select(group, "field", "value", "n"))


def _undated(rows: DataFrame, group: str, id_: str, fields: list[str], time: str, current: DataFrame) -> DataFrame:
    """The rows without a time, with n_current: the number of their values that are current in their group."""
    rows = rows.filter(F.col(time).isNull())
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    score = rows.select(group, id_, pairs.alias("x")).select(group, id_, "x.*").join(current, [group, "field", "value"], "left_semi").groupBy(group, id_).agg(F.count("*").alias("n_current"))
    return rows.join(score, [group, id_], "left").withColumn("n_current", F.coalesce("n_current", F.lit(0)))


def completeness(fields: list[str]) -> Column:
    """Number of fields that are neither null nor blank. Taken before rows are shuffled, it stands for the fields."""
    return reduce(lambda a, b: a + b, (_filled(f).cast("int") for f in fields), F.lit(0))


def survivors(rows: DataFrame, group: str, id_: str, text: str, full: str, time: str, fields: list[str], current: DataFrame) -> DataFrame:
    """(group, id, best_text): the survivor of each group; full is the column with the completeness, current that of current_values().

    All is folded in two aggregations that combine before the shuffle, first by group and text, then by group.
    """
    used = [group, id_, text, full, time]
    ranked = rows.filter(F.col(time).isNotNull()).select(*used, F.lit(0).cast("long").alias("n_current"))
    ranked = ranked.unionByName(_undated(rows.drop("n_current"), group, id_, fields, time, current).select(*used, "n_current"))
    best = F.max(F.struct(F.col(full).alias("full"), F.col(time).alias("time"), F.col("n_current").alias("c"), (-F.col(id_)).alias("neg")))
    texts = ranked.filter(F.col(text).isNotNull()).groupBy(group, text).agg(F.count("*").alias("n"), best.alias("row"))
    lead = F.min(F.struct((-F.col("n")).alias("n"), F.length(text).alias("l"), F.col(text).alias("text"), F.col("row.neg").alias("neg")))
    return texts.groupBy(group).agg(lead.alias("x")).select(group, (-F.col("x.neg")).alias(id_), F.col("x.text").alias("best_text"))


def latest_values(rows: DataFrame, group: str, id_: str, fields: list[str], time: str, current: DataFrame) -> DataFrame:
    """One record per group, field by field: the latest filled value; without timed ones the most frequent current one."""
    timed = rows.groupBy(group).agg(*(
        F.max(F.when(_filled(f) & F.col(time).isNotNull(), F.struct(F.col(time).alias("t"), (-F.col(id_)).alias("i"), F.col(f).alias("v"))))["v"].alias(f) for f in fields
    ))
    picked = current.groupBy(group).pivot("field", fields).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))["v"])
    other = picked.select(group, *(F.col(f).alias(f"{f}__current") for f in fields))
    return timed.join(other, group, "left").select(group, *(F.coalesce(f, f"{f}__current").alias(f) for f in fields))
