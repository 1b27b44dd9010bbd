"""Checks of registries and references: joins that find what is missing, doubled, stale or out of order.

Sides are joined by shuffle or broadcast as Catalyst finds from their sizes; nothing is broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses read as another one.
STATUS_SYNONYMS = {"verified": "confirmed", "supported": "confirmed"}


def normal_status(c: Column) -> Column:
    """Lower case, pending where there is none, synonyms resolved."""
    low = F.lower(F.trim(F.coalesce(c, F.lit("pending"))))
    out = low
    for a, b in STATUS_SYNONYMS.items():
        out = F.when(low == a, b).otherwise(out)
    return out


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left without a partner: cited but not listed, listed but not cited, required but absent."""
    return left.join(right.select(*on), list(on), "left_anti")


def both_sides(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of either side without a partner, and the side. A key with a null has no partner. Both sides are grouped at once, so nothing is sorted and each side is read once."""
    each = left.select(*on, F.lit(True).alias("__left")).unionByName(right.select(*on, F.lit(False).alias("__left")))
    seen = each.groupBy(*on).agg(F.bool_or("__left").alias("__a"), F.bool_or(~F.col("__left")).alias("__b"))
    alone = reduce(or_, [F.col(c).isNull() for c in on])
    sides = F.array_compact(F.array(F.when(F.col("__a") & (~F.col("__b") | alone), F.lit("left")), F.when(F.col("__b") & (~F.col("__a") | alone), F.lit("right"))))
    return seen.select(*on, F.explode(sides).alias("side"))


def resolve(refs: DataFrame, sources: DataFrame, ref: str, key: str, value: str, out: str = "resolved") -> DataFrame:
    """refs with the value of the source that each names; null where there is none."""
    return refs.join(sources.select(F.col(key).alias(ref), F.col(value).alias(out)), ref, "left")


def flagged(refs: DataFrame, sources: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """References to sources for which a condition holds."""
    return refs.join(sources.filter(condition).select(*on), list(on), "left_semi")


def claims(table: DataFrame, claim: str, refs: str, sources: DataFrame, key: str, status: str) -> DataFrame:
    """Of claims with an array of references: how many references there are, are missing and are confirmed, and the outcome.

    missing: a reference names no source; unsupported: none is confirmed, or there are none; supported otherwise.
    """
    each = table.select(claim, F.explode_outer(refs).alias(key))
    known = sources.select(key, normal_status(F.col(status)).alias("__s"))
    found = each.join(known, key, "left").groupBy(claim).agg(F.count(key).alias("n_refs"), F.count_if(F.col(key).isNotNull() & F.col("__s").isNull()).alias("n_missing"), F.count_if(F.col("__s") == "confirmed").alias("n_confirmed"))
    return found.withColumn("outcome", F.when(F.col("n_missing") > 0, "missing").when(F.col("n_confirmed") == 0, "unsupported").otherwise("supported"))


def duplicates(table: DataFrame, key: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key an earlier row has: key, the row's place and the first one's."""
    each = table.select(*by, F.col(order).alias("pos"), key.alias("key")).filter("key is not null and key <> ''")
    firsts = each.groupBy(*by, "key").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).filter("n > 1")
    return each.join(firsts, [*by, "key"]).filter("pos > first_pos").drop("n")


def snapshot_diff(old: DataFrame, new: DataFrame, on: Sequence[str], value: str, keep_same: bool = False) -> DataFrame:
    """Keys with a change: added, removed or changed."""
    a = old.select(*on, F.col(value).alias("__a"), F.lit(True).alias("__old"))
    b = new.select(*on, F.col(value).alias("__b"), F.lit(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    out = a.join(b, list(on), "full_outer").select(*on, change.alias("change"))
    return out if keep_same else out.filter("change <> 'same'")


def mismatches(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys that both sides have, with the names of the columns that differ."""
    right = b.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    return a.join(right, list(on)).select(*on, F.array_join(differ, ",").alias("differ")).filter("differ <> ''")


def status_report(table: DataFrame, status: Column, verified: Column, stale: Column) -> DataFrame:
    """One row, for an empty table too: rows by status, confirmed ones without verification, stale ones, and whether all is clean."""
    df = table.select(normal_status(status).alias("s"), F.coalesce(verified, F.lit(False)).alias("v"), F.coalesce(stale, F.lit(False)).alias("t"))
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    out = df.agg(F.count("*").alias("n"), *[count(F.col("s") == k).alias(k) for k in ("confirmed", "pending", "suspicious", "rejected")], count((F.col("s") == "confirmed") & ~F.col("v")).alias("unverified"), count("t").alias("stale"))
    return out.withColumn("clean", (F.col("n") > 0) & (F.col("confirmed") == F.col("n")) & (F.col("unverified") == 0) & (F.col("stale") == 0))


def sequence_gaps(table: DataFrame, seq: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of missing numbers from first to last inside a table that should hold 1 to N (or 0 to N), and numbers that come twice."""
    counted = table.groupBy(*by, F.col(seq).alias("seq")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("seq") if by else None
    if w is None:
        # one row for each number: runs are found between blocks of numbers, so that no task holds the whole sequence
        block = 10_000
        blocks = counted.withColumn("__b", F.floor(F.col("seq") / block))
        w = Window.partitionBy("__b").orderBy("seq")
        ends = blocks.groupBy("__b").agg(F.max("seq").alias("__last")).withColumn("__b", F.col("__b"))
        before = ends.select("__b", F.lag("__last").over(Window.orderBy("__b")).alias("__before"))
        inner = blocks.withColumn("__prev", F.lag("seq").over(w)).join(before, "__b")
        pairs = inner.select("seq", "n", F.coalesce("__prev", "__before").alias("prev"))
        gaps = pairs.filter("prev is not null and seq - prev > 1").select((F.col("prev") + 1).alias("first"), (F.col("seq") - 1).alias("last"), F.lit("missing").alias("problem"))
        return gaps.unionByName(counted.filter("n > 1").select(F.col("seq").alias("first"), F.col("seq").alias("last"), F.lit("duplicate").alias("problem")))
    pairs = counted.withColumn("prev", F.lag("seq").over(w))
    gaps = pairs.filter("seq - prev > 1").select(*by, (F.col("prev") + 1).alias("first"), (F.col("seq") - 1).alias("last"), F.lit("missing").alias("problem"))
    return gaps.unionByName(counted.filter("n > 1").select(*by, F.col("seq").alias("first"), F.col("seq").alias("last"), F.lit("duplicate").alias("problem")))


def numbering_problems(table: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """For each group: its first number is not 1, numbers come twice, numbers are left out."""
    counted = table.groupBy(*by, number).agg(F.count("*").alias("n"))
    out = counted.groupBy(*by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("k"), F.count_if(F.col("n") > 1).alias("doubled"))
    return out.select(*by, (F.col("lo") != 1).alias("bad_start"), F.col("doubled").cast("long").alias("doubled"), (F.col("hi") - F.col("lo") + 1 - F.col("k")).cast("long").alias("left_out"))


def inversions(table: DataFrame, by: Sequence[str], order: str, key: Column) -> DataFrame:
    """Rows that stand behind one with a larger key."""
    w = Window.partitionBy(*by).orderBy(order)
    df = table.select(*by, F.col(order).alias("pos"), key.alias("key"))
    w = Window.partitionBy(*by).orderBy("pos")
    return df.withColumn("before", F.lag("key").over(w)).filter("before > key")


def numbered(table: DataFrame, by: Sequence[str], key: Sequence[Column], out: str = "number") -> DataFrame:
    """Numbers from 1 in each group, in the order of the key."""
    return table.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*key)).cast("long"))


def next_number(table: DataFrame, by: Sequence[str], identifier: Column) -> DataFrame:
    """One more than the largest number at an identifier's end, by group."""
    return table.select(*by, F.regexp_extract(identifier, r"(\d+)$", 1).cast("long").alias("n")).groupBy(*by).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("next"))


def last_rows(table: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order (a log's last records, with descending times)."""
    return table.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def runs(table: DataFrame, by: Sequence[str], order: str, starts: Column) -> DataFrame:
    """table with run: islands of rows, a new one wherever starts holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("run", F.sum(starts.cast("int")).over(w))


def joined_lines(table: DataFrame, by: Sequence[str], order: str, text: str, starts: Column) -> DataFrame:
    """Lines that continue an entry joined to it: one row for each entry, in order."""
    df = runs(table, by, order, starts)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    out = df.groupBy(*by, "run").agg(F.min(order).alias("first"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("entry"))
    return out.drop("run")


def assigned_ids(table: DataFrame, by: Sequence[str], order: str, wanted: str) -> DataFrame:
    """An id for each row in order: its number if positive and not yet taken, else one more than the largest taken.

    Without repeated numbers that would be windows; a number that is taken turns its row into one that counts on, and what it takes may be wanted later. So it is an ordered walk over each group's numbers, in an Arrow function.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(wanted).cast("long").alias("w"))))

    @F.pandas_udf("array<bigint>")
    def walk(lists: pd.Series) -> pd.Series:
        out = []
        for one in lists:
            used, top, ids = set(), 0, []
            for w in one:
                own = int(w) if w == w and w is not None and w > 0 and w not in used else top + 1
                used.add(own)
                top = max(top, own)
                ids.append(own)
            out.append(ids)
        return pd.Series(out)

    done = table.groupBy(*by).agg(rows.alias("r")).withColumn("ids", walk(F.transform("r", lambda x: x["w"])))
    return done.select(*by, F.explode(F.arrays_zip(F.transform("r", lambda x: x["o"]).alias("o"), F.col("ids").alias("i"))).alias("x")).select(*by, F.col("x.o").alias(order), F.col("x.i").alias("id"))


def pairs_not_independent(table: DataFrame, person: str, task: str, gate: str) -> DataFrame:
    """People who did tasks of two gates or more, or one gate's twice: person, gates and tasks."""
    out = table.groupBy(person).agg(F.count_distinct(gate).alias("gates"), F.count_distinct(task).alias("tasks"))
    return out.filter((F.col("gates") > 1) | (F.col("tasks") > F.col("gates")))


def same_person_pairs(a: DataFrame, b: DataFrame, person: str, gate: str) -> DataFrame:
    """People with a task on either side at different gates: an equality on the person and an inequality on the gate, after duplicates are gone."""
    left = a.select(person, F.col(gate).alias("gate")).distinct()
    right = b.select(person, F.col(gate).alias("other_gate")).distinct()
    return left.join(right, person).filter("gate <> other_gate")


def newer(table: DataFrame, snapshots: DataFrame, by: Sequence[str], seq: str, sha: str) -> DataFrame:
    """For each row how many snapshots of its group are newer (a larger number) and differ from its own; none for a row without number or SHA.

    Counted by running windows over rows and snapshots together: newer ones of the group, less newer ones with the same SHA.
    """
    s = snapshots.filter(F.col(seq).isNotNull() & F.col(sha).isNotNull()).select(*by, seq, sha, F.lit(1).alias("__s"))
    both = table.withColumn("__s", F.lit(0)).unionByName(s, allowMissingColumns=True)

    def later(*keys: str) -> Column:
        own = Window.partitionBy(*keys)
        return F.sum("__s").over(own) - F.sum("__s").over(own.orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow))

    out = both.withColumn("newer", F.when(F.col(seq).isNull() | F.col(sha).isNull(), F.lit(0)).otherwise(later(*by) - later(*by, sha)).cast("long"))
    return out.filter("__s = 0").select(*table.columns, "newer")


def waves_since(points: DataFrame, waves: DataFrame, by: Sequence[str], at: str, planned: str, closed: str, until: str | None = None) -> DataFrame:
    """For each point how many waves of its group were planned from it on, and closed (before until, if given): a range join inside equal groups, of the different points only."""
    w = waves.filter(F.col(planned).isNotNull() & F.col(closed).isNotNull()).select(*by, F.col(planned).alias("__p"), F.col(closed).alias("__c"))
    if until is None:
        both = points.select(*by, F.col(at).alias("__p")).distinct().withColumn("__w", F.lit(0)).unionByName(w.select(*by, "__p", F.lit(1).alias("__w")))
        own = Window.partitionBy(*by)
        before = F.coalesce(F.sum("__w").over(own.orderBy("__p").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("__w").over(Window.partitionBy(*by, "__p"))
        counted = both.withColumn("waves", (F.sum("__w").over(own) - before).cast("long")).filter("__w = 0").select(*by, F.col("__p").alias(at), "waves")
        return points.join(counted, [*by, at], "left").withColumn("waves", F.coalesce("waves", F.lit(0).cast("long"))).select(*points.columns, "waves")
    keys = [*by, at, until]
    inside = points.select(*keys).distinct().join(w, list(by)).filter((F.col("__p") >= F.col(at)) & (F.col("__c") < F.col(until)))
    counted = inside.groupBy(*keys).agg(F.count("*").alias("waves"))
    return points.join(counted, keys, "left").withColumn("waves", F.coalesce("waves", F.lit(0).cast("long"))).select(*points.columns, "waves")


def coverage(done: DataFrame, required: DataFrame, by: Sequence[str], kind: str, replica: str, need: str) -> DataFrame:
    """Kinds of which a group has fewer different replicas than required. required is a table of kinds; it goes to the groups as one value."""
    have = done.groupBy(*by, kind).agg(F.count_distinct(replica).alias("have"))
    kinds = required.agg(F.collect_list(F.struct(F.col(kind).alias("k"), F.col(need).alias("n")))).scalar()
    wanted = done.select(*by).distinct().select(*by, F.explode(kinds).alias("__k")).select(*by, F.col("__k.k").alias(kind), F.col("__k.n").alias(need))
    return wanted.join(have, [*by, kind], "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < F.col(need))


def weighted_mode(table: DataFrame, by: Sequence[str], value: str, weight: Column, order: str) -> DataFrame:
    """The value with the greatest total weight; of equal ones that which comes first."""
    each = table.groupBy(*by, value).agg(F.sum(weight).alias("w"), F.min(order).alias("pos"))
    best = each.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col("w").alias("w")), F.struct(F.col("w"), -F.col("pos"))).alias("b"), F.sum("w").alias("all"))
    return best.select(*by, F.col("b.v").alias("mode"), F.col("b.w").alias("weight"), F.round(F.col("b.w") / F.col("all"), 6).alias("share"))


def tolerance_share(table: DataFrame, by: Sequence[str], ok: Column, good: float, fair: float) -> DataFrame:
    """How many rows lie within a tolerance, their share, and its band."""
    out = table.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("within")).withColumn("s", F.col("within") / F.col("n"))
    return out.select(*by, "n", "within", F.col("s").alias("share"), F.when(F.col("s") >= good, "ok").when(F.col("s") >= fair, "warning").otherwise("error").alias("level"))


def counts_by_status(table: DataFrame, by: Sequence[str], status: str, statuses: Sequence[str]) -> DataFrame:
    """A column for each of a fixed list of statuses."""
    return table.groupBy(*by).pivot(status, list(statuses)).agg(F.count(F.lit(1))).na.fill(0)


def top_k(table: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group; equal counts in the order of the values."""
    counted = table.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def seeded_sample(table: DataFrame, by: Sequence[str], order: str, n: int, seed: int) -> DataFrame:
    """n rows of each group by a hash of seed and place, the same on every run; all rows where n is 0."""
    if n == 0:
        return table
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, order), order)
    return table.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def override_union(*tables: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of all tables; of equal keys the one of the last table stays."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("__p", F.lit(i))
        every = t if every is None else every.unionByName(t)
    w = Window.partitionBy(*on).orderBy(F.desc("__p"))
    return every.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__p", "__k")


def filled_forward(table: DataFrame, by: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """table with the last value that is not null at or before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn(out, F.last(value, ignorenulls=True).over(w))
