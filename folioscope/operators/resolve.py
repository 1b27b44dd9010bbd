"""Resolution by rules of precedence: decision tables with wildcards, matches by ranked keys, nearest settings, renumbered registries.

All of them are equi-joins and partial aggregates: a wildcard becomes one join for each pattern of open columns that the table has, an alternative key a tagged key, a path its prefixes. No join has a condition that isn't an equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.deal import dealt_by

#: When a reviewer may answer that a check doesn't apply. None stands for any value; the row with the most values decides.
NOT_APPLICABLE = (
    # gate, preset, type, has_docx, has_product, allowed
    (None, None, None, None, None, False),
    ("EVD", None, "regular", None, False, True),
    ("TEC", None, "regular", None, False, True),
    ("DOC", None, None, False, None, True),
    ("DOC", "final", None, False, None, False),
)
NOT_APPLICABLE_COLUMNS = "gate string, preset string, type string, has_docx boolean, has_product boolean, allowed boolean"


def by_policy(rows: DataFrame, policy: DataFrame, keys: Sequence[str], decision: str) -> DataFrame:
    """rows with decision, specificity and conflict. policy: keys (null: any value) and decision.

    Of the policy's rows that fit, those with the most given keys decide; their number of keys is the specificity. If these disagree, conflict is true and the decision is the smallest; if none fits, decision and specificity are null. A row's null key fits open keys only. rows keep their places: each pattern of open keys in the policy (2^keys at most, whatever the policy's length) is one equi-join with the policy's distinct rows of that pattern.
    """
    given = [F.col(k).isNotNull() for k in keys]
    mask = sum((F.when(g, 1 << i).otherwise(0) for i, g in enumerate(given)), F.lit(0))
    tagged = policy.select(*keys, F.col(decision).alias("__d"), mask.alias("__mask"))
    masks = sorted((r[0] for r in tagged.select("__mask").distinct().collect()), key=lambda m: (-m.bit_count(), m))
    out, found = rows.drop(decision, "specificity", "conflict"), []
    for m in masks:
        own = [k for i, k in enumerate(keys) if m >> i & 1]
        names = [f"__{m}_{k}" for k in own]
        table = tagged.filter(F.col("__mask") == m).groupBy(*[F.col(k).alias(n) for k, n in zip(own, names)]).agg(F.min("__d").alias(f"__low{m}"), F.max("__d").alias(f"__high{m}"))
        if own:
            out = out.join(table, [F.col(k) == F.col(n) for k, n in zip(own, names)], "left").drop(*names)
        else:
            low, high = table.first()  # the default: one row
            out = out.withColumns({f"__low{m}": F.lit(low), f"__high{m}": F.lit(high)})
        found.append((m.bit_count(), F.col(f"__low{m}"), F.col(f"__high{m}")))
    none = F.lit(None).cast(dict(tagged.dtypes)["__d"])
    decided, specificity, conflict = none, F.lit(None).cast("int"), F.lit(False)
    for n in sorted({n for n, _, _ in found}):  # the most specific last, so that it is asked first
        low, high = [a for k, a, _ in found if k == n], [b for k, _, b in found if k == n]
        least, most = (F.least(*low), F.greatest(*high)) if len(low) > 1 else (low[0], high[0])
        decided = F.when(least.isNotNull(), least).otherwise(decided)
        specificity = F.when(least.isNotNull(), F.lit(n)).otherwise(specificity)
        conflict = F.when(least.isNotNull(), least != most).otherwise(conflict)
    return out.withColumns({decision: decided, "specificity": specificity, "conflict": conflict}).select(*[c for c in rows.columns if c not in (decision, "specificity", "conflict")], decision, "specificity", "conflict")


def by_ranked_keys(rows: DataFrame, records: DataFrame, id_col: str, record_id: str, keys: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """id_col, record_id and source: for each row the record that matches by the first key that matches at all; of several records the one with the smallest id. keys: (name, the row's key, the record's key) by rank; a null key matches nothing. Rows without a match have null.

    One join over all keys, each tagged by its rank, and one aggregate; records that share a key are reduced to the smallest first, so that no key is hot on both sides.
    """
    tag = lambda which: F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), k[which].cast("string").alias("key")) for i, k in enumerate(keys)]))
    theirs = records.select(F.col(record_id).alias("__record"), tag(2).alias("k")).filter("k.key is not null").groupBy("k.rank", "k.key").agg(F.min("__record").alias("__record"))
    ours = rows.select(F.col(id_col).alias("__id"), tag(1).alias("k")).select("__id", "k.rank", "k.key")
    best = F.min(F.when(F.col("__record").isNotNull(), F.struct("rank", "__record")))
    found = ours.join(theirs, ["rank", "key"], "left").groupBy("__id").agg(best.alias("b"))
    names = F.array(*[F.lit(name) for name, _, _ in keys])
    return found.select(F.col("__id").alias(id_col), F.col("b.__record").alias(record_id), F.get(names, F.col("b.rank")).alias("source"))


def prefixes(path: Column, separator: str = "/") -> Column:
    """All ancestors of a path and itself, shortest first, without a separator at the end."""
    parts = F.filter(F.split(path, separator), lambda p, i: (p != "") | (i == 0))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def nearest(paths: DataFrame, configs: DataFrame, path: str, config_path: str, values: Sequence[str], separator: str = "/") -> DataFrame:
    """Each distinct path with the path and the values of the nearest configuration: the longest of its ancestors (or itself) that has one; null where none has. Of several configurations of one place the one with the smallest values counts."""
    place = F.array_join(F.filter(F.split(F.col(config_path), separator), lambda p, i: (p != "") | (i == 0)), separator)
    own = configs.filter(F.col(config_path).isNotNull()).groupBy(place.alias("__at")).agg(F.min(F.struct(*values)).alias("__values"))
    each = paths.select(F.col(path).alias("__path")).filter("__path is not null").distinct().select("__path", F.explode(prefixes(F.col("__path"), separator)).alias("__at"))
    best = F.max_by(F.struct(F.col("__at").alias("at"), F.col("__values").alias("v")), F.when(F.col("__values").isNotNull(), F.length("__at")))
    found = each.join(own, "__at", "left").groupBy("__path").agg(best.alias("b"), F.count("__values").alias("n"))
    has = F.col("n") > 0
    return found.select(F.col("__path").alias(path), F.when(has, F.col("b.at")).alias(config_path), *[F.when(has, F.col("b.v")[v]).alias(v) for v in values])


def renumbered(before: DataFrame, after: DataFrame, by: Sequence[str], number: str, id_col: str) -> DataFrame:
    """What became of each entry of a registry: by, id_col, status, and the smallest old and new number.

    added and removed; split: several numbers now; merged: its number now has several entries; kept: its number is the same; swapped: it has the number of an entry that now has its own; moved: any other number. Both maps ought to be bijections of numbers and ids; whatever isn't kept, swapped or moved breaks that.
    """
    by = list(by)
    old = before.groupBy(*by, id_col).agg(F.min(number).alias("old"))
    new = after.groupBy(*by, id_col).agg(F.min(number).alias("new"), F.count_distinct(number).alias("__numbers"))
    shared = after.groupBy(*by, number).agg((F.count_distinct(id_col) > 1).alias("__shared")).filter("__shared").withColumnRenamed(number, "new")
    both = old.join(new, [*by, id_col], "full").join(shared, [*by, "new"], "left")
    # who had the number that an entry has now, and which number has that one now
    held = before.groupBy(*by, F.col(number).alias("new")).agg(F.min(id_col).alias("__holder"))
    places = new.select(*by, F.col(id_col).alias("__holder"), F.col("new").alias("__theirs"))
    seen = both.join(held.join(places, [*by, "__holder"]), [*by, "new"], "left")
    status = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("__numbers") > 1, "split")
        .when(F.coalesce("__shared", F.lit(False)), "merged")
        .when(F.col("old") == F.col("new"), "kept")
        .when(F.coalesce(F.col("__theirs") == F.col("old"), F.lit(False)), "swapped")
        .otherwise("moved")
    )
    return seen.select(*by, id_col, status.alias("status"), "old", "new")


def map_problems(entries: DataFrame, registry: DataFrame, by: Sequence[str], number: str, id_col: str, text: str) -> DataFrame:
    """Why a list's numbers can't be tied to a registry's entries: by, number, problem. entries: number, id_col, text as they were built; registry: id_col and the text that it gives now.

    doubled: the number stands at several entries; unknown: no such id in the registry; changed: the text isn't the registry's now; foreign: it is the text of another entry, so the number was set on another source."""
    by = list(by)
    own = registry.groupBy(*by, id_col).agg(F.min(text).alias("__now"))
    theirs = registry.filter(F.col(text).isNotNull()).groupBy(*by, F.col(text).alias(text)).agg(F.min(id_col).alias("__other"))
    times = entries.groupBy(*by, number).agg(F.count("*").alias("__n")).filter("__n > 1")
    seen = entries.join(own, [*by, id_col], "left").join(theirs, [*by, text], "left").join(times, [*by, number], "left")
    changed = ~F.col(text).eqNullSafe(F.col("__now"))
    code = F.array_compact(F.array(F.when(F.col("__n").isNotNull(), "doubled"), F.when(F.col("__now").isNull(), "unknown").when(changed & F.col("__other").isNotNull(), "foreign").when(changed, "changed")))
    return seen.select(*by, number, id_col, F.explode(code).alias("problem"))


def _packed(text: Column) -> Column:
    """A text as bytes that only its like has; a SHA-256 in lower case takes half of its length."""
    return F.when(text.rlike("^[0-9a-f]{64}\\z"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), F.encode(text, "utf-8")))


def chain_problems(events: DataFrame, by: Sequence[str], order: str, sha: str, previous: str, content: Column) -> DataFrame:
    """Broken links of a log in which each record holds its own SHA-256 and that of the one before: by, order, problem, first.

    All links are verified at once: tampered: the SHA isn't that of the previous one and the content (a digest); orphan: no record has the previous SHA; fork: several records have the same previous one; beginning: a second record without a previous one. first marks the first broken record of each log. A null previous SHA stands for the beginning.
    """
    by = list(by)
    made = F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), content).cast("binary"), 256)
    own = F.coalesce(made == F.col(sha), F.lit(False))
    # each record asks for the SHA before it and offers its own; both meet once, and nothing else is sent
    asks = F.struct(_packed(F.when(F.col(previous) != "", F.col(previous))).alias("__key"), F.col(order).alias("__o"), own.alias("__own"))
    offers = F.struct(_packed(F.col(sha)).alias("__key"), F.lit(None).cast(events.schema[order].dataType).alias("__o"), F.lit(None).cast("boolean").alias("__own"))
    met = dealt_by(events.select(*by, F.explode(F.array(asks, offers)).alias("__t")).select(*by, "__t.*").filter("__own is not null or __key is not null"), *by, "__key")
    w = Window.partitionBy(*by, "__key")
    seen = met.withColumn("__first", F.min("__o").over(w)).withColumn("__there", F.bool_or(F.col("__own").isNull()).over(w)).filter("__own is not null")
    later = F.col("__o") > F.col("__first")
    code = F.array_compact(F.array(F.when(~F.col("__own"), "tampered"), F.when(F.col("__key").isNotNull() & ~F.col("__there"), "orphan"), F.when(later & F.col("__key").isNotNull(), "fork").when(later, "beginning")))
    broken = seen.select(*by, F.col("__o").alias(order), F.explode(code).alias("problem"))
    return broken.withColumn("first", F.col(order) == F.min(order).over(Window.partitionBy(*by)))


def manifest_kind(schema: Column, marks: Column, expected: str) -> Column:
    """native by its schema; legacy without one, unless it has marks that only a native record has: then tampered."""
    return F.when(schema == expected, "native").when(marks, "tampered").otherwise("legacy")
