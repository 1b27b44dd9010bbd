"""Exact deduplication by two passes over a Bloom filter.

One scan reads the texts, and stores each row's place, id and digest. The first pass over these counts, for each of a row's two filter cells, whether a second row hits it, and keeps the cells with two hits or more as a bit map, sized by the number of rows up to a bound. The second pass looks each row's cells up in that map: a row with a cell that no other row hits is unique and passes straight through; only the others are shuffled and grouped by the full digest, so the filter's errors never change the result. Beyond the bound more rows are shuffled, and nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import adding_columns, ascii_lower_col, heavy_rows, keeping_columns, settled, stored

#: Bits of one map piece, as bitmap_construct_agg makes them.
PIECE = 32_768
OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


def _bit(map_col: str, cell_col: str) -> Column:
    """Whether the cell's bit is set; false where the map has no such piece."""
    byte = F.expr(f"conv(hex(substring({map_col}, cast(pmod({cell_col}, {PIECE}) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    return F.coalesce(F.expr(f"cast(pmod({cell_col}, 8) as int)").isNotNull() & (F.call_function("getbit", byte, F.expr(f"cast(pmod({cell_col}, 8) as int)")) == 1), F.lit(False))


def cell_map(cells: DataFrame) -> DataFrame:
    """(piece, bits): the map of the cells in column cell."""
    return cells.groupBy(F.expr(f"cell div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(pmod(cell, {PIECE}))").alias("bits"))


def all_cells(rows: DataFrame, digest: str, size: int) -> DataFrame:
    """(cell): both cells of each row's digest."""
    return rows.select(F.explode(F.array(*cells_of(digest, size))).alias("cell"))


def repeated_cells(rows: DataFrame, digest: str, size: int) -> DataFrame:
    """(piece, bits): the map of the cells that two rows or more hit."""
    return cell_map(all_cells(rows, digest, size).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"))


def filter_size(rows: int, most: int) -> int:
    """Bits for so many rows: sixteen for each row (then some 1.4 % of the unique rows are taken for repeated ones), a multiple of PIECE, most at most."""
    return max(PIECE, min(most, -(-16 * rows // PIECE) * PIECE))


def seen(rows: DataFrame, digest: str, bits: DataFrame, size: int) -> DataFrame:
    """rows with __maybe: are both cells of the row's digest in the map."""
    for i, cell in enumerate(cells_of(digest, size)):
        rows = rows.withColumn(f"__c{i}", cell).withColumn("__piece", F.expr(f"__c{i} div {PIECE}"))
        rows = rows.join(bits.select(F.col("piece").alias("__piece"), F.col("bits").alias(f"__b{i}")), "__piece", "left")
    return rows.withColumn("__maybe", _bit("__b0", "__c0") & _bit("__b1", "__c1")).drop("__piece", "__b0", "__b1", "__c0", "__c1")


def cells_of(digest: str, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(size)) for i in (0, 1)]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 30) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; input columns of these names give way.

    Texts are equal when identical after lower-casing A-Z (null counts as empty). Of equal texts the row with the largest id stays (ids compare as they are; null is the smallest); if rows repeat that id too, one of them stays. kept is true in exactly one row of each group. An empty table gives an empty table. A table that isn't read from files alone is stored first, since it is read more than once.

    most_bits bounds what is broadcast (most_bits / 8 bytes a copy). A text with over a thousandth of all rows, or over a million, is resolved by a broadcast join (of at most a thousand groups, or one for each million rows), so no task gets a hot text's rows.
    """
    if most_bits % PIECE or most_bits <= 0:
        raise ValueError(f"most_bits is a multiple of {PIECE}")
    return adding_columns(docs, OUTPUT, lambda d, name: _grouped(d, name[id_col], name[text_col], most_bits))


def _grouped(docs: DataFrame, id_col: str, text_col: str, most_bits: int) -> DataFrame:
    base = docs = settled(docs)
    digest = F.unhex(F.sha2(ascii_lower_col(F.col(text_col).cast("string")).cast("binary"), 256))
    place = F.monotonically_increasing_id()
    rows = stored(docs.select(F.col(id_col).alias("id"), place.alias("row"), digest.alias("digest")), "digests")
    total = rows.count()
    size = filter_size(total, most_bits)
    # cells lie in a map as bits, so it is small: most_bits / 8 bytes at most
    bits = F.broadcast(stored(repeated_cells(rows, "digest", size), "bits"))
    best = F.max(F.struct("id", "row"))
    groups = stored(seen(rows, "digest", bits, size).filter("__maybe").groupBy("digest").agg(F.count("*").alias("__n"), best.alias("__best")).filter("__n > 1").withColumnRenamed("digest", "__digest"), "groups")
    heavy = heavy_rows(total)
    hot = F.broadcast(groups.filter(F.col("__n") > heavy))
    columns = [*base.columns, *OUTPUT]

    def resolved(rows: DataFrame) -> DataFrame:
        """Rows with __n and __best of their group, null for a row that is alone."""
        named = rows.withColumns({"keep_id": F.when(F.col("__n").isNull(), F.col(id_col)).otherwise(F.col("__best.id")), "group_size": F.coalesce("__n", F.lit(1)).cast("long"), "kept": F.coalesce(F.col("__best.row") == F.col("__row"), F.lit(True))})
        return named.withColumn("text_sha256", F.lower(F.hex("__digest"))).select(*columns)

    # one scan for the rows that pass straight through or are in a hot group, one for those that are shuffled
    found = seen(base.withColumns({"__digest": digest, "__row": place}), "__digest", bits, size).join(hot, "__digest", "left")
    straight = resolved(found.filter("not __maybe or __n is not null"))
    shuffled = resolved(found.filter("__maybe and __n is null").drop("__n", "__best").join(groups.filter(F.col("__n") <= heavy), "__digest", "left"))
    return straight.unionByName(shuffled)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with docs's columns."""
    return keeping_columns(docs, lambda d, name: exact_groups(d, name[id_col], name[text_col], **options).filter("kept"))
