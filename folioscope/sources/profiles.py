"""An author's own turns of phrase, out of the style profile in a Markdown state text.

Where a line lies (in a fence, in the profile's section, in the list behind a label) is told by running windows over a text's lines; nothing is folded row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: Headings of a profile, the label of its list, labels of single turns, quoted phrases (behind a bracket they are a template's).
PROFILE = r"(?iu)personal_style_profile|личный\s+стилистический\s+профиль"
LIST_LABEL = r"(?iuU)^\*{0,2}\s*якор(?:ьки|ёк|ек)\b"
TURN_LABEL = r"(?iu)^\*{0,2}\s*оборот\s+для\s+[^:*]+:\*{0,2}\s*(.*)$"
QUOTED = r'(\[\s*)?[«"“„]([^«»"“”„\n]{2,120})[»"”“]'
HEADING = r"^[ \t]{0,3}(#{1,6})[ \t]+(.*)$"


def first_phrase(c: Column) -> Column:
    """The first quoted phrase, normalised; null where there is none."""
    found = F.filter(F.regexp_extract_all(c, F.lit(QUOTED), F.lit(0)), lambda m: ~m.startswith("["))
    return F.nullif(X.normalise_phrase(F.regexp_extract(F.get(found, 0), QUOTED, 2)), F.lit(""))


def personal_anchors(texts: DataFrame, by: Sequence[str], text_col: str) -> DataFrame:
    """by, pos (from 0) and phrase: the first quoted phrase of each item in the profile's list of anchors and of each turn, each phrase once, at its first place. Null and empty texts have none."""
    by = list(by)
    lines = texts.select(*by, F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("line", "t"))
    upto = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = X.strip(F.col("t"))
    fence = s.startswith("```") | s.startswith("~~~")
    lines = lines.withColumns({"s": s, "fence": fence, "fences": F.count_if(fence).over(upto)}).filter("not fence and fences % 2 = 0")
    level = F.length(F.regexp_extract("t", HEADING, 1))
    lines = lines.withColumn("level", F.nullif(level, F.lit(0)))
    title = F.col("level").isNotNull() & F.regexp_extract("t", HEADING, 2).rlike(PROFILE)
    lines = lines.withColumns({"own": F.when(title, F.col("level")), "profile": F.count_if(title).over(upto)})
    # a profile ends at the first heading behind its own that isn't below it
    part = Window.partitionBy(*by, "profile").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("profile") > 0) & (F.coalesce(F.min(F.when(F.col("own").isNull(), F.col("level"))).over(part), F.lit(99)) > F.first("own", ignorenulls=True).over(part))
    lines = lines.withColumn("inside", inside)
    label, turn = F.col("s").rlike(LIST_LABEL), F.col("s").rlike(TURN_LABEL)
    plain = F.col("inside") & F.col("level").isNull() & (F.col("s") != "") & ~F.col("s").startswith("<!--")
    switch = F.when(F.col("level").isNotNull(), False).when(plain & label, True).when(plain & (turn | F.col("s").startswith("**")), False)
    lines = lines.withColumn("listed", F.coalesce(F.last(switch, ignorenulls=True).over(upto), F.lit(False)))
    phrase = F.when(plain & ~label, F.when(turn, first_phrase(F.regexp_extract("s", TURN_LABEL, 1))).when(F.col("listed") & F.substring("s", 1, 1).isin("-", "*", "+"), first_phrase(F.col("s"))))
    found = lines.select(*by, "line", phrase.alias("phrase")).filter("phrase is not null").groupBy(*by, "phrase").agg(F.min("line").alias("line"))
    return found.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("line")) - 1).alias("pos"), "phrase")
