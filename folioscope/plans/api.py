"""The library's front: documents in, measures, risks, sections, citations, records, checks, differences and registries out."""

from __future__ import annotations

from folioscope.operators.audit import replay
from folioscope.operators.doctor import diagnose, readiness
from folioscope.operators.finals import next_actions
from folioscope.operators.bibliography import formatted as bibliography
from folioscope.operators.citations import strict_refs as citation_refs
from folioscope.operators.metrics import risk
from folioscope.operators.registry import snapshot_diff as diff
from folioscope.operators.rules import checks
from folioscope.operators.segments import sections
from folioscope.operators.works import build_stats, content_key, content_problems
from folioscope.operators.works import validator_regions as places

__all__ = ["bibliography", "build", "build_stats", "checks", "citation_refs", "citations", "content_key", "content_problems", "diagnose", "diff", "metrics", "next_actions", "places", "readiness", "replay", "risk", "sections"]

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import bibliography as B
from folioscope.operators import citations as C
from folioscope.operators import metrics as M
from folioscope.operators import registry as R


def metrics(docs: DataFrame) -> DataFrame:
    """All measures of each document, one struct each, in one map over the rows."""
    keep = list(dict.fromkeys(["doc_id", "text", *docs.columns]))
    df = M.prepared(docs.select(*keep))
    made = [c for c in df.columns if c not in keep]
    keep = list(df.columns)
    steps = {"burstiness": M.burstiness, "phrases": M.phrase_density, "lexical": M.lexical_diversity, "rhythm": M.paragraph_rhythm, "starters": M.starter_variety, "passive": M.passive_ratio, "readability": M.readability, "anchors": M.author_anchors, "pronouns": M.pronouns}
    for name, measure in steps.items():
        out = measure(df, keep=keep)
        df = out.select(*keep, F.struct(*[F.col(c) for c in out.columns if c not in keep]).alias(name))
        keep.append(name)
    return df.drop("text", *made)


def citations(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each reference of each text, in order."""
    return texts.select(key, F.posexplode(C.strict_refs(F.col(text))).alias("pos", "ref"))


def build(texts: DataFrame, registry: DataFrame, by: str, key: str) -> dict[str, DataFrame]:
    """A work's build: violations (references without a source, sources not confirmed), the numbered bibliography of cited sources in alphabetical order, and texts with numbers. Emit the last two only where violations has no error.

    texts: by, key, text; registry: by, id and the fields of a record.
    """
    refs = texts.select(by, key, F.explode(C.strict_refs(F.col("text"))).alias("ref"))
    named = registry.withColumn("ref", F.concat(F.lit("@"), F.col("id")))
    dangling = R.unmatched(refs, named, [by, "ref"]).select(by, "ref", F.lit("error").alias("level"), F.lit("no source").alias("problem")).distinct()
    cited = named.join(refs.select(by, "ref").distinct(), [by, "ref"], "left_semi")
    doubtful = cited.filter(R.normal_status(F.col("status")) != "confirmed").select(by, "ref", F.when(R.normal_status(F.col("status")) == "rejected", "error").otherwise("warning").alias("level"), F.lit("not confirmed").alias("problem"))
    records = B.formatted(cited)
    wrong = records.filter("error is not null").select(by, "ref", F.lit("error").alias("level"), F.col("error").alias("problem"))
    key_of = B.collation_key(F.coalesce("record", "title"))
    listed = R.numbered(records.filter("error is null").withColumn("__key", key_of), [by], [F.col("__key"), F.col("ref")]).drop("__key").withColumn("number", F.col("number").cast("int"))
    return {"violations": dangling.unionByName(doubtful).unionByName(wrong), "bibliography": listed.select(by, "number", "ref", "record"), "texts": C.rewrite(texts, listed, by, "text", "ref", "number").select(by, key, "rewritten")}
