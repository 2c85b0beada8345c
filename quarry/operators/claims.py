"""The claim layer: a deterministic classifier of candidates against stored claims, and what a promotion writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import scope_key


def families(claims: DataFrame) -> DataFrame:
    """claims with family: subject, predicate and scope."""
    return claims.withColumn("family", F.concat_ws("__", "subject", "predicate", scope_key(F.col("scope"))))


def classify(candidates: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """candidates with counterpart and relation.

    The counterpart is the highest version among active and superseded claims of the family. Without one: reinforces if the subject links to the
    object, orthogonal if the subject has any active claim, else no_counterpart.
    """
    c, k = families(candidates), families(claims)
    newest = Window.partitionBy("family").orderBy(F.desc("version"), "claim_id")
    best = k.where("state IN ('active', 'superseded')").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    best = best.select("family", F.col("claim_id").alias("counterpart"), F.col("polarity").alias("_polarity"), F.col("objects").alias("_objects"), F.col("qualifier").alias("_qualifier"))
    linked = links.select(F.col("src").alias("subject"), F.col("dst").alias("object")).distinct().withColumn("_linked", F.lit(True))
    active = claims.where("state = 'active'").select("subject").distinct().withColumn("_active", F.lit(True))
    x = c.join(best, "family", "left").join(linked, ["subject", "object"], "left").join(active, "subject", "left")
    kind = (
        F.when(~F.col("polarity").eqNullSafe(F.col("_polarity")), "contradicts")
        .when(F.col("refines"), "qualifies_or_extends")
        .when(~F.array_contains("_objects", F.col("object")), "qualifies_or_extends")
        .when(F.col("qualifier").eqNullSafe(F.col("_qualifier")), "reinforces")
        .otherwise("supersedes")
    )
    relation = F.when(F.col("counterpart").isNotNull(), kind).when(F.col("_linked"), "reinforces").when(F.col("_active"), "orthogonal").otherwise("no_counterpart")
    return x.withColumn("relation", relation).drop("_polarity", "_objects", "_qualifier", "_linked", "_active")


def disposition(drift_class, drift_fingerprint):
    return F.when(drift_class & drift_fingerprint, "human_review").when(drift_class, "investigate").when(drift_fingerprint, "auto_promote_with_note").otherwise("auto_promote")


def promote(classified: DataFrame, claims: DataFrame) -> DataFrame:
    """New claims: for contradicts, supersedes, reinforces and refining qualifiers, numbered on from their family's largest version in the order of candidates."""
    top = families(claims).groupBy("family").agg(F.max("version").alias("_top"))
    made = classified.where("relation IN ('contradicts', 'supersedes', 'reinforces') OR (relation = 'qualifies_or_extends' AND refines)").where("counterpart IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("family").orderBy("candidate_id"))
    return made.join(top, "family", "left").select("candidate_id", "family", "relation", "counterpart", (F.coalesce("_top", F.lit(0)) + n).cast("long").alias("version"))
