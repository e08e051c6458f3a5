"""Field ownership over many fields at once, by windows instead of a loop.

A field of an entity passes through three states at most: unowned, owned by an
aggregate, owned by an official source. Who owns it, and from which observation
on, are minima over the entity's observations; its value is the last one that
its owner of the time stated. So nothing is gathered into one row: a window
sorts, and spills, within (entity, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATE = "aggregate:"


def owner_tag(official: Column, source: Column) -> Column:
    return F.concat(F.when(official, "official:").otherwise(AGGREGATE), source.cast("string"))


def fold_fields(statements: DataFrame, base: DataFrame) -> DataFrame:
    """The changes that ``statements`` make to ``base``, one row each: (entity_id, seq, field, old, new, value, owner).

    statements: (entity_id, seq, field, mark, value, tag, official), only those
    that count; seq orders an entity's observations and is unique among them.
    base: (entity_id, field, mark, value, owner), at most one row a field; no
    row means null and unowned. Values are compared by ``mark``, which old and
    new hold. A statement changes a field if its mark differs from the present
    one and the field has no owner, or its own source owns it, or it is official
    and an aggregate owns it; then its source is the owner. Statements with a
    null entity or field are left out.
    """
    b = base.select(F.col("entity_id").alias("__e"), F.col("field").alias("__f"), F.col("mark").alias("__mark"), F.col("owner").alias("__owner"))
    rows = statements.where("entity_id IS NOT NULL AND field IS NOT NULL").join(b, (F.col("entity_id") == F.col("__e")) & (F.col("field") == F.col("__f")), "left").drop("__e", "__f")
    by = Window.partitionBy("entity_id", "field").orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    present = F.struct(F.col("__mark").alias("mark"))

    # who takes a field without owner, and when
    differs = ~F.col("mark").eqNullSafe(F.col("__mark"))
    rows = rows.withColumn("__first", F.when(F.col("__owner").isNull(), F.min(F.when(differs, F.struct("seq", "tag"))).over(whole)))
    rows = rows.withColumn("__one", F.coalesce("__owner", "__first.tag"))
    mine = (F.col("tag") == F.col("__one")) & (F.col("__first").isNull() | (F.col("seq") >= F.col("__first.seq")))
    # when an official source takes it from an aggregate
    rows = rows.withColumn("__mine", F.coalesce(mine, F.lit(False)))
    held = F.coalesce(F.last(F.when(F.col("__mine"), F.struct("mark")), ignorenulls=True).over(earlier), present)
    rows = rows.withColumn("__held", held)
    later = F.col("__first").isNull() | (F.col("seq") > F.col("__first.seq"))
    takes = F.col("__one").startswith(AGGREGATE) & F.col("official") & later & ~F.col("mark").eqNullSafe(F.col("__held.mark"))
    rows = rows.withColumn("__second", F.min(F.when(takes, F.struct("seq", "tag"))).over(whole))
    after = F.coalesce(F.col("seq") >= F.col("__second.seq"), F.lit(False))
    rows = rows.withColumn("__says", F.when(after, F.col("tag") == F.col("__second.tag")).otherwise(F.col("__mine")))
    # a value's changes: what its owner of the time says, where that is new
    rows = rows.withColumn("__old", F.coalesce(F.last(F.when(F.col("__says"), F.struct("mark")), ignorenulls=True).over(earlier), present))
    changed = rows.where(F.col("__says") & ~F.col("mark").eqNullSafe(F.col("__old.mark")))
    return changed.select("entity_id", "seq", "field", F.col("__old.mark").alias("old"), F.col("mark").alias("new"), "value", F.col("tag").alias("owner"))
