"""Numbers and neighbours of ordered rows, also where one group has most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Places of a partition's own rows in monotonically_increasing_id().
PART_BITS = 33


def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def numbered(rows: DataFrame, group: list[str], order: list[str], tag: str, beside: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with `rank` (from 0, over all), `group_no` (from 0), `place` (from 0, in its group) and `group_size`.

    Rows lie in ascending order of group and order, nulls first; where these are equal, one of
    the possible orders is taken and kept. For each column c in beside, `before_c` and
    `after_c` are its values in the neighbours of the same group, null at a group's ends.

    The rows are range-partitioned on group and order and written once, so a group of any
    size spreads over all tasks. Inside a part they are numbered by windows; what a part
    takes from the parts before and after it (rows, groups, the edges of the groups that go
    on) is one row a part, which bounds the only window over all and the broadcast."""
    keys = [_named(k).asc_nulls_first() for k in (*group, *order)]
    n = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    held = written(lined, tag).withColumns({"_part": F.shiftright("_id", PART_BITS), "_at": F.col("_id").bitwiseAND((1 << PART_BITS) - 1)})
    up, down = Window.partitionBy("_part").orderBy("_at"), Window.partitionBy("_part").orderBy(F.desc("_at"))
    own = F.struct(*map(_named, group)) if group else F.lit(0)
    side = F.struct(*[_named(c).alias(f"c{i}") for i, c in enumerate(beside)]) if beside else F.lit(0)
    seen = held.withColumns({"_group": own, "_side": side})
    starts = (F.col("_at") == 0) | ~F.lag("_group").over(up).eqNullSafe(F.col("_group"))
    seen = seen.withColumns({"_start": starts, "_ends": F.lead("_at").over(up).isNull() | ~F.lead("_group").over(up).eqNullSafe(F.col("_group"))})
    seen = seen.withColumns({
        "_first": F.last(F.when(F.col("_start"), F.col("_at")), ignorenulls=True).over(up),
        "_groups": F.sum(F.col("_start").cast("long")).over(up),
        "_last": F.last(F.when(F.col("_ends"), F.col("_at")), ignorenulls=True).over(down),
        "_left": F.when(~F.col("_start"), F.lag("_side").over(up)),
        "_right": F.when(~F.col("_ends"), F.lead("_side").over(up)),
    })
    edges = held.withColumns({"_group": own, "_side": side}).groupBy("_part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("_group", "_side"), "_at").alias("head"),
        F.max_by(F.struct("_group", "_side"), "_at").alias("foot"),
    )
    inner = seen.groupBy("_part").agg(F.max("_groups").alias("groups"), F.max("_first").alias("last_start"), F.min("_last").alias("first_end"))
    ahead, after = Window.orderBy("_part"), Window.orderBy(F.desc("_part"))
    strictly = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    line = edges.join(inner.hint("merge"), "_part")
    line = line.withColumns({
        "rows_ahead": F.coalesce(F.sum("n").over(strictly(ahead)), F.lit(0)),
        "joined": F.coalesce(F.lag("foot").over(ahead)["_group"].eqNullSafe(F.col("head._group")), F.lit(False)) & F.lag("n").over(ahead).isNotNull(),
        "goes_on": F.coalesce(F.lead("head").over(ahead)["_group"].eqNullSafe(F.col("foot._group")), F.lit(False)) & F.lead("n").over(ahead).isNotNull(),
        "left_side": F.lag("foot").over(ahead)["_side"],
        "right_side": F.lead("head").over(ahead)["_side"],
    })
    one = F.col("groups") == 1
    line = line.withColumns({
        "groups_ahead": F.coalesce(F.sum(F.col("groups") - F.col("joined").cast("long")).over(strictly(ahead)), F.lit(0)),
        "began": F.when(~(one & F.col("joined")), F.col("rows_ahead") + F.col("last_start")),
        "ended": F.when(~(one & F.col("goes_on")), F.col("rows_ahead") + F.col("first_end")),
    })
    line = line.select(
        "_part", "n", "rows_ahead", "groups_ahead", "joined", "goes_on", "left_side", "right_side",
        F.last("began", ignorenulls=True).over(strictly(ahead)).alias("began"),
        F.last("ended", ignorenulls=True).over(strictly(after)).alias("ended"),
    )
    all_ = seen.join(F.broadcast(line), "_part")  # a row a part
    from_left, to_right = F.col("joined") & (F.col("_first") == 0), F.col("goes_on") & (F.col("_last") == F.col("n") - 1)
    first = F.when(from_left, F.col("began")).otherwise(F.col("rows_ahead") + F.col("_first"))
    last = F.when(to_right, F.col("ended")).otherwise(F.col("rows_ahead") + F.col("_last"))
    rank = F.col("rows_ahead") + F.col("_at")
    left = F.when((F.col("_at") == 0) & F.col("joined"), F.col("left_side")).otherwise(F.col("_left"))
    right = F.when((F.col("_at") == F.col("n") - 1) & F.col("goes_on"), F.col("right_side")).otherwise(F.col("_right"))
    return all_.select(
        *[_named(c) for c in rows.columns],
        rank.alias("rank"),
        (F.col("groups_ahead") - F.col("joined").cast("long") + F.col("_groups") - 1).alias("group_no"),
        (rank - first).alias("place"),
        (last - first + 1).alias("group_size"),
        *[left[f"c{i}"].alias(f"before_{c}") for i, c in enumerate(beside)],
        *[right[f"c{i}"].alias(f"after_{c}") for i, c in enumerate(beside)],
    )
