"""Running values over a video's rows, in blocks: for videos too long for one task.

A window by video is one task a video. Here a video's rows are dealt by blocks of their order;
each block has running values of its own, its totals are carried into the blocks after it by
a window over one row a block, and both are put together. So a long video is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan(rows: DataFrame, order: tuple[str, ...], block: int, by_video: DataFrame | None = None, how: str = "left", **values: tuple[str, Column]) -> DataFrame:
    """rows with a column for each of ``values``, name=(kind, column), over the rows of its video in ``order``.

    Kinds: ``count``, the place from 1; ``sum`` and ``max`` of the rows before (0 and null without any); ``last``, the
    last value that is not null up to the row itself. ``block`` rows of consecutive numbers in
    the first column of ``order``, a whole number, are a block. Rows without a place in the
    order come first, as windows have it. ``by_video``: a table by video_id, whose other columns each row gets; it is joined
    (``how``) to the blocks, so that no row is dealt by its video.

    ``rows`` are read twice (totals; running values), so hand over a staged table; they are exchanged
    once, for one key of video and block holds for window and join, null or not.
    """
    names = {n: f"__{n}" for n in values}
    at = F.struct(F.col("video_id").alias("video"), F.floor(F.col(order[0]) / block).alias("no"))
    columns = [c for c in rows.columns if c not in values]
    rows = rows.select(at.alias("__at"), *(c for c in rows.columns if c != "video_id"), *(c.alias(names[n]) for n, (_, c) in values.items()))
    w = Window.partitionBy("__at").orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("__at.video").orderBy("__at.no").rowsBetween(Window.unboundedPreceding, -1)
    totals, lasts, carried, own, out = [], [], {}, {}, {}
    for n, (kind, _) in values.items():
        c, t, o = F.col(names[n]), f"__carry_{n}", f"__own_{n}"
        if kind == "count":
            own[o] = F.row_number().over(w)
            totals.append(F.count("*").alias(t))
        elif kind == "sum":
            own[o] = F.coalesce(F.sum(c).over(before), F.lit(0))
            totals.append(F.sum(c).alias(t))
        elif kind == "max":
            own[o] = F.max(c).over(before)
            totals.append(F.max(c).alias(t))
        elif kind == "last":
            own[o] = F.last(c, True).over(upto)
            # texts are not summed up by hashing, so only rows that have one are looked at
            lasts.append(rows.filter(c.isNotNull()).groupBy("__at").agg(F.max_by(c, F.struct(*order)).alias(t)))
        else:
            raise ValueError(f"no kind of running value: {kind}")
        carry = {"max": F.max(t), "last": F.last(t, True)}.get(kind, F.sum(t))
        carried[t] = carry.over(over)
        out[n] = {"max": F.greatest(o, t), "last": F.coalesce(o, t)}.get(kind, F.col(o) + F.coalesce(t, F.lit(0))).alias(n)
    blocks = rows.groupBy("__at").agg(*totals) if totals else rows.select("__at").distinct()
    for last in lasts:
        blocks = blocks.join(last, "__at", "left")
    blocks = blocks.withColumns(carried)
    given = []
    if by_video is not None:
        given = [c for c in by_video.columns if c != "video_id"]
        blocks = blocks.join(by_video.withColumnRenamed("video_id", "__video"), F.col("__at.video") == F.col("__video"), how).drop("__video")
    return rows.withColumns(own).join(blocks, "__at").select(*(F.col("__at.video").alias(c) if c == "video_id" else c for c in columns), *given, *out.values())
