"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with share p of all tokens gets a weight proportional to p ** t. The exponent t in
[0, 1] is found by interval section: the largest that meets a target entropy, or the
smallest that keeps within a repetition limit. Weights times the token budget give each
source a quota, which is realised as whole epochs plus one partial epoch: a prefix of a
pseudo-random permutation of the source's documents. The permutation orders documents by a
hash; ranges of hash values are blocks, whose token sums locate the end of the prefix
without sorting a source in one task. Each row then needs its source's plan only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow.llm.staging import stage

#: Documents of a block, on average.
BLOCK_DOCS = 1024
_SPAN = 1 << 52
#: Parts into which an interval is cut at each of so many passes: 32 ** 8 is 2 ** 40.
_PARTS, _PASSES = 32, 8


def count_tokens(text: Column) -> Column:
    """White-space separated words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _exponent(sources: DataFrame, total: int, budget: int, target_entropy: float | None, max_repetition: float | None) -> float:
    """The exponent in [0, 1]; sources: (source, tokens)."""
    if max_repetition is not None and budget > max_repetition * total * (1 + 1e-9):
        # at exponent 1 every source is repeated alike; no other exponent repeats the most repeated one less
        raise ValueError(f"a budget of {budget} tokens from {total} repeats a source {budget / total:.6g} times at least, over the limit of {max_repetition}")
    p = F.col("tokens") / F.lit(float(total))
    lo, hi = 0.0, 1.0
    for _ in range(_PASSES):
        steps = [lo + (hi - lo) * k / _PARTS for k in range(_PARTS + 1)]
        tried = sources.select(p.alias("p"), F.posexplode(F.array(*map(F.lit, steps))).alias("k", "t"))
        # entropy of w = p**t / z is log z - t * sum(p**t * log p) / z; repetition of a source is budget / total * p**(t - 1) / z
        sums = tried.groupBy("k").agg(F.sum(F.pow("p", "t")).alias("z"), F.sum(F.pow("p", "t") * F.log("p") * F.col("t")).alias("s"), F.max(F.pow("p", F.col("t") - 1)).alias("r"), F.count("*").alias("n"))
        rows = {x.k: x for x in sums.collect()}
        if target_entropy is not None:
            import math

            # entropy falls as the exponent grows: the last step that still meets the target
            good = [k for k in range(_PARTS + 1) if rows[k].n == 1 or math.log(rows[k].z) - rows[k].s / rows[k].z >= target_entropy * math.log(rows[k].n)]
            k = max(good, default=0)
            if k == _PARTS:
                return steps[k]
        else:
            # repetition falls as the exponent grows: the first step within the limit
            good = [k for k in range(_PARTS + 1) if budget / total * rows[k].r / rows[k].z <= max_repetition]
            k = min(good, default=_PARTS) - 1
            if k < 0:
                return steps[0]
        lo, hi = steps[k], steps[k + 1]
    return lo if target_entropy is not None else hi


def plan_mixture(weighed: DataFrame, budget: int | None, target_entropy: float | None, max_repetition: float | None, seed: int) -> DataFrame:
    """(source, weight, quota, epochs, cut) from staged (doc_id, source, n_tokens); one row for each source with tokens.

    Every row of the source is taken ``epochs`` times, and once more if its permutation
    value is at most ``cut``.
    """
    sources = stage(weighed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    t = _exponent(sources, total, budget, target_entropy, max_repetition) if total else 1.0
    raised = sources.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(t)))
    z = raised.agg(F.sum("raised")).first()[0] or 1.0
    quotas = raised.withColumn("weight", F.col("raised") / z).withColumn("quota", F.col("weight") * budget)
    # a millionth of an epoch is rounding: it neither starts an epoch nor takes a document more
    near = F.floor(F.col("quota") / F.col("tokens") + 1e-6)
    quotas = quotas.withColumn("epochs", near).withColumn("rest", F.greatest(F.col("quota") - near * F.col("tokens") - 1e-6 * F.col("tokens"), F.lit(0.0)))
    quotas = stage(quotas.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS)).select("source", "weight", "quota", "epochs", "rest", "blocks"), "quotas")

    placed = weighed.join(quotas.filter("rest > 0").select("source", "epochs", "rest", "blocks"), "source").withColumn("u", permutation_value(seed, F.col("epochs"), F.col("doc_id")))
    placed = placed.withColumn("block", (F.col("u") / F.lit(_SPAN) * F.col("blocks")).cast("long"))
    sums = stage(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest")).withColumn("span", F.floor(F.col("block") / BLOCK_DOCS)), "blocks")
    # the end of the prefix: its span of blocks, its block, its document, each sought in the one before, so that no window holds more than some thousands of rows
    spans = sums.groupBy("source", "span").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.lit(0).cast("long").alias("before"))
    ends = stage(_last_below(spans, "span"), "spans")
    ends = stage(_last_below(sums.join(ends, ["source", "span"]), "block"), "ends")
    inside = placed.join(ends, ["source", "block"]).groupBy("source", "u").agg(F.sum("n_tokens").alias("tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    cuts = _last_below(inside, "u").select("source", F.col("u").alias("cut"))
    return stage(quotas.join(cuts, "source", "left").select("source", "weight", "quota", "epochs", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan")


def _last_below(rows: DataFrame, key: str) -> DataFrame:
    """(source, key, before): of each source the last row, by ``key``, whose prefix (``before`` and the tokens of the rows before it) is below ``rest``, and that prefix."""
    upto = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = rows.withColumn("upto", F.col("before") + upto).filter("upto < rest")
    return below.groupBy("source").agg(F.max_by(F.struct(F.col(key), F.col("upto").alias("before")), F.col(key)).alias("x")).select("source", "x.*")


def permutation_value(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A pseudo-random integer below 2**52 from the epoch and the document."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def _source(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = 0.95, max_repetition: float | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with a column ``copies``: how often the mixture holds each row.

    Needs doc_id, text and source; all columns are kept (an input column ``copies`` is
    replaced). Give one of ``target_entropy`` (share of the greatest entropy, log of the
    number of sources) and ``max_repetition`` (tokens of the mixture per token of a source; a
    budget that no weights could keep within it is a ValueError).
    ``budget``: tokens of the mixture, by default those of the input. With a mixture already
    past the target the exponent is 1, and every copy count is 1. A source misses its quota by
    less than one document, or by less than the rows that share an id (null ones count as one) do together. Null source: the source ''. Rows without words (null or empty
    text) take no budget: they keep one copy. Rows that share an id share their fate.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source(F.col("source")).alias("source"), count_tokens(F.col("text").cast("string")).alias("n_tokens")).filter("n_tokens > 0")
    plan = plan_mixture(stage(weighed, "weighed"), budget, target_entropy, max_repetition, seed)
    plan = plan.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut"))
    once = (permutation_value(seed, F.col("__epochs"), F.col("doc_id")) <= F.col("__cut")).cast("long")
    copies = F.when(count_tokens(F.col("text").cast("string")) == 0, F.lit(1).cast("long")).otherwise(F.col("__epochs") + once)
    joined = docs.drop("copies").join(plan, _source(F.col("source")) == F.col("__source"), "left")
    return joined.withColumn("copies", copies).drop("__source", "__epochs", "__cut")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say, without that column."""
    columns = [c for c in mixed.columns if c != "copies"]
    return mixed.filter("copies > 0").withColumn("__k", F.explode(F.expr("sequence(1, copies)"))).select(*columns)
