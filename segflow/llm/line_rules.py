"""Document quality rules with cross-document line frequency, with DataFrame functions only.

Lines are normalised (lower case, white space collapsed) and hashed; the distinct documents
of each host (``source``) that hold a line are counted over the whole corpus. Lines above
the host's limit are boilerplate and are removed; a document that they leave depleted is
rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import stage

SPACE = " \t\n\x0b\f\r"
#: A line is above the limit in more documents of a host than MAX_DOCS and than MAX_SHARE of them, or than MOST_DOCS, which bounds the share on large hosts.
MAX_DOCS, MAX_SHARE, MOST_DOCS = 20, 0.02, 1000
#: A document is depleted with fewer words left than this many, or than this share (percent) of its own.
MIN_WORDS, MIN_LEFT = 10, 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, n: int = 5) -> Column:
    """How many words lie in n-word windows that occur twice or more in the array.

    Sorted hashes of the windows tell first whether any occurs twice; only then are places sought.
    """
    none = F.array().cast("array<bigint>")
    hashes = lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))).otherwise(none)
    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(s, i + 1)["g"], F.lit(False)))
    placed = lambda g: F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + n).alias("end"), (a["n"] + p + n - F.greatest(p, a["end"])).alias("n"))
    covered = lambda g: F.aggregate(F.sort_array(F.transform(let(placed(g), twice), lambda x: x["p"])), start, step)["n"]
    repeats = lambda g: let(F.sort_array(g), lambda s: F.exists(F.transform(s, lambda x, i: x == F.get(s, i + 1)), lambda x: x))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), hashes), lambda g: F.when(F.coalesce(repeats(g), F.lit(False)), covered(g)).otherwise(F.lit(0).cast("long")))


def base_columns(text: Column) -> dict[str, Column]:
    words = words_of(text)
    kept_lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "both": both,
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(kept_lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def line_items(text: Column) -> Column:
    """array<struct<h, n, first>>: hash and words of each line with a word, ordered by hash; ``first`` marks one of each hash."""
    lines = F.split(F.lower(text), "\n")
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))), lambda x: x != "")
    items = F.sort_array(F.transform(clean, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).cast("long").alias("n"))))
    return let(items, lambda s: F.transform(s, lambda x, i: F.struct(x["h"].alias("h"), x["n"].alias("n"), (~F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))).alias("first"))))


def _lines_above(rows: DataFrame, lines: DataFrame, max_docs: int, max_share: float, most_docs: int) -> DataFrame:
    """(host, h) of the lines above their host's limit; lines: (row, doc_id, host, h), once for each row."""
    often = stage(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")), "often")

    def documents(d: DataFrame, *key: str) -> DataFrame:
        """Distinct documents of each key: only ids of several rows need a look at the id."""
        once = d.join(often, d.doc_id == often.again, "left_anti").select(*key)
        more = d.join(often, d.doc_id == often.again, "left_semi").select(*key, "doc_id").distinct().select(*key)
        return once.unionByName(more).groupBy(*key).agg(F.count("*").alias("docs"))  # summed in the tasks first

    limits = documents(rows, "host").select("host", F.least(F.col("docs") * max_share, F.lit(float(most_docs))).alias("most"))
    counts = documents(lines, "host", "h").filter(F.col("docs") > max_docs)
    return stage(counts.join(limits, "host").filter(F.col("docs") > F.col("most")).select("host", "h"), "above")


def apply_line_rules(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    most_docs: int = MOST_DOCS,
    min_words: int = MIN_WORDS,
    min_left: int = MIN_LEFT,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, kept) for each row.

    ``docs`` needs doc_id, text and source; others are ignored. Null text has no words and
    fails the base rule. A null source is the host ''. Rows of one host that share an id count
    as one document, each row with a null id as one of its own; every row is returned. A line is
    above the limit in more than ``max_docs`` documents of its host and in more than the lesser
    of ``max_share`` of them and ``most_docs``. ``words_left`` are the words outside such lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    base = base_columns(F.col("text"))
    rows = stage(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", *(c.alias(k) for k, c in base.items()), line_items(F.col("text")).alias("items")), "lines")
    lines = rows.select("row", "doc_id", "host", F.explode("items").alias("x")).select("row", "doc_id", "host", "x.h", "x.n", "x.first")
    above = _lines_above(rows, lines.filter("first"), max_docs, max_share, most_docs)
    gone = lines.join(above, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("gone"))
    n_words, repeat = F.col("both")["n"], F.col("both")["r"]
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    left = n_words - F.coalesce("gone", F.lit(0))
    return rows.join(gone, "row", "left").select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        left.alias("words_left"),
        (~failed & (left >= min_words) & (100 * left >= min_left * n_words)).alias("kept"),
    )


def remove_frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(doc_id, text): the texts without the lines above their host's limit; other lines stay as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    rows = stage(d, "texts")
    clean = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09-\x0D]+", " "))
    lines = rows.select("row", "doc_id", "host", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("h", F.when(clean(F.col("line")) != "", F.xxhash64(clean(F.col("line")))))
    above = _lines_above(rows, lines.filter("h is not null").select("row", "doc_id", "host", "h").distinct(), max_docs, max_share, most_docs)
    kept = lines.join(above, ["host", "h"], "left_anti").groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("kept"))
    return rows.select("row", "doc_id").join(kept, "row", "left").select("doc_id", F.coalesce("kept", F.lit("")).alias("text"))
