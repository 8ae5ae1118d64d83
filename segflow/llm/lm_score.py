"""Cross-entropy difference of documents under a target and a background n-gram model.

Both are interpolated bigram models over words (hashes of lower-cased words) with the same
order, smoothing and vocabulary, the words of either corpus, so that their per-token losses
can be subtracted. Every word and bigram of every text counts: the models grow with the
input. Where the scored documents are themselves the background, a document is scored by the
background without it (its own counts are taken off), so that it does not vouch for itself.

    p(w) = (n(w) + PSEUDO) / (N + PSEUDO * (V + 1))            one more for all unseen words
    p(w | v) = BIGRAM * n(v, w) / n(v, *) + (1 - BIGRAM) * p(w)   where v has successors, else p(w)

Each sums to 1 over the vocabulary and the unseen word, for every v.

No task holds a model. Texts are cut into batches; a batch sends its distinct words and
bigrams once, with their counts, packed by hash bucket. A bucket sums them over both corpora
and tells each batch the counts of what it sent, in the order sent; with them the batch
scores its documents. A bucket with a word or bigram that nearly every batch sends is summed
in parts first, whose sums are then added up and told part by part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import stage
from segflow.llm.wordhash import U, lean, mix, release, text_batches, words_of

#: Bytes of text whose n-grams are packed together, and whose n-grams share a bucket; they bound the memory of a task.
BATCH_BYTES, BUCKET_BYTES = 3 << 20, 4 << 20
#: Bytes of entries, each with ENTRY_BYTES beside its hashes, that a task sums at once; a bucket with more of them is hot.
HOT_BYTES, ENTRY_BYTES = 64 << 20, 64
#: Hot buckets (12 bytes each) up to which their list is broadcast.
BROADCAST_BUCKETS = 1_000_000
#: Share of the bigram estimate where the previous word has successors; pseudo-count of each vocabulary word.
BIGRAM, PSEUDO = 0.7, 0.5
#: What the texts of a batch are: part of a corpus, or only to be scored.
TARGET, BACKGROUND, ASKING = range(3)


def _bigrams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the word before it in its row, and whether there is one."""
    has = np.ones(len(words), bool)
    has[first[:-1][first[:-1] < first[1:]]] = False
    before = np.concatenate([np.zeros(1, U), words[:-1]])[: len(words)].astype(U)
    return mix(mix(before + U(1)) + words), has


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(origin, size, rows): the rows (doc_id, text) of each batch, packed."""
    origin = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, buf, _ in text_batches(batch.column(1), BATCH_BYTES):
            origin += 1
            rows = batch.slice(lo, hi - lo)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([len(buf)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["origin", "size", "rows"])


def _unpacked(rows: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, words and first words of a batch's rows."""
    table = pa.ipc.open_stream(rows).read_all().combine_chunks()
    text = table.column(1).combine_chunks()
    text = text if isinstance(text, pa.Array) else text.chunk(0)
    _, _, buf, offsets = next(text_batches(text, 1 << 62))
    return table.column(0), *words_of(buf, offsets, lower=True)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending in the hash."""
    return ((hashes >> U(32)) * U(n)) >> U(32)


def _planes(values: np.ndarray, rising: bool = False) -> bytes:
    """Values byte by byte, lowest bytes first, as differences if they rise: the upper planes are then zeros, which a shuffle's compression takes away."""
    if rising:
        values = np.diff(values, prepend=values[:1] * 0)
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _values(planes: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    out = np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(dtype).reshape(-1)
    return np.cumsum(out, dtype=dtype) if rising else out


def _pack(corpus: int, n_buckets: int) -> Callable:
    """(bucket, kind, corpus, origin, hashes, counts, ends): distinct words (kind 0) and bigrams (kind 1) of each batch, ascending.

    ``ends``: how many of a word's occurrences nothing follows. Both are 0 in texts that only ask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, words, first = _unpacked(rows.as_py())
                grams, has = _bigrams(words, first)
                last = np.zeros(len(words), bool)
                last[first[1:][first[:-1] < first[1:]] - 1] = True
                for kind, x in enumerate((words, grams[has])):
                    h, place, n = np.unique(x, return_inverse=True, return_counts=True)
                    ends = np.bincount(place[last], minlength=len(h)) if kind == 0 else np.zeros(0, np.int64)
                    if corpus == ASKING:
                        n, ends = np.zeros_like(n), np.zeros_like(ends)
                    bucket = _buckets(h, n_buckets)
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
                    k = len(cuts) - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(bucket[cuts[:-1]].astype(np.int64)),
                            pa.array(np.full(k, kind, np.int32)),
                            pa.array(np.full(k, corpus, np.int32)),
                            pa.array(np.full(k, origin, np.int64)),
                            pa.array([_planes(h[a:b], True) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                            pa.array([_planes(n[a:b].astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                            pa.array([_planes(ends[a:b].astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        ],
                        ["bucket", "kind", "corpus", "origin", "hashes", "counts", "ends"],
                    )

    return run


_SENT = "bucket long, kind int, corpus int, origin long, hashes binary, counts binary, ends binary"
#: Counts in either corpus and, of words, how many of them have a successor; a row without origin holds the bucket's words and tokens.
_SUMS = ["in_target", "in_background", "before_target", "before_background"]
_STATS = ["n_words", "target", "background"]
_TOLD = "origin long, kind int, bucket long, " + ", ".join([f"{x} binary" for x in _SUMS] + [f"{x} long" for x in _STATS])
_TOTALS = "bucket long, kind int, hashes binary, " + ", ".join([f"{x} binary" for x in _SUMS] + [f"{x} long" for x in _STATS])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _of(table: pa.Table, column: str, value: int) -> pa.Table:
    return table.filter(pa.compute.equal(table.column(column), value))


def _read(own: pa.Table, column: str, dtype: type, rising: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(_values(x, dtype, rising) for x in own.column(column).to_pylist())])


def _sizes(own: pa.Table) -> np.ndarray:
    return pa.compute.binary_length(own.column("hashes")).to_numpy() // 8


def _sum(hashes: np.ndarray, columns: Iterator[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes, ascending, and the sums of their values in each column."""
    values, place = np.unique(hashes, return_inverse=True)
    return values, [np.bincount(place, x, len(values)).astype(np.int64) for x in columns]


def _sum_sent(own: pa.Table, kind: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums (the first columns of _SUMS, two for bigrams) of the entries of one kind that batches sent."""
    side = np.repeat(own.column("corpus").to_numpy(), _sizes(own))
    n = _read(own, "counts", np.int32).astype(np.float64)

    def columns() -> Iterator[np.ndarray]:
        yield from (n * (side == of) for of in (TARGET, BACKGROUND))
        if kind == 0:
            before = n - _read(own, "ends", np.int32)
            yield from (before * (side == of) for of in (TARGET, BACKGROUND))

    return _sum(_read(own, "hashes", U, True), columns())


def _stats(words: list[np.ndarray]) -> list[int]:
    """Words that either corpus holds, and the tokens of each."""
    return [int(((words[0] > 0) | (words[1] > 0)).sum()), int(words[0].sum()), int(words[1].sum())]


def _tell(own: pa.Table, bucket: int, kind: int, values: np.ndarray, sums: list[np.ndarray]) -> pa.Table:
    """For each entry the counts of what it sent, in the order sent."""
    place = np.searchsorted(values, _read(own, "hashes", U, True))
    cuts = np.cumsum([0, *_sizes(own)])
    k = len(own)
    counts = [pa.array([_planes(x[place[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in sums] + [pa.array([b""] * k, pa.binary())] * (len(_SUMS) - len(sums))
    none = [pa.array(np.zeros(k, np.int64))] * len(_STATS)
    return pa.Table.from_arrays([own.column("origin").combine_chunks(), pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, bucket, np.int64)), *counts, *none], names=_names(_TOLD))


def _sum_bucket(asking: int) -> Callable:
    """Of one bucket: for each batch of ``asking`` the counts of what it sent."""

    def run(table: pa.Table) -> pa.Table:
        bucket, out, stats = table.column("bucket")[0].as_py(), [], [0, 0, 0]
        for kind in (0, 1):
            own = _of(table, "kind", kind)
            if not len(own):
                continue
            values, sums = _sum_sent(own, kind)
            if kind == 0:
                stats = _stats(sums)
            out.append(_tell(_of(own, "corpus", asking), bucket, kind, values, sums))
            del values, sums
            release()
        empty = [pa.array([b""], pa.binary())] * len(_SUMS)
        out.append(pa.Table.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([bucket]), *empty, *(pa.array([x]) for x in stats)], names=_names(_TOLD)))
        return pa.concat_tables(out)

    return run


def _total(sent: bool) -> Callable:
    """Sums of a hot bucket, one row for each kind: of a part of its entries (``sent``), or of the sums of its parts."""

    def run(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), []
        for kind in (0, 1):
            own = _of(table, "kind", kind)
            if not len(own):
                continue
            columns = _SUMS if kind == 0 else _SUMS[:2]
            values, sums = _sum_sent(own, kind) if sent else _sum(_read(own, "hashes", U, True), (_read(own, c, np.int64) for c in columns))
            packed = [_planes(x) for x in sums] + [b""] * (len(_SUMS) - len(sums))
            out.append((bucket, kind, _planes(values, True), *packed, *(_stats(sums) if kind == 0 else [0, 0, 0])))
        types = [pa.int64(), pa.int32()] + [pa.binary()] * (1 + len(_SUMS)) + [pa.int64()] * len(_STATS)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_names(_TOTALS))

    return run


def _tell_part(entries: pa.Table, totals: pa.Table) -> pa.Table:
    """What the entries of a part of a hot bucket are told."""
    out = []
    for kind in (0, 1):
        own, total = _of(entries, "kind", kind), _of(totals, "kind", kind)
        if len(own):
            sums = [_read(total, c, np.int64) for c in (_SUMS if kind == 0 else _SUMS[:2])]
            out.append(_tell(own, own.column("bucket")[0].as_py(), kind, _read(total, "hashes", U, True), sums))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.binary() if c in _SUMS else pa.int32() if c == "kind" else pa.int64()) for c in _names(_TOLD)})


def _hot_buckets(sent: DataFrame) -> DataFrame:
    """(bucket, n_parts) of the buckets whose entries are too many for one task; counts are summed in the tasks first."""
    size = F.sum(F.octet_length("hashes") + ENTRY_BYTES)
    return sent.groupBy("bucket").agg(size.alias("size")).filter(F.col("size") > HOT_BYTES).select("bucket", F.ceil(F.col("size") / HOT_BYTES).cast("int").alias("n_parts"))


def _parts(sent: DataFrame, hot: DataFrame) -> DataFrame:
    """The entries of hot buckets, dealt to parts by their batch."""
    return sent.join(hot, "bucket").withColumn("part", F.expr("cast(pmod(xxhash64(origin), n_parts) as int)")).drop("n_parts")


def _sum_all(sent: DataFrame, asking: int) -> tuple[DataFrame, DataFrame]:
    """What the batches of ``asking`` are told, and (n_words, target, background) to be summed.

    A bucket is summed in one task; a hot one, which holds what nearly every batch sends, in
    parts, then over its parts, and each part tells its own entries.
    """
    hot = stage(_hot_buckets(sent), "hot")
    n_hot = hot.count()
    if not n_hot:
        told = stage(sent.groupBy("bucket").applyInArrow(_sum_bucket(asking), _TOLD), "told")
        return told.filter("origin is not null").drop(*_STATS), told.filter("origin is null").select(*_STATS)
    near = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
    told = stage(sent.join(near, "bucket", "left_anti").groupBy("bucket").applyInArrow(_sum_bucket(asking), _TOLD), "told")
    sums = _parts(sent, near).groupBy("bucket", "part").applyInArrow(_total(True), _TOTALS)
    totals = stage(sums.groupBy("bucket").applyInArrow(_total(False), _TOTALS), "totals")
    copies = totals.join(hot, "bucket").withColumn("part", F.explode(F.expr("sequence(0, n_parts - 1)"))).drop("n_parts")
    asked = _parts(sent.filter(F.col("corpus") == asking), near)
    more = asked.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(_tell_part, _TOLD)
    stats = told.filter("origin is null").select(*_STATS).unionByName(totals.select(*_STATS))
    return told.filter("origin is not null").drop(*_STATS).unionByName(more.drop(*_STATS)), stats


def _own(rows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For each place, how often its row holds its item."""
    key = rows * (int(items.max(initial=0)) + 1) + items
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[place]


def _score_batch(n_words: int, tokens: tuple[int, int], itself: bool) -> Callable:
    """Scores of one batch's documents by the counts that the buckets told it; ``itself``: they are part of the background."""

    def run(batch: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("bucket")
        of = [told.filter(pa.compute.equal(told.column("kind"), kind)) for kind in (0, 1)]
        del told
        read = lambda kind, c: np.concatenate([np.zeros(0, np.int64), *(_values(x, np.int64) for x in of[kind].column(c).to_pylist())])
        out = []
        for packed in batch.column("rows").to_pylist():  # one
            ids, words, first = _unpacked(packed)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            grams, has = _bigrams(words, first)
            word = np.unique(words, return_inverse=True)[1]
            pair = np.unique(grams[has], return_inverse=True)[1]
            del words, grams
            before = word[np.flatnonzero(has) - 1]
            means = []
            for k, corpus in enumerate(("target", "background")):
                off = itself and k == BACKGROUND
                p = read(0, f"in_{corpus}")[word] + PSEUDO
                total = np.full(len(n), tokens[k], np.int64)
                if off:
                    p -= _own(row, word)
                    total -= n
                p /= (total + PSEUDO * (n_words + 1))[row]
                context, count = read(0, f"before_{corpus}")[before], read(1, f"in_{corpus}")[pair]
                if off:
                    context -= _own(row[has], before)
                    count -= _own(row[has], pair)
                share = np.where(context > 0, BIGRAM, 0.0)
                p[has] = share * count / np.maximum(context, 1) + (1 - share) * p[has]
                upto = np.concatenate([[0.0], np.cumsum(-np.log(p))])
                means.append(pa.array((upto[first[1:]] - upto[first[:-1]]) / np.maximum(n, 1), mask=n == 0))
                del p, context, count, share, upto
                release()
            out.append(pa.table({"doc_id": ids, "n_tokens": n.astype(np.int64), "target_loss": means[0], "background_loss": means[1], "difference": pa.compute.subtract(*means)}))
        return pa.concat_tables(out)

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference): mean losses per token in nats.

    ``difference`` is target minus background: the lower, the more like the target. ``docs``
    needs doc_id and text, ``target`` and ``background`` text; others are ignored. Without
    ``background`` each document is scored by all the other rows of ``docs``; a repeated row
    counts as another document. Null, empty or wordless text: 0 tokens and null losses. A null
    id stays null. An empty corpus leaves its model uniform over the vocabulary.
    """
    text = F.col("text").cast("string").alias("text")
    none = F.lit(0).cast("long").alias("doc_id")
    cut = lambda d, label: stage(d.mapInArrow(lean(_batched), "origin long, size long, rows binary"), label)
    asking = ASKING if background is not None else BACKGROUND
    parts = {asking: cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), "scored"), TARGET: cut(target.select(none, text), "target")}
    if background is not None:
        parts[BACKGROUND] = cut(background.select(none, text), "background")
    sent = size = None
    for d in parts.values():
        size = (size or 0) + (d.agg(F.sum("size")).first()[0] or 0)
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    for corpus, d in parts.items():
        own = d.select("origin", "rows").mapInArrow(lean(_pack(corpus, n_buckets)), _SENT)
        sent = own if sent is None else sent.unionByName(own)
    answers, counted = _sum_all(sent, asking)
    stats = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in _STATS)).first()
    run = _score_batch(stats[0], (stats[1], stats[2]), background is None)
    return parts[asking].select("origin", "rows").groupBy("origin").cogroup(answers.groupBy("origin")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
