"""Removal of word passages that already occur in an earlier document.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. A task sends each
distinct hash of a batch once, for the smallest document that holds it there (its other
holders in the batch are known to repeat it), packed by hash bucket. A bucket finds the
smallest document of each hash in the whole corpus; the windows of the others are
repeated, and are told to the batch that sent them, packed again. Overlapping repeated
windows merge into maximal removal intervals. Intervals found within a batch are word places
of one text, so they carry that text's fingerprint: another text under the same id ignores them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import stage
from segflow.llm.wordhash import U, binaries, lean, release, text_batches, windows_of, words_of

#: Bytes of text whose windows share a bucket; it bounds the memory of a reducing task.
BUCKET_BYTES = 6 << 20
#: Bytes of text whose windows a task packs together.
BATCH_BYTES = 3 << 20
_PACKED = "bucket long, origin long, docs binary, counts binary, hashes binary, spans binary"
_TOLD = "origin long, docs binary, counts binary, hashes binary, spans binary"
_FOUND = "seg_id long, hashes binary, spans binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("origin", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("spans", pa.binary())])


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(n)) >> U(32)


def _document_windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in the row of every window that lies in one row."""
    hashes = windows_of(words, width)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[first[:-1][rows] + places], rows, places


def _runs(places: np.ndarray, width: int) -> np.ndarray:
    """[start, end) word intervals that the windows at the given ascending places cover, merged."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(places) > width)
    starts = places[np.concatenate([[0], breaks + 1])]
    ends = places[np.concatenate([breaks, [len(places) - 1]])] + width
    return np.stack([starts, ends], 1)


def _pack(width: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            for lo, hi, buf, offsets in text_batches(batch.column(1), BATCH_BYTES):
                origin += 1
                hashes, rows, places = _document_windows(*words_of(buf, offsets), width)
                if not len(hashes):
                    continue
                docs = ids[lo:hi]
                rank = np.unique(docs, return_inverse=True)[1]  # rows of one document share a rank
                order = np.argsort(hashes)
                new = np.empty(len(order), bool)
                new[0], new[1:] = True, hashes[order][1:] != hashes[order][:-1]
                group, at = np.cumsum(new) - 1, np.flatnonzero(new)
                least = np.minimum.reduceat(rank[rows[order]], at)
                late = np.empty(len(order), bool)
                late[order] = rank[rows[order]] > least[group]
                # one entry for each distinct hash, ordered by bucket and then by document
                sent = hashes[order][at]
                bucket = _buckets(sent, n_buckets)
                by = np.lexsort((least, bucket))
                sent, bucket, owner = sent[by], bucket[by], least[by]
                run_at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
                run_len = np.diff(np.concatenate([run_at, [len(sent)]]))
                cut = np.flatnonzero(np.concatenate([[True], bucket[run_at][1:] != bucket[run_at][:-1]]))
                ends = np.concatenate([cut, [len(run_at)]])
                distinct = np.unique(docs)
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[run_at][cut].astype(np.int64)),
                        pa.array(np.full(n, origin)),
                        binaries(distinct[owner[run_at]], ends),
                        binaries(run_len.astype(np.int32), ends),
                        binaries(sent, np.concatenate([run_at, [len(sent)]])[ends]),
                        pa.array([b""] * n, pa.binary()),
                    ],
                    schema=_ARROW,
                )
                known = np.flatnonzero(late)
                if len(known):
                    out: list[tuple] = []
                    for part in np.split(known, np.flatnonzero(np.diff(rows[known])) + 1):
                        row = rows[part[0]]
                        spans = np.append(marks[lo + row], _runs(places[part], width))
                        out.append((origin % n_buckets, origin, docs[row].tobytes(), b"", b"", spans.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    return run


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the (equally long) columns changes, with 0 and the end."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


def _reduce(table: pa.Table) -> pa.Table:
    """Of one bucket: for each origin, its documents' hashes that a smaller document holds, too."""
    whole = table.filter(pa.compute.greater(pa.compute.binary_length(table.column("counts")), 0))
    passed = table.filter(pa.compute.equal(pa.compute.binary_length(table.column("counts")), 0)).drop_columns(["bucket"])
    names, ids, sizes, hashes = whole.column("origin").to_numpy(), [], [], []
    for docs, counts, part in zip(*(whole.column(c).to_pylist() for c in ("docs", "counts", "hashes"))):
        ids.append(np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.int32)))
        hashes.append(np.frombuffer(part, U))
        sizes.append(len(ids[-1]))
    if not ids:
        return passed
    doc, h = np.concatenate(ids), np.concatenate(hashes)
    del ids, hashes
    order = np.argsort(h)
    at = _cuts(h[order])[:-1]
    least = np.minimum.reduceat(doc[order], at)
    late = np.empty(len(h), bool)
    late[order] = doc[order] > np.repeat(least, np.diff(np.append(at, len(h))))
    origin = np.repeat(names, sizes)[late]
    doc, h = doc[late], h[late]
    runs = _cuts(origin, doc)
    if not len(doc):
        return passed
    ends = np.append(_cuts(origin[runs[:-1]])[:-1], len(runs) - 1)  # runs of one origin
    told = pa.table(
        {
            "origin": origin[runs[ends[:-1]]],
            "docs": binaries(doc[runs[:-1]], ends),
            "counts": binaries(np.diff(runs).astype(np.int32), ends),
            "hashes": binaries(h, runs[ends]),
            "spans": pa.array([b""] * (len(ends) - 1), pa.binary()),
        }
    )
    del order, late, origin, doc, h
    release()
    return pa.concat_tables([passed, told])


def _by_document(table: pa.Table) -> pa.Table:
    """Of one origin: all that is repeated in each of its documents."""
    ids, hashes, spans, own = [], [], [], []
    for docs, counts, part, span in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "hashes", "spans"))):
        d = np.frombuffer(docs, np.int64)
        if span:
            own.append(int(d[0]))
            spans.append(span)
        if part:
            ids.append(np.repeat(d, np.frombuffer(counts, np.int32) if counts else len(part) // 8))
            hashes.append(np.frombuffer(part, U))
    out = [pa.table({"seg_id": pa.array(own, pa.int64()), "hashes": pa.array([b""] * len(own), pa.binary()), "spans": pa.array(spans, pa.binary())})]
    if ids:
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        cuts = _cuts(doc)
        out.append(pa.table({"seg_id": doc[cuts[:-1]], "hashes": binaries(h, cuts), "spans": pa.array([b""] * (len(cuts) - 1), pa.binary())}))
    return pa.concat_tables(out)


def _removed(words: list[bytes], text: bytes, mark: int, hashes: list[bytes | None], spans: list[bytes | None], width: int) -> np.ndarray:
    """[start, end) intervals of words to remove; ``spans`` of texts with another fingerprint than ``mark`` do not count."""
    cover = np.zeros(len(words) + 1, np.int32)
    told = [np.frombuffer(x, np.int64) for x in spans if x]
    pairs = [x[1:].reshape(-1, 2) for x in told if x[0] == mark]
    found = [np.frombuffer(x, U) for x in hashes if x]
    if found:
        buf = np.frombuffer(text, np.uint8)
        own, _ = words_of(buf, np.array([0, len(buf)]))
        pairs.append(_runs(np.flatnonzero(np.isin(windows_of(own, width), np.concatenate(found))), width))
    for pair in pairs:
        np.add.at(cover, pair[:, 0], 1)
        np.add.at(cover, pair[:, 1], -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def _rewrite(width: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, marks, hashes, spans = (batch.column(i) for i in range(5))
            for i in range(len(batch)):
                text = (texts[i].as_py() or "").encode()
                words = text.split()
                cut = _removed(words, text, marks[i].as_py(), hashes[i].as_py(), spans[i].as_py(), width) if hashes[i].is_valid else np.zeros((0, 2), int)
                kept = words
                if len(cut):
                    keep = np.ones(len(words), bool)
                    for a, b in cut.tolist():
                        keep[a:b] = False
                    kept = list(itertools.compress(words, keep.tolist()))
                joined = b" ".join(kept)
                rows.append((ids[i].as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), cut.tolist(), joined.decode() if with_text else None))
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def remove_repeated_passages(docs: DataFrame, width: int = 50, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES, stored: bool = False) -> DataFrame:
    """Drop every word inside a window of ``width`` words that also starts in a document with a smaller id.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored, whatever their
    names. Returns per row doc_id, n_words, n_removed, kept_sha256, removed (maximal [start,
    end) word intervals) and kept_text (kept words joined by one space; null unless
    ``with_text``). Windows are judged on the input. Null or empty text has no words. A row
    with a null id is returned whole and is compared with nothing. Rows that share an id
    count as one document, wherever they lie: they never remove each other. Texts under
    ``width`` words have no window. Empty input gives an empty result. What a batch leaves out
    because another row of it tells it must be the same when a lost task runs again, so the
    input is staged first, unless it is ``stored`` already (a plain scan of files).
    """
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    d = d if stored else stage(d, "texts")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-size // bucket_bytes))
    packed = d.filter("doc_id is not null and text is not null").mapInArrow(lean(_pack(width, n_buckets)), _PACKED)
    told = packed.groupBy("bucket").applyInArrow(_reduce, _TOLD)
    found = told.groupBy("origin").applyInArrow(_by_document, _FOUND)
    per_doc = found.groupBy("seg_id").agg(F.collect_list("hashes").alias("hashes"), F.collect_list("spans").alias("spans"))
    joined = d.join(per_doc, d.doc_id == per_doc.seg_id, "left").select("doc_id", "text", "mark", "hashes", "spans")
    return joined.mapInArrow(lean(_rewrite(width, with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>, kept_text string")
