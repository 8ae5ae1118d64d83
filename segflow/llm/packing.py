"""Best-fit packing of tokenised documents into sequences with several capacities.

Documents longer than a sequence are cut into full pieces, of which the first may be
shorter. Pieces are dealt into lots of bounded size by a hash; each lot is packed by
best-fit decreasing: of the open bins that hold the piece within every capacity (tokens,
documents, attention cost), the one that scores best is taken. Full pieces fill a bin alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.staging import stage
from segflow.llm.tokens import encoder
from segflow.llm.wordhash import binaries, lean, text_batches

LENGTH, END_ID = 1024, 2
#: Pieces packed together in one task.
LOT = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cut(tokenizer: str | None, length: int, end_id: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or default_tokenizer())
        for batch in batches:
            docs = batch.column(0)
            for lo, hi, buf, offsets in text_batches(batch.column(1)):
                ids, first = encode(buf, offsets)
                # the end id goes behind each text
                closed = np.full(len(ids) + hi - lo, end_id, "<u4")
                closed[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), np.diff(first))] = ids
                n = np.diff(first) + 1
                pieces = -(-n // length)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = (n - 1) % length + 1
                size = np.where(piece == 0, short[row], length)
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * length)
                cuts = np.append(np.cumsum(size) - size, len(closed))
                whole = memoryview(closed).cast("B")
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(size.astype(np.int64)),
                        pa.array(crc, pa.int64()),
                        binaries(closed, cuts) if with_ids else pa.nulls(len(row), pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def default_tokenizer() -> str:
    """The installed public byte-level BPE; resolved where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_into_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the pieces of each document's ids and ``end_id``.

    ``docs`` needs doc_id and text; others are ignored. ``tokenizer``: a file that the
    tokenizers library reads; its added tokens count as such where a text holds them. Null text
    is empty (one piece: the end id). ``ids`` are little-endian uint32 (null unless
    ``with_ids``). A null id stays null; rows that share an id are each cut.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lean(_cut(tokenizer, length, end_id, with_ids)), _PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken longest first (ties: as given).

    A piece of n tokens needs (n, 1, n * n) of (tokens, documents, attention cost). ``rule``
    'norm' takes the bin whose weighted residual after placing is least in L2 norm; 'dot'
    the one whose weighted dot product of need and residual is least, so that the tightest
    bin wins. Ties: the oldest bin.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    free = np.empty((n, 3))  # residuals of the open bins
    name = np.empty(n, np.int64)
    used = np.empty(n, np.int64)
    least = float(lengths.min()) if n else 0.0
    n_open = made = 0
    for i in order.tolist():
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        if (need > cap).any():
            raise ValueError(f"a piece of {size:.0f} tokens exceeds a capacity")
        at = -1
        if n_open:
            fits = np.flatnonzero((free[:n_open] >= need).all(1))
            if len(fits):
                rest = (free[fits] - need) / cap if rule == "norm" else (free[fits] / cap) * (need / cap)
                score = ((w * rest) ** 2).sum(1) if rule == "norm" else (w * rest).sum(1)
                best = fits[score == score.min()]
                at = int(best[np.argmin(name[best])])
        if at < 0:
            at, n_open = n_open, n_open + 1
            free[at], name[at], used[at] = cap, made, 0
            made += 1
        bins[i], offsets[i] = name[at], used[at]
        used[at] += int(size)
        free[at] -= need
        if free[at, 0] < least or free[at, 1] < 1 or free[at, 2] < least * least:  # nothing fits: close it
            n_open -= 1
            free[at], name[at], used[at] = free[n_open], name[n_open], used[n_open]
    return bins, offsets


def _pack_lot(capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
        lot = table.column("lot")[0].as_py()
        return table.drop_columns(["lot", "row"]).append_column("sequence_id", pa.array(lot * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(
    pieces: DataFrame,
    length: int = LENGTH,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    lot: int = LOT,
    with_ids: bool = False,
) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, with ``with_ids`` also ids) with sequence_id and offset.

    Capacities of a sequence: ``length`` tokens, ``max_docs`` pieces (default: length) and
    ``max_cost``, the sum of squared lengths (default: length squared). With these defaults
    only tokens bind, so sequences are as few as best fit can make them; the other two
    still steer the choice of the bin. Lots hold about ``lot`` pieces whatever the input's
    size, so what a lot leaves unfilled (its last bin or two) is a fixed share. Rows are dealt
    to lots one by one, so neither a repeated nor a null id gathers in one of them.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    p = stage(pieces.select(*names, F.monotonically_increasing_id().alias("row")), "pieces")
    n_lots = max(1, -(-p.count() // lot))
    dealt = p.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(n_lots)))
    capacity = (length, max_docs or length, max_cost or length * length)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return dealt.groupBy("lot").applyInArrow(_pack_lot(capacity, weights, rule), out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the sequences of ``packed`` (with ids), their pieces in order."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"), ids.alias("ids"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"))
