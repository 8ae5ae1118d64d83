"""Hard negatives of anchor vectors, from zone-mapped blocks in the order of a Hilbert curve.

Candidates are sorted along a Hilbert curve (within buckets of their labels) and written as
Parquet rows of BLOCK vectors each. Zone maps hold the least and greatest value of every
dimension of a block, and of its labels; PAGE of them are a page. Interval arithmetic bounds
the inner product of an anchor with every vector of a block, and so chooses the blocks that it
reads: once for its positives (the fifth best of the anchor's own block is a bound to start
from), and once for the windows that these open. Scores are exact integers.

What is chosen is a table of numbers only: a block, a pack of anchors, and places in the pack.
Vectors and windows of a pack go once to each page that it reads from; there a task holds the
packs of a lot, streams the blocks of the page by them, and keeps the best of each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segflow.llm.staging import discard, stage
from segflow.llm.wordhash import lean

#: Vectors of a block, zone maps of a page, anchors of a pack.
BLOCK, PAGE, PACK = 128, 64, 256
#: Pages that a task holds to choose from, and anchors of the packs that it holds to score, about; tasks at most.
SHELF, LOT, TASKS = 8, 8192, 10_000
#: Label buckets; bits of each dimension on the curve; vectors that the curve's grid is fitted on, about (it only sets the order).
BUCKETS, BITS, SAMPLE = 64, 4, 8192
#: Sum of squared components up to which a vector takes part: beyond it scores times 100 may not fit in a long.
MOST = 1 << 56
_NONE, _ANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_ITEMS = "array<struct<id: long, label: long, q: binary, tau: long, wins: array<struct<positive_id: long, lo: long, hi: long>>>>"
_PAGES = "array<struct<block: long, low: binary, high: binary, label_low: long, label_high: long>>"
_BLOCKS = f"block long, page_no long, dim int, ids binary, labels binary, data binary, page {_PAGES}, pack {_ITEMS}"
_READS = "page_no long, block long, home long, asked array<short>"
_WIN = pa.list_(pa.struct([("positive_id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
_PACK = pa.struct([("id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("tau", pa.int64()), ("wins", _WIN)])
_PAGE = pa.struct([("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("label_low", pa.int64()), ("label_high", pa.int64())])


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of ``cells`` [n, dim] (whole numbers under 2**bits) on a Hilbert curve, as bytes that sort alike."""
    x = cells.astype(np.uint32).T.copy()
    dim = len(x)
    if not dim:
        return [b""] * cells.shape[0]
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections of the cells above
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dim):
            turned = (x[i] & bit) > 0
            swap = np.where(turned, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dim):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dim - 1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([((x >> np.uint32(level)) & np.uint32(1)).astype(np.uint8) for level in range(bits - 1, -1, -1)])  # [bits, dim, n]
    packed = np.packbits(planes.reshape(bits * dim, -1), axis=0).T
    return [r.tobytes() for r in np.ascontiguousarray(packed)]


def _matrix(parts: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int32).reshape(len(parts), dim)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows, exact: in doubles where no sum can leave their whole numbers, else in 64 bits."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if (x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0) < float(1 << 104):
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector between ``low`` and ``high``: [anchors, blocks], widened by what doubles round."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = low.astype(np.float64), high.astype(np.float64)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1 + 1e-9 * (np.abs(up) @ np.maximum(np.abs(low), np.abs(high)).T + np.abs(down) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def _keyed(grids: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                q = part.column(2).flatten().to_numpy().astype(np.int32).reshape(len(part), dim)
                grid = grids.get(dim, np.zeros((1, dim)))
                cells = np.stack([np.searchsorted(grid[:, i], q[:, i], "right") for i in range(dim)], 1) if dim else np.zeros((len(part), 0), int)
                key = pa.array(hilbert_keys(cells, BITS), pa.binary())
                data = pa.array([r.tobytes() for r in q] if dim else [b""] * len(part), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(3), key, part.column(0), part.column(1), data], ["bucket", "dim", "key", "vec_id", "label", "q"])

    return run


def _form(every: int, n_positives: int) -> Callable:
    """Sorted rows to blocks; pages of zone maps and packs of anchors go with the block that fills them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, page_no, base = 0, 0, TaskContext.get().partitionId() << 33
        page: list[dict] = []
        pack: list[dict] = []

        def block_of(rows: list[tuple], dim: int, last: bool) -> pa.RecordBatch:
            nonlocal number, page_no, page, pack
            rows.sort(key=lambda r: r[0])
            ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            q = _matrix([r[2] for r in rows], dim)
            at, number = base | number, number + 1
            page.append({"block": at, "low": q.min(0).tobytes(), "high": q.max(0).tobytes(), "label_low": int(labels.min()), "label_high": int(labels.max())})
            anchors = np.flatnonzero(ids % every == 0)
            if len(anchors):
                scores = exact_scores(q[anchors], q)
                for i, s in zip(anchors.tolist(), scores):
                    own = np.sort(s[(labels == labels[i]) & (ids != ids[i])])
                    tau = int(own[-n_positives]) if len(own) >= n_positives else _NONE
                    pack.append({"id": int(ids[i]), "label": int(labels[i]), "q": q[i].tobytes(), "tau": tau, "wins": []})
            full_page, full_pack = (page if last or len(page) >= PAGE else None), (pack if pack and (last or len(pack) >= PACK) else None)
            values = [at, base | page_no, dim, ids.tobytes(), labels.tobytes(), q.tobytes()]
            page, pack, page_no = ([] if full_page else page), ([] if full_pack else pack), page_no + bool(full_page)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds)]
            columns += [pa.array([full_page], pa.list_(_PAGE)), pa.array([full_pack], pa.list_(_PACK))]
            return pa.RecordBatch.from_arrays(columns, ["block", "page_no", "dim", "ids", "labels", "data", "page", "pack"])

        rows: list[tuple] = []
        place = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for bucket, dim, _, vec_id, label, q in zip(*columns):
                if rows and (place != (bucket, dim) or len(rows) == BLOCK):
                    yield block_of(rows, place[1], place[1] != dim)
                    rows = []
                place = (bucket, dim)
                rows.append((vec_id, label, q))
        if rows:
            yield block_of(rows, place[1], True)

    return run


def _choose(windows: bool) -> Callable:
    """Pages, then packs of each place (dim, salt): to the blocks that anchors of a pack must read, and the anchors' places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for k in range(len(batch)):
                dim, salt, page_no, home = (batch.column(i)[k].as_py() for i in (0, 1, 2, 4))
                if place != (dim, salt):
                    place, held = (dim, salt), []
                if page_no is not None:
                    page = batch.column(3)[k].values
                    numbers = [page.field(x).to_numpy(zero_copy_only=False).copy() for x in ("block", "label_low", "label_high")]
                    held.append([np.full(len(page), page_no), *numbers, *(_matrix(page.field(x).to_pylist(), dim) for x in ("low", "high"))])
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [[np.concatenate(x) for x in zip(*held)]]
                page_nos, blocks, low, high, zone_low, zone_high = held[0]
                pack = batch.column(5)[k].values
                a = _matrix(pack.field("q").to_pylist(), dim)
                least, most = score_bounds(a, zone_low, zone_high)
                label = pack.field("label").to_numpy(zero_copy_only=False)[:, None]
                if windows:
                    wins = pack.field("wins")
                    whose = np.repeat(np.arange(len(a)), wins.value_lengths().to_numpy(zero_copy_only=False))
                    flat = wins.flatten()
                    lo, hi = (flat.field(x).to_numpy(zero_copy_only=False)[:, None] for x in ("lo", "hi"))
                    met = (most[whose] >= lo) & (least[whose] <= hi)
                    read = np.zeros(least.shape, bool)
                    first = np.flatnonzero(np.diff(whose, prepend=-1))
                    read[whose[first]] = np.logical_or.reduceat(met, first, axis=0)
                    read &= ~((low == label) & (high == label))
                else:
                    tau = pack.field("tau").to_numpy(zero_copy_only=False)[:, None]
                    read = (most >= tau) & (low <= label) & (label <= high)
                block, who = np.nonzero(read.T)
                if not len(block):
                    continue
                at, first = np.unique(block, return_index=True)
                asked = pa.ListArray.from_arrays(pa.array(np.append(first, len(block)).astype(np.int32)), pa.array(who.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(page_nos[at]), pa.array(blocks[at]), pa.array(np.full(len(at), home)), asked], ["page_no", "block", "home", "asked"])

    return run


class _Best:
    """The windows of a pack's anchors, and the ``most`` best of each among the blocks met so far; ties: the smaller id."""

    def __init__(self, pack: pa.StructArray, dim: int, windows: bool, most: int) -> None:
        self.q, self.windows, self.most = _matrix(pack.field("q").to_pylist(), dim), windows, most
        self.id, self.label, tau = (pack.field(x).to_numpy(zero_copy_only=False).copy() for x in ("id", "label", "tau"))
        if windows:
            self.n = pack.field("wins").value_lengths().to_numpy(zero_copy_only=False)
            flat = pack.field("wins").flatten()
            self.positive, self.lo, self.hi = (flat.field(x).to_numpy(zero_copy_only=False).copy() for x in ("positive_id", "lo", "hi"))
        else:
            self.n, self.positive, self.lo, self.hi = np.ones(len(tau), int), np.zeros(len(tau), np.int64), tau, np.full(len(tau), _ANY)
        self.start = np.cumsum(self.n) - self.n
        self.least, self.greatest = np.minimum.reduceat(self.lo, self.start), np.maximum.reduceat(self.hi, self.start)
        self.found, self.waiting = [np.zeros((3, 0), np.int64)], 0

    def meet(self, asked: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        scores = exact_scores(self.q[asked], rows)
        fits = (scores >= self.least[asked, None]) & (scores <= self.greatest[asked, None])
        alike = self.label[asked, None] == labels[None, :]
        fits &= ~alike if self.windows else alike & (self.id[asked, None] != ids[None, :])
        i, j = np.nonzero(fits)
        score, anchor = scores[i, j], asked[i]
        n = self.n[anchor]
        each = np.repeat(np.arange(len(i)), n)
        win = np.arange(len(each)) + np.repeat(self.start[anchor] - (np.cumsum(n) - n), n)
        keep = (score[each] >= self.lo[win]) & (score[each] <= self.hi[win])
        each, win = each[keep], win[keep]
        self.found.append(np.stack([win, score[each], ids[j[each]]]))
        self.waiting += len(win)
        if self.waiting > 4 * self.most * len(self.lo):
            self.cut()

    def cut(self) -> None:
        """Leave the best of each window; whoever comes later must score as much as the last of a full one."""
        win, score, ids = np.concatenate(self.found, 1)
        order = np.lexsort((ids, -score, win))
        win, score, ids = win[order], score[order], ids[order]
        rank = np.arange(len(win)) - np.searchsorted(win, win)
        last = rank == self.most - 1
        self.lo[win[last]] = score[last]
        self.least = np.minimum.reduceat(self.lo, self.start)
        self.found, self.waiting = [np.stack([win, score, ids])[:, rank < self.most]], 0


def _score(windows: bool, most: int) -> Callable:
    """Packs, then blocks of each place (page, lot): to the best rows of each anchor, or of each of its windows, on that page."""

    def told(packs: dict[int, _Best]) -> Iterator[pa.RecordBatch]:
        for x in packs.values():
            x.cut()
            win, score, ids = x.found[0]
            anchor = np.repeat(x.id, x.n)[win]
            positive_score = x.hi[win] if windows else np.zeros(len(win), np.int64)
            if len(win):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (anchor, x.positive[win], positive_score, ids, score)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, packs = None, {}
        for batch in batches:
            for k in range(len(batch)):
                page_no, lot, dim, home = (batch.column(i)[k].as_py() for i in range(4))
                if place != (page_no, lot):
                    yield from told(packs)
                    place, packs = (page_no, lot), {}
                if home is not None:
                    packs[home] = _Best(batch.column(4)[k].values, dim, windows, most)
                    continue
                ids, labels = (np.frombuffer(batch.column(i)[k].as_py(), np.int64) for i in (5, 6))
                rows = np.frombuffer(batch.column(7)[k].as_py(), np.int32).reshape(len(ids), dim)
                asks = batch.column(8)[k].values
                for home, asked in zip(asks.field("home").to_pylist(), asks.field("asked")):
                    packs[home].meet(asked.values.to_numpy(zero_copy_only=False), ids, labels, rows)
        yield from told(packs)

    return run


def _read(blocks: DataFrame, packs: DataFrame, n_pages: int, n_anchors: int, windows: bool, most: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score, rank): the best rows of the blocks that the bounds choose."""
    # every pack meets every page of its dimension: pages are dealt to salts, packs stream by the pages of each
    salts = max(1, -(-n_pages // SHELF))
    pages = blocks.filter("page is not null").select("dim", F.pmod(F.xxhash64("page_no"), F.lit(salts)).alias("salt"), F.lit(0).alias("kind"), "page_no", "page")
    sent = packs.select("dim", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"), F.lit(1).alias("kind"), "home", "pack")
    tiles = pages.unionByName(sent, allowMissingColumns=True).repartition(min(salts, TASKS), "dim", "salt").sortWithinPartitions("dim", "salt", "kind")
    reads = stage(tiles.select("dim", "salt", "page_no", "page", "home", "pack").mapInArrow(lean(_choose(windows)), _READS), "reads")

    # a page meets the packs of a lot in one task: packs first, then blocks. Small files may be large tables here, so nothing is broadcast
    lots = max(1, -(-n_anchors // LOT))
    asked = reads.withColumn("lot", F.pmod(F.xxhash64("home"), F.lit(lots)))
    sent = packs.join(asked.groupBy("home", "lot").agg(F.collect_set("page_no").alias("to")).hint("merge"), "home")
    sent = sent.repartition(max(1, min(-(-n_anchors // PACK), TASKS)), "home")  # few rows so far, many from here on
    sent = sent.select(F.explode("to").alias("page_no"), "lot", F.lit(-1).cast("long").alias("block"), "dim", "home", "pack")
    asks = asked.groupBy("page_no", "lot", "block").agg(F.collect_list(F.struct("home", "asked")).alias("asks"))  # LOT anchors, about
    met = asks.join(blocks.select("block", "dim", "ids", "labels", "data").hint("merge"), "block").unionByName(sent, allowMissingColumns=True)
    tiles = met.repartition(max(1, min(n_pages * lots, TASKS)), "page_no", "lot").sortWithinPartitions("page_no", "lot", "block")
    tiles = tiles.select("page_no", "lot", "dim", "home", "pack", "ids", "labels", "data", "asks")
    found = tiles.mapInArrow(lean(_score(windows, most)), "anchor_id long, positive_id long, positive_score long, id long, score long")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    best = stage(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most), "best")
    discard(reads)
    return best


def hard_negatives(vectors: DataFrame, anchors_every: int = 100, n_positives: int = 5, n_negatives: int = 5, shift_every: int = 7, n_labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, embedding, label; others are ignored).

    Components become ``floor(256 * x)``; where vec_id is divisible by ``shift_every`` the label
    becomes ``(label + 1) % n_labels``. Anchors are the rows whose vec_id is divisible by
    ``anchors_every``; their positives are the ``n_positives`` best others of their label, and for
    each positive the ``n_negatives`` best rows of other labels that score from 80 to 100 % of it
    follow. Best: greatest inner product, ties by smaller vec_id.

    Rows with a null id, label or vector, or with a null or non-finite component take no part,
    nor do those whose squared components sum to over MOST. Rows that share a vec_id count as
    one: the least by label and components. Vectors of different dimensions have no score with
    each other; those without components score 0. Empty input: empty result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long").alias("label"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(1 << 20)))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(fits, F.lit(False)))
    q = F.transform("e", lambda c: F.floor(c * 256).cast("int"))
    v = v.select("vec_id", F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label")).alias("label"), q.alias("q"))
    v = v.filter(F.aggregate("q", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c) <= float(MOST))
    one = v.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
    one = stage(one.select("vec_id", "label", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket")), "vectors")
    n = one.count()
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    sample = one.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("dim", "q").toPandas()
    cuts = np.arange(1, 1 << BITS) / (1 << BITS)
    grids = {int(dim): np.quantile(np.array(x["q"].tolist(), float).reshape(len(x), dim), cuts, axis=0) for dim, x in sample.groupby("dim") if dim}

    keyed = stage(one.mapInArrow(lean(_keyed(grids)), "bucket int, dim int, key binary, vec_id long, label long, q binary"), "keyed")
    discard(one)
    order = ["bucket", "dim", "key", "vec_id"]  # the id splits equal vectors among tasks
    blocks = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_form(anchors_every, n_positives)), _BLOCKS), "blocks")
    discard(keyed)
    packs = blocks.filter("pack is not null").select("dim", "pack", F.col("block").alias("home"))
    n_pages, n_anchors = blocks.agg(F.count("page"), F.coalesce(F.sum(F.when(F.col("pack").isNotNull(), F.size("pack"))), F.lit(0))).first()

    positives = _read(blocks, packs, n_pages, n_anchors, False, n_positives)
    # 80 * positive <= 100 * negative: the least whole number that keeps it
    window = F.struct(F.col("id").alias("positive_id"), F.expr("(4 * score + 4) div 5").alias("lo"), F.col("score").alias("hi"))
    wins = positives.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("wins"))  # n_positives at most
    anchors = packs.select("dim", "home", F.explode("pack").alias("x")).select("dim", "home", "x.id", "x.label", "x.q", "x.tau")
    again = anchors.join(wins, F.col("id") == F.col("anchor_id")).groupBy("dim", "home").agg(F.collect_list(F.struct("id", "label", "q", "tau", "wins")).alias("pack"))
    again = stage(again, "packs")
    found = _read(blocks, again, n_pages, n_anchors, True, n_negatives)
    discard(positives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
