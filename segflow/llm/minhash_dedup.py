"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every document becomes the set of hashes of its word shingles, a fingerprint of that set
   and a signature of minima. Documents with equal sets are one class.
2. Signatures of class representatives are cut into bands; representatives that share a
   band are candidates.
3. Candidates are compared signature batch after batch. After each, the posterior of their
   similarity given the matches so far (uniform prior: a Beta distribution) decides: pairs
   whose probability of reaching the threshold is below ``miss`` go.
4. Survivors are verified exactly on their full sets.

First each member of a band bucket is held against the bucket's smallest one, which joins
most of a group in a number of pairs linear in its size. Then every pair of a bucket that is
not yet connected is compared, without leaving any out, in tiles: by signatures first, then by
full sets, which go only to the tile pairs where they have a likely partner. Only links
between components leave a tile, for links inside one cannot change it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.components import block_components, connected_components
from segflow.llm.staging import stage
from segflow.llm.wordhash import U, binaries, lean, mix, release, text_batches, windows_of, words_of

#: Signature values in a band.
ROWS = 5
#: Chance that a pair at the threshold shares no band.
UNSEEN = 1e-6
#: Chance to lose a true link in the Bayesian steps.
MISS = 1e-9
#: Signature values compared before each decision.
STEP = 24
#: Members of a bucket that meet in one task.
TILE = 256
#: Leaves that are verified with one centre in one task.
LEAVES = 32
#: Ids (16 bytes each in memory) up to which a set of ids is broadcast.
BROADCAST_IDS = 1_000_000


def shingle_sets(buf: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words than ``size``, the whole sequence is one."""
    words, first = words_of(buf, rows, lower=True)
    grams = windows_of(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(mix(windows_of(words[a:b], b - a) + U(b - a)) if b > a else np.zeros(0, U))
    return out


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """uint32[len(sets), n]: high bits of the least image of each set under n permutations."""
    out = np.empty((len(sets), n), np.uint32)
    if sets:
        flat = np.concatenate(sets)
        at = np.cumsum([0, *(len(x) for x in sets[:-1])])
        image = np.empty_like(flat)
        for k, a in enumerate(_multipliers(n)):
            np.multiply(flat, a, out=image)
            out[:, k] = np.minimum.reduceat(image, at) >> U(32)
    return out


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.repeat(np.arange(1, bands + 1, dtype=U)[None, :], len(sig), 0)
    for r in range(rows):
        h = mix(h + sig[:, r : bands * rows : rows])
    return h


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The least number of bands that miss a pair at the threshold with a chance of at most UNSEEN: 24 at 85 %, 35 at 80 %."""
    alike = (percent / 100) ** rows
    return 1 if alike >= 1 else math.ceil(math.log(UNSEEN) / math.log1p(-alike))


def _sign(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_batches(batch.column(1)):
                sets = shingle_sets(buf, offsets, size)
                marks = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                finger = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                full = [i for i, x in enumerate(sets) if len(x)]
                sig = np.zeros((len(sets), bands * rows), np.uint32)
                if full:
                    sig[full] = signatures([sets[i] for i in full], bands * rows)
                cuts = np.arange(len(sets) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(finger[:, 0]),
                        pa.array(finger[:, 1]),
                        binaries(sig.reshape(-1), cuts * sig.shape[1]),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "sig"],
                )

    return run


def least_matches(threshold: float, miss: float, n: int) -> np.ndarray:
    """For k values compared, the least number of matches m with P(similarity >= threshold | m of k) >= miss.

    Uniform prior; the posterior is Beta(m + 1, k - m + 1), and its upper tail at t equals
    P(Binomial(k + 1, t) <= m). Index 0 is 0.
    """
    out = [0]
    for k in range(1, n + 1):
        total, m = 0.0, 0
        while True:
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(min(m, k))
    return np.array(out)


def likely_pairs(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, step: int = STEP) -> np.ndarray:
    """Mask of the index pairs (left[i], right[i]) of signature rows that no batch prunes."""
    alive = np.arange(len(left))
    same = np.zeros(len(left), np.int32)
    n = a.shape[1]
    for k in range(0, n, step):
        end = min(k + step, n)
        same[alive] += (a[left[alive], k:end] == b[right[alive], k:end]).sum(1, dtype=np.int32)
        alive = alive[same[alive] >= least[end]]
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def _stars(least: np.ndarray) -> Callable:
    """Prunes (u, sig_u, v, sig_v) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(len(batch), -1) for i in (1, 3))
            i = np.arange(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["u", "v"]).filter(pa.array(likely_pairs(a, b, i, i, least)))

    return run


#: One tile, or two, of a bucket.
PAIR = ["band", "bucket", "t1", "t2"]
_LIKELY = "band int, bucket long, t1 int, t2 int, side int, rep long, component long, sig binary"


def _members(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Sides, ids, components and signatures of a tile pair's rows, and the places of those that look for partners and of those they look among."""
    side, ids, comps = (table.column(c).to_numpy() for c in ("side", "rep", "component"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
    return side, ids, comps, sig, np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _candidates(i: int, side: np.ndarray, ids: np.ndarray, comps: np.ndarray, sig: np.ndarray, second: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places in ``second`` of other components that member i is to be compared with and that no batch of the signatures prunes."""
    js = second[(comps[second] != comps[i]) & ((ids[second] > ids[i]) | (side[i] == 0))]
    return js[likely_pairs(sig, sig, np.full(len(js), i), js, least)]


def _partners(least: np.ndarray) -> Callable:
    """The rows of one tile pair that have a likely partner there."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, comps, sig, first, second = _members(table)
        found = np.zeros(len(ids), bool)
        for i in first.tolist():
            js = _candidates(i, side, ids, comps, sig, second, least)
            found[js] = True
            found[i] |= len(js) > 0
        return table.select([x.split()[0] for x in _LIKELY.split(", ")]).filter(pa.array(found))

    return run


def _tiles(least: np.ndarray, percent: int) -> Callable:
    """Links within one tile, or between two tiles, of a bucket: pairs in different components that no batch prunes, verified on their full sets.

    Returns a link from each linked member to the least one that it is connected with here.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        side, ids, comps, sig, first, second = _members(table)
        own = [np.frombuffer(x, U) for x in table.column("shingles").to_pylist()]
        del table
        sizes = np.array([len(x) for x in own])
        at = np.cumsum(sizes) - sizes
        distinct, tokens = np.unique(np.concatenate(own), return_inverse=True)
        del own
        mark = np.zeros(len(distinct), bool)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in first.tolist():  # one set against the other tile at a time: memory stays small
            js = _candidates(i, side, ids, comps, sig, second, least)
            if not len(js):
                continue
            mine = tokens[at[i] : at[i] + sizes[i]]
            mark[mine] = True
            if len(js) < 16:
                shared = np.array([mark[tokens[at[j] : at[j] + sizes[j]]].sum() for j in js.tolist()])
            else:
                shared = np.add.reduceat(mark[tokens].astype(np.int32), at)[js]
            mark[mine] = False
            js = js[100 * shared >= percent * (sizes[i] + sizes[js] - shared)]
            left.append(np.full(len(js), i))
            right.append(js)
        a, b = np.concatenate(left), np.concatenate(right)
        root = block_components(len(ids), a, b)
        hung = np.flatnonzero(root != np.arange(len(ids)))
        if len(tokens) > 1 << 18:
            del tokens, distinct
            release()
        return pa.table({"u": ids[root[hung]], "v": ids[hung]})

    return run


def _sets_of(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_batches(batch.column(1)):
                sets = shingle_sets(buf, offsets, size)
                flat = np.concatenate([np.zeros(0, U), *sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binaries(flat, np.cumsum([0, *map(len, sets)]))], ["rep", "shingles"])

    return run


def _verify(percent: int) -> Callable:
    """Exact check of one centre's set against those of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("leaf").to_pylist(), table.column("shingles").to_pylist()))
        centres = [np.frombuffer(x, U) for leaf, x in rows if leaf is None]  # several if rows with that id differ
        out = []
        for leaf, x in rows:
            if leaf is not None:
                own = np.frombuffer(x, U)
                for centre in centres:
                    shared = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * shared >= percent * (len(centre) + len(own) - shared):
                        out.append(leaf)
                        break
        u = table.column("u")[0].as_py()
        return pa.table({"u": pa.array([u] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})

    return run


def full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Staged (rep, shingles) of the documents (rep, text) named by ``ids`` (id)."""
    ids = stage(ids.distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # else texts are shuffled to the ids
    return stage(docs.join(ids, docs.rep == ids.id, "left_semi").select("rep", "text").mapInArrow(lean(_sets_of(size)), "rep long, shingles binary"), "sets")


def verify_pairs(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The distinct pairs (u, v) whose full shingle sets in ``docs`` (rep, text) reach the similarity.

    The pairs of one u are dealt out in lots, each with one copy of u's set.
    """
    pairs = stage(pairs.filter("u <> v").distinct(), "pairs")
    lots = stage(pairs.groupBy("u").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("n_lots")), "lots")
    dealt = pairs.join(lots, "u").select("u", "v", F.expr("cast(pmod(xxhash64(v), n_lots) as int)").alias("lot"))
    sets = full_sets(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))), docs, size)
    leaves = dealt.join(sets, F.col("v") == F.col("rep")).select("u", "lot", F.col("v").alias("leaf"), "shingles")
    centres = lots.join(sets, F.col("u") == F.col("rep")).select("u", F.explode(F.expr("sequence(0, n_lots - 1)")).alias("lot"), F.lit(None).cast("long").alias("leaf"), "shingles")
    return leaves.unionByName(centres).groupBy("u", "lot").applyInArrow(_verify(percent), "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int | None = None, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; others are ignored).

    Texts are lower-cased (A-Z) and cut into words; two documents are linked when 100 * shared
    shingles >= percent * all shingles of both. component_id is the smallest doc_id reachable
    by links. Null, empty or wordless text: empty set, no links, its own component. Rows with
    a null id have a null component and are not kept. Repeated rows, and rows that share an
    id, are one node, with the links of all their texts; each row is returned, with its own
    n_shingles. By default the bands follow from ``percent``, so
    that a pair at the threshold is missed as a candidate with probability UNSEEN at most.
    Empty input: empty result.
    """
    bands = bands or bands_for(percent, rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(d.mapInArrow(lean(_sign(size, bands, rows)), "doc_id long, n_shingles long, f1 long, f2 long, sig binary"), "signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "classes")
    # one signature for each class; the join is on the representative's own row
    reps = some.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"]).select(F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep", "sig"])
    banded = stage(reps.mapInArrow(lean(_band_rows(bands, rows)), "rep long, band int, bucket long"), "banded")
    sigs = stage(reps, "sigs")
    buckets = stage(banded.groupBy("band", "bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("other"), F.count("*").alias("n")).filter("centre < other"), "buckets")
    members = stage(banded.join(buckets, ["band", "bucket"]).select("band", "bucket", "rep", "centre", "n"), "members")
    least = least_matches(percent / 100, miss, bands * rows)
    texts = d.filter("doc_id is not null").withColumnRenamed("doc_id", "rep")

    stars = stage(members.filter("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct(), "stars")
    a, b = sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v"))
    likely = stars.join(b, "v").join(a, "u").select("u", "sig_u", "v", "sig_v").mapInArrow(lean(_stars(least)), "u long, v long")
    # an id whose rows differ is one node: it is linked with the representative of each of its classes
    differ = stage(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b"), F.min("f2").alias("c"), F.max("f2").alias("d")).filter("a <> b or c <> d").select("doc_id"), "differ")
    own = some.join(differ, "doc_id", "left_semi").select("doc_id", "f1", "f2").join(classes, ["f1", "f2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    links = stage(verify_pairs(likely, texts, size, percent).unionByName(own), "links")
    comps = stage(connected_components(links), "components")

    # what is left: buckets whose members lie in several components
    placed = members.join(comps, F.col("rep") == F.col("node"), "left").select("band", "bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    placed = stage(placed, "placed")
    open_ = stage(placed.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("n_tiles")), "open")
    more = None
    if open_.limit(1).count():
        rest = stage(placed.join(open_, ["band", "bucket"]).select("band", "bucket", "rep", "component", "n_tiles", F.expr("cast(pmod(xxhash64(rep), n_tiles) as int)").alias("tile")), "rest")
        met = rest.join(sigs, "rep").select("*", F.explode(F.expr("sequence(0, n_tiles - 1)")).alias("met"))
        sides = F.expr("case when tile < met then 0 when tile > met then 1 else 2 end").alias("side")
        dealt = met.select("band", "bucket", F.least("tile", "met").alias("t1"), F.greatest("tile", "met").alias("t2"), sides, "rep", "component", "sig")
        # signatures alone meet everywhere; sets follow only into the tile pairs where they have a likely partner
        likely = stage(dealt.groupBy(*PAIR).applyInArrow(_partners(least), _LIKELY), "likely")
        if likely.limit(1).count():
            sets = full_sets(likely.select(F.col("rep").alias("id")), texts, size)
            more = stage(likely.join(sets, "rep").groupBy(*PAIR).applyInArrow(_tiles(least, percent), "u long, v long"), "links")
    if more is not None and more.limit(1).count():
        comps = stage(connected_components(links.unionByName(more)), "components")

    named = stage(classes.join(comps, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id")), "named")
    full = signed.filter("n_shingles > 0").join(named, ["f1", "f2"], "left").select("doc_id", "n_shingles", "component_id")
    # a row without words is linked with nothing, but may share its id with one that has some
    empty = signed.filter("n_shingles = 0").join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = full.unionByName(empty)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _band_rows(bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), -1)
                h = _bands(sig, bands, rows)
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), pa.array(h.reshape(-1).view(np.int64))], ["rep", "band", "bucket"])

    return run


def drop_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the one with the smallest id.

    Of several rows with one id one stays: that of the least text (null first), of equal texts
    any. Rows with a null id are kept; so are those without words. Columns may have any type.
    """
    found = near_duplicates(docs, percent, size)
    gone = stage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    often = stage(docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__gone")).agg(F.count("*").alias("n")).filter("n > 1").select("__gone"), "often")
    kept = _without(docs, gone)
    if not often.limit(1).count():
        return kept
    again = kept.join(often, kept.doc_id == often["__gone"], "left_semi")
    least = again.groupBy("doc_id").agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__row")).select("__row.*")
    return _without(kept, often).unionByName(least)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id == ids["__gone"], "left_anti")
