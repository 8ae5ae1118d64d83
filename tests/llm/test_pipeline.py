"""Each stage of the pipeline, on what the one before it kept, against brute force."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from segflow.llm import secret_scan
from segflow.llm.queries import ORACLE_SQL
from segflow.llm.staging import clear_staged, stage
from tests.llm.test_dedup import brute_near
from tests.llm.test_texts import brute_base, fresh_tokenizer


def test_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.orderBy("doc_id").limit(3)  # repeated rows, a null id, null and empty texts
    odd = spark.createDataFrame([(None, "A fine text. With two lines.\nAnd more words here.", "en", "src1", 5), (10**7, None, "en", None, 0), (10**7 + 1, "", "en", "src2", 0)], docs.schema)
    docs = stage(docs.unionByName(twice).unionByName(odd), "raw")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "minhash_near_dedup", "secret_scanning", "temperature_mixing", "best_fit_packing"]

    good = stage(steps["quality_classifier"](spark, docs, sf), "good")
    left = Counter(r.doc_id for r in good.collect())
    assert good.columns == names and not left - Counter(r.doc_id for r in docs.collect())
    marked = [(left[r.doc_id] > 0) == bool(r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert sum(marked) >= 0.97 * len(marked) and {None, 10**7, 10**7 + 1} - set(left) == {10**7, 10**7 + 1}  # no line, no quality

    single = stage(steps["minhash_near_dedup"](spark, good, sf), "single")
    groups = brute_near([(r.doc_id, r.text) for r in good.collect() if r.doc_id is not None], 80)
    want = Counter({i: 1 for i, _, _, kept in groups if kept})
    want[None] = sum(r.doc_id is None for r in good.collect())
    assert single.columns == names and Counter(r.doc_id for r in single.collect()) == +want

    clean = stage(steps["secret_scanning"](spark, single, sf), "clean")
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == names and after.keys() == before.keys()
    for i, t in before.items():
        assert (after[i].text == t) == (not secret_scan.scan(t or "")) and not brute_base(after[i].text or "")
        assert t is None or after[i].n_chars == len(after[i].text)

    mixed = stage(steps["temperature_mixing"](spark, clean, sf), "mixed")
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} <= set(before)
    # the copies of each document, by the SQL of op8 over what the stage was given
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r.doc_id for r in clean.collect()], pa.int64()), "source": [r.source for r in clean.collect()], "text": [r.text for r in clean.collect()]}))
    copies = Counter({r[0]: r[3] for r in con.execute(ORACLE_SQL["op8_temperature_mixing"]).fetchall() if r[0] is not None})
    got = Counter(r.doc_id for r in mixed.collect() if r.doc_id is not None)
    assert got == +copies and set(got) < set(before)

    tokenizer, _ = fresh_tokenizer()
    rows = steps["best_fit_packing"](spark, mixed, sf).collect()
    pieces, bins = Counter(), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    wanted = Counter()
    for r in mixed.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at, size, k = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while at < len(ids):
            wanted[r.doc_id, k, at, size, zlib.crc32(ids[at : at + size].tobytes())] += 1
            at, k, size = at + size, k + 1, 1024
    assert pieces == wanted
    for parts in bins.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 1024 and len(parts) <= corpus_pipeline.MAX_DOCS
    clear_staged(spark)


def test_whole_run(spark, sf):
    """The sequences hold, token for token, texts of the corpus without its secrets."""
    tokenizer, _ = fresh_tokenizer()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, ids))
        sequences[r.sequence_id].append((r.offset, len(ids)))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0.2 * len(texts) < len(pieces) < len(texts)
    for i, parts in pieces.items():
        whole = np.concatenate([x for _, x in {k: (k, x) for k, x in sorted(parts, key=lambda p: p[0])}.values()])
        assert whole[-1] == 2 and tokenizer.decode(whole[:-1].tolist(), skip_special_tokens=False) == secret_scan.redact(texts[i], secret_scan.scan(texts[i]))
        assert len(set(Counter(k for k, _ in parts).values())) == 1  # every copy is whole
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 1024 and len(parts) <= corpus_pipeline.MAX_DOCS
