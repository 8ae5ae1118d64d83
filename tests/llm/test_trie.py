"""The conversation trie against a dictionary of prefixes, and on awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from segflow.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group=100, shared=6):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            conv[c].append(((turn is not None, turn or 0), tie, role, text))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in conv.items():
        h, base = zlib.crc32(str(c).encode()) % shared, (abs(c) // group * group) * (1 if c >= 0 else -1)
        turns = tuple(conv.get(base, [])[:h] + own[h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()), key=str)


def trie(spark, rows, **kw):
    df = C.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, n, vocabulary, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 400), n):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), "".join(r.choice("aé") for _ in range(r.randint(0, vocabulary)))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "vocabulary", "longest"), [(1, 150, 2, 9), (2, 80, 1, 20)])
def test_trie_matches_brute_force(spark, seed, n, vocabulary, longest):
    rows = talk(seed, n, vocabulary, longest)
    assert trie(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (5, None, None, None),
        (5, 1, "user", "a"),
        (5, 1, "user", "a"),
        (5, 1, "user", "b"),
        (None, 0, "user", "lost"),
        (100, 0, "user", "x"),
        *[(100 + k, t, "user", f"{t}") for k in (1, 2, 7, 13) for t in range(3)],
        (777, 0, "user", "long " * 50_000),
    ]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, rows, shared=1) == brute(rows, shared=1)
    assert trie(spark, []) == []


def test_columns_of_other_tables_do_not_clash(spark):
    rows = talk(3, 20, 1, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("node", "key", "n", "handle", "depth", "base", "h")})
    assert sorted(map(tuple, C.conversation_trie(df).collect()), key=str) == brute(rows)


def test_a_hot_conversation_and_a_chain_of_prefixes(spark):
    """Thousands of equal conversations, and one that ends at every depth of a long one."""
    rows = [(1000 + k, t, "user", "same") for k in range(3000) for t in range(2)]
    rows += [(100_000 + k, t, "user", f"t{t}") for k in range(40) for t in range(k + 1)]
    assert trie(spark, rows, shared=1) == brute(rows, shared=1)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(-1, 40) for b in range(max(a + 1, 0), 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", C.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    fat = lambda x: (x & -x) if x else 1 << 40
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=fat) for r in got)


def test_ends_are_hashed_in_order(spark):
    ids = random.Random(4).sample(range(-5000, 5000), 4000)
    got = C.ends_digest(spark.createDataFrame([(bytearray(b"k"), i) for i in ids] + [(bytearray(b"m"), 3)], "key binary, conv_id long").repartition(5)).collect()
    want = {b"k": ids, b"m": [3]}
    assert {bytes(r.node): r.ends_sha256 for r in got} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
