"""License rules: every rule against texts that fit it, the scan against rules tried one by one, and awkward texts."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from segflow.llm import license_scan as L
from segflow.llm.license_rules import RULES, parse

SCHEMA = "doc_id long, text string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LINES = [
    "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "see https://creativecommons.org/licenses/by-sa/4.0/ or cc  by",
    "the MIT\nlicense, MIT license",
    "This is free and unencumbered software released into the public domain.",
    "GPLv3 or later",
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_base(text):
    words = re.findall(WORD, lowered(text))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_found(text):
    """All rules on all texts, suppression pair by pair."""
    spans = [m.span() for m in re.finditer(WORD, lowered(text))]
    words = [lowered(text)[a:b] for a, b in spans]
    norm, starts, at = " ".join(words).encode(), {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w.encode()) + 1
    hits = []
    for k, rule in enumerate(RULES):
        for m in rule.expression.finditer(norm):
            first = starts[m.start()]
            hits.append((rule.priority, first, first + len(m[0].split()), k))
    out = []
    for p, a, b, k in hits:
        hidden = any(s <= a and e >= b and (q < p or (q == p and (e - s > b - a or ((s, e) == (a, b) and j < k)))) for q, s, e, j in hits if (q, s, e, j) != (p, a, b, k))
        if not hidden:
            out.append((RULES[k].label, k, p, spans[a][0], spans[b - 1][1], a, b - a))
    return sorted(out, key=lambda x: (x[3], x[4], x[1]))


def found_of(text):
    return [(x["label"], x["rule"], x["priority"], x["start"], x["end"], x["word"], x["words"]) for x in L.Scanner(RULES).scan((text or "").encode())[5]]


def test_rules_are_hundreds_and_distinct():
    assert len(RULES) >= 300 and len({r.expression.pattern for r in RULES}) == len(RULES)
    assert {r.priority for r in RULES} == set(L.WEIGHTS)
    with pytest.raises(ValueError):
        parse("label | 1 | no expression")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.data())
def test_each_match_holds_the_rules_keyword(data):
    """Else the gate would hide matches."""
    for rule in RULES:
        inner = rule.expression.pattern.decode().removeprefix("(?<![^ ])").removesuffix("(?![^ ])").replace("[^ ]+", "[a-z0-9]+")
        text = data.draw(st.from_regex(re.compile(inner), fullmatch=True))
        assert rule.keyword.decode() in text.split(), (rule, text)


@pytest.mark.parametrize("seed", range(3))
def test_scan_matches_rules_tried_one_by_one(seed):
    r = random.Random(seed)
    for _ in range(60):
        parts = [r.choice([*LINES, "Étude — näive text", "license", "cc by", "apache", "gnu", "version 3", "2.0", "🙂"]) for _ in range(r.randint(0, 9))]
        text = r.choice([" ", "\n", ", ", ""]).join(parts)
        assert found_of(text) == brute_found(text), text


def test_query_columns(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice([*LINES, "plain words", "mit", "é"]) for _ in range(r.randint(0, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "   "), (None, LINES[3]), (5, LINES[0]), (103, "MIT-License mitlicense ﬁMIT License"), (104, "a\u0000cc\u0001by\u007fCC-BY")]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA + ", n_words int, found string").repartition(3)
    got = L.digest(L.find_licenses(df))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = []
    for i, t in rows:
        base, found = brute_base(t), brute_found(t)
        labels = sorted({*filter(None, base[4].split(",")), *(x[0] for x in found)})
        doubt = 1.0
        for label in labels:
            doubt *= 1 - max((L.WEIGHTS[x[2]] for x in found if x[0] == label), default=L.BASE_WEIGHT)
        want.append((i, *base, ",".join(labels), round(1 - doubt, 6)))
    assert sorted(map(str, want)) == sorted(str((*r[:7], round(r.score, 6))) for r in got.collect())
    assert L.digest(L.find_licenses(df.limit(0))).count() == 0


def test_labels_of_plain_notices():
    labels = lambda t: {x[0] for x in found_of(t)}
    assert labels(LINES[0]) == {"cc-by-nc-4.0"}
    assert labels(LINES[1]) == {"apache-2.0"}
    assert labels(LINES[2]) == {"gpl-3.0"}
    assert labels(LINES[3]) == {"mit"}
    assert labels(LINES[4]) == {"bsd-3-clause"}
    assert labels("the license to act; he released the public, apache helicopters by the gnu herd at mit") == set()


def test_long_texts_take_linear_time():
    scanner = L.Scanner(RULES)

    def took(text):
        began = time.perf_counter()
        scanner.scan(text)
        return time.perf_counter() - began

    for unit in (b"licensed under the ", b"redistribution and use neither the name of x ", b"cc by ", b"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis ", b"copyright a b "):
        short, long = took(unit * (200_000 // len(unit))), took(unit * (800_000 // len(unit)))
        assert long < 12 * short + 0.5, unit
    big = b"word " * 700_000 + b"mit license"
    assert scanner.scan(big)[:4] == (700_002, 1, 700_000, 700_000)
