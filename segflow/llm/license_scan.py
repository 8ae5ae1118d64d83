"""License notices by ordered signature rules.

A text becomes its words (runs of letters, digits and characters beyond ASCII) in lower case,
joined by one space. Only rules whose keyword is among the words are tried. Of overlapping
detections, one that lies within another of higher priority, or within a longer one of its own,
is suppressed. Base phrases count wherever their words stand, suppressed or not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.llm.license_rules import RULES, Rule
from segflow.llm.wordhash import SEGMENT, lean

#: Phrases of the base and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: How sure a detection of each priority is that the text is under a license; a base phrase alone.
WEIGHTS, BASE_WEIGHT = {1: 0.99, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.6}, 0.5

#: Bytes to words in lower case: what is no letter, digit or part of a character beyond ASCII is a space.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FOUND = "label: string, rule: int, priority: int, start: long, end: long, word: long, words: long"
_SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found array<struct<{_FOUND}>>"
_HIT = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])


def normalise(raw: bytes, keywords: frozenset[bytes]) -> tuple[bytes, int, frozenset[bytes]]:
    """The words of a text joined by one space, how many there are, and those that are keywords. Long texts go in pieces cut between words."""
    clean = raw.translate(_CLEAN)
    parts, n, found, at = [], 0, set(), 0
    while at < len(clean):
        end = clean.find(b" ", at + SEGMENT)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        if words:
            parts.append(b" ".join(words))
            n += len(words)
            found |= keywords.intersection(words)
        at = end
    return b" ".join(parts), n, frozenset(found)


def visible(start: np.ndarray, end: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """Which of the detections are not suppressed. Of equal ones the first stays."""
    order = np.lexsort((np.arange(len(start)), -end, start, priority))
    keep = np.ones(len(start), bool)
    top_start, top_end = np.zeros(0, start.dtype), np.zeros(0, end.dtype)  # of higher priorities: starts, and the greatest end up to each
    for level in np.unique(priority):
        own = order[priority[order] == level]
        s, e = start[own], end[own]
        if len(top_start):
            at = np.searchsorted(top_start, s, "right") - 1
            keep[own[(at >= 0) & (top_end[np.maximum(at, 0)] >= e)]] = False
        # by start and falling end, whatever lies within another of its level comes after it
        before = np.maximum.accumulate(np.concatenate([[-1], e[:-1]]))
        keep[own[before >= e]] = False
        all_s, all_e = np.concatenate([top_start, s]), np.concatenate([top_end, e])
        by = np.argsort(all_s, kind="stable")
        top_start, top_end = all_s[by], np.maximum.accumulate(all_e[by])
    return keep


def _places(norm: bytes, phrase: bytes) -> list[int]:
    """Where ``phrase`` stands in ``norm`` as whole words."""
    out, padded, asked, at = [], b" " + norm + b" ", b" " + phrase + b" ", -1
    while (at := padded.find(asked, at + 1)) >= 0:
        out.append(at)
    return out


def _code_points(raw: bytes, word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points of the text, of runs of words."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(raw.translate(_CLEAN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    at = np.concatenate([starts[word], ends[word + words - 1]])
    known, back = np.unique(at, return_inverse=True)
    lead = np.append(((data & 0xC0) != 0x80).astype(np.uint8), 0)
    between = np.add.reduceat(lead, known, dtype=np.int64)[:-1]
    upto = lead[: known[0]].sum(dtype=np.int64) + np.concatenate([[0], np.cumsum(between)])
    points = upto[back]
    return points[: len(word)], points[len(word) :]


class Scanner:
    """Rules by keyword, ready to scan texts."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        self.by_keyword: dict[bytes, list[int]] = defaultdict(list)
        for k, rule in enumerate(rules):
            self.by_keyword[rule.keyword].append(k)
        self.base = {p.encode(): label for p, label in BASE.items()}
        self.keywords = frozenset(self.by_keyword) | frozenset(p.split()[0] for p in self.base)

    def scan(self, raw: bytes) -> tuple[int, int, int | None, int | None, list[str], list[dict]]:
        norm, n, found = normalise(raw, self.keywords)
        if not found:
            return n, 0, None, None, [], []
        gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        word_at = lambda x: np.searchsorted(gaps, np.asarray(x, np.int64), "left")
        places, labels = [], set()
        for phrase, label in self.base.items():
            if here := _places(norm, phrase):
                places += here
                labels.add(label)
        hits = [(m.start(), m.end(), k) for key in found for k in self.by_keyword.get(key, ()) for m in self.rules[k].expression.finditer(norm)]
        out = []
        if hits:
            hits.sort(key=lambda x: x[2])
            start, end, rule = (np.array(x, np.int64) for x in zip(*hits))
            priority = np.array([self.rules[k].priority for k in rule.tolist()])
            keep = visible(start, end, priority)
            start, end, rule, priority = start[keep], end[keep], rule[keep], priority[keep]
            word = word_at(start)
            words = word_at(end - 1) - word + 1
            a, b = _code_points(raw, word, words)
            rows = zip([self.rules[k].label for k in rule.tolist()], rule.tolist(), priority.tolist(), a.tolist(), b.tolist(), word.tolist(), words.tolist())
            out = sorted((dict(zip(("label", "rule", "priority", "start", "end", "word", "words"), x)) for x in rows), key=lambda x: (x["start"], x["end"], x["rule"]))
        w = word_at(places)
        return n, len(places), int(w.min()) if places else None, int(w.max()) if places else None, sorted(labels), out


def _scan_batches(rules: list[Rule]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = list(zip(*(scanner.scan(x or b"") for x in batch.column(1).to_pylist()))) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(_HIT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found"])

    return run


def find_licenses(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, found) for each row of ``docs`` (doc_id, text; others are ignored).

    ``found`` has the detections that are not suppressed: label, rule (its place in ``rules``),
    priority, start and end in code points of the text, first word and number of words. Null
    and empty texts have no words; a null id stays null; repeated rows are each scanned; whole
    texts are read, of any length.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(lean(_scan_batches(RULES if rules is None else rules)), _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Labels of base and rules as text, and a score: one minus the product of the doubts that labels, each by its surest detection, leave."""
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda x: x["label"]))))
    weight = lambda p: F.element_at(F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv)), p)
    best = lambda label: F.array_max(F.transform(F.filter("found", lambda x: x["label"] == label), lambda x: weight(x["priority"])))
    doubt = F.aggregate(labels, F.lit(1.0), lambda a, x: a * (1 - F.coalesce(best(x), F.lit(BASE_WEIGHT))))
    names = lambda c: F.array_join(c, ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", names(F.array_sort("base_labels")).alias("base_labels"), names(labels).alias("labels"), F.round(1 - doubt, 9).alias("score"))
