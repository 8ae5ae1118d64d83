"""Line features by their definition, and marginals as derivatives of the log partition."""

import bisect
import random
import re
from collections import Counter

import numpy as np

from segflow.llm import quality_crf as Q

SPACES = b" \t\x0b\x0c\r"


def brute_bins(texts):
    rows, sizes, first = [], [], [0]
    place = lambda edges, x: bisect.bisect_right(list(edges), x)
    for text in texts:
        lines = [x for x in text.split(b"\n") if len(x) > sum(c in SPACES for c in x)]
        times = Counter(lines)
        for line in lines:
            n = [sum(Q._TABLE[c] == k for c in line) for k in range(9)]
            size, words, letters = len(line), n[Q.SPACE] + 1, max(n[Q.UPPER] + n[Q.LOWER], 1)
            said = re.findall(rb"[^\x20\x09-\x0D]+", line)
            again = sum(a == b for a, b in zip(said, said[1:]))
            share = lambda x, of: place(Q._SHARE_EDGES, x / of)
            rows.append([
                share(n[Q.UPPER], letters), share(n[Q.DIGIT], size), share(n[Q.SYMBOL], size), share(n[Q.PIPE], size), share(n[Q.BANG], size),
                share(n[Q.STOP], words), share(n[Q.COMMA], words), place(Q._SIZE_EDGES, size), int(min(size / words, 10)), place(Q._TIMES_EDGES, times[line]),
                int(Q._TABLE[line[-1]]), int(Q._TABLE[line[0]]), share(again, words),
            ])
            sizes.append(size)
        first.append(len(rows))
    return rows, sizes, first


def test_line_bins_follow_their_definition():
    r = random.Random(2)
    pieces = ["Hello there.", "BUY NOW!!!", "a a a a", "| x | y |", "", "  ", "\t\r", "1234 5", "#*$%", "ünï cödé, no?", "word " * 40, "x"]
    texts = ["\n".join(r.choice(pieces) for _ in range(r.randint(0, 9))).encode() for _ in range(60)] + [b"", b"\n\n", b"one line\n"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bins, size, first = Q.line_bins(buf, offsets)
    rows, sizes, starts = brute_bins(texts)
    assert first.tolist() == starts and size.tolist() == sizes and bins.tolist() == rows


def test_neighbours_stay_within_their_document():
    bins = np.arange(5 * Q.N_FEATURES, dtype=np.uint8).reshape(5, Q.N_FEATURES) % 11
    own, before, after = Q.neighbours(bins, np.array([0, 0, 2, 3, 3, 5, 5]))
    none = [Q.N_BINS - 1] * Q.N_FEATURES
    assert own.tolist() == bins.tolist()
    assert before.tolist() == [none, bins[0].tolist(), none, none, bins[3].tolist()]
    assert after.tolist() == [bins[1].tolist(), none, none, bins[4].tolist(), none]


def test_expectations_are_derivatives_of_the_log_partition():
    """The gradient is what is seen less what is expected; what is expected, by finite differences."""
    r = np.random.default_rng(3)
    first = np.array([0, 4, 4, 5, 12])
    score, moves = r.normal(size=12), r.normal(size=(2, 2))
    z = lambda s, m: Q.forward_backward(s, first, m)[2]
    p, moved, _ = Q.forward_backward(score, first, moves)
    step = 1e-5
    for i in range(12):
        d = np.zeros(12)
        d[i] = step
        assert abs((z(score + d, moves) - z(score - d, moves)) / (2 * step) - p[i]) < 1e-6
    for a in range(2):
        for b in range(2):
            d = np.zeros((2, 2))
            d[a, b] = step
            assert abs((z(score, moves + d) - z(score, moves - d)) / (2 * step) - moved[a, b]) < 1e-6


def test_fitting_raises_the_likelihood_of_its_labels():
    r = np.random.default_rng(4)
    bins = r.integers(0, 6, (60, Q.N_FEATURES)).astype(np.uint8)
    first, label = np.arange(0, 61, 6), (np.arange(10) % 2).astype(float)
    bins[np.repeat(label, 6) == 1, 0] = 9
    y = np.repeat(label, 6)

    def likelihood(f):
        s = f.scores(bins, first)
        inner = np.repeat(label, 5)
        seen = (inner == 0).sum() * f.moves[0, 0] + (inner == 1).sum() * f.moves[1, 1]
        return (y * s).sum() + seen - Q.forward_backward(s, first, f.moves)[2]

    done = [likelihood(Q.fit(bins, np.ones(60, np.int64), first, label, rounds=k)) for k in (0, 5, 30, 120)]
    assert done[0] < done[1] < done[2] and done[-1] > done[0] / 20  # the penalty takes a little back at the end
