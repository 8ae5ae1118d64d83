"""Token ids of many texts at once by a public tokenizer.

A byte-level BPE cuts a text into pre-tokens (words with the space before them, runs of
digits, of other signs, of white space) and encodes each on its own. Here the cut is made for
a whole batch of texts on arrays, by the character classes that the tokenizer itself tells,
and each distinct pre-token that a worker meets is encoded once, by tiktoken over the ranks
that the file's merges give. Ids are those of ``Tokenizer.encode(text,
add_special_tokens=False)``. A tokenizer of another kind gets each text whole, and so does
this one with texts that hold an added token and with pre-tokens of unusual length.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import tiktoken

from segflow.llm.wordhash import U, _hash_words

#: Pre-tokens whose ids a worker remembers (some 40 bytes each), and bytes of the longest one; longer ones are asked for each time.
REMEMBERED, LONGEST = 500_000, 64
LETTER, DIGIT, SIGN, SPACE, UNASKED = range(5)
# The endings that the pre-tokenizer cuts off behind an apostrophe.
_ENDINGS_1, _ENDINGS_2 = b"stmd", (b"re", b"ve", b"ll")


class BatchEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not spec["model"].get("dropout")
        )
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.kinds = np.full(0x110000, UNASKED, np.uint8)
        self.ranked = None
        if self.cuts:
            self._ask_kinds(range(128))
            self.ranked = _ranked(spec["model"])
            self.line_feed = self.ranked.encode_single_token("\n") if self.ranked else -1
        self._forget()

    def _forget(self) -> None:
        """No pre-token is known: hashes in order, and where and how many their ids are."""
        self.known, self.at, self.n = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.n_flat = np.empty(1 << 16, np.uint32), 0

    def _ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_kinds(self, points) -> None:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in points:
            if 0xD800 <= c < 0xE000:
                continue
            self.kinds[c] = next((k for k, like in enumerate("a1!") if len(cut(like + chr(c))) == 1), SPACE)

    def _byte_kinds(self, buf: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        kind = self.kinds[:256][buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            first = buf[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
            for k in (1, 2, 3):
                some = size > k
                point[some] = point[some] << 6 | buf[lead[some] + k] & 0x3F
            new = np.unique(point)
            self._ask_kinds(new[self.kinds[new] == UNASKED].tolist())
            own = self.kinds[point]
            for k in range(4):
                kind[lead[size > k] + k] = own[size > k]
        return kind

    def starts(self, buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token begins, and which of them are texts that the tokenizer must get whole."""
        is_row = np.zeros(len(buf) + 1, bool)
        is_row[rows] = True
        if not self.cuts:
            texts = np.flatnonzero(is_row[:-1])
            return texts, np.ones(len(texts), bool)
        kind = self._byte_kinds(buf)
        start = is_row[:-1].copy()
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(start)
        end = np.append(run[1:], len(buf))
        goes_on = ~is_row[end]
        # the last white space before something else stands alone, or with it if it is a blank
        ends = end[(kind[run] == SPACE) & goes_on]
        last = ends - 1
        for _ in range(3):
            last -= (buf[last] & 0xC0) == 0x80
        start[last] = True
        start[ends[buf[last] == 0x20]] = False
        # endings behind an apostrophe that begins a pre-token
        quote = run[(end - run == 1) & goes_on]
        quote = quote[(buf[quote] == 0x27) & start[quote]]
        quote = quote[kind[quote + 1] == LETTER]
        behind = np.append(buf, np.zeros(2, np.uint8))
        own_row = ~is_row[np.minimum(quote + 2, len(buf))]
        one = np.isin(buf[quote + 1], list(_ENDINGS_1))
        two = np.zeros(len(quote), bool)
        for a, b in _ENDINGS_2:
            two |= (behind[quote + 1] == a) & (behind[quote + 2] == b) & own_row
        cut = one | two
        quote, stop = quote[cut], (quote + np.where(one, 2, 3))[cut]
        start[quote + 1] = False
        start[stop[stop < len(buf)]] = True
        whole = np.zeros(len(buf), bool)
        text = buf.tobytes()
        if any(t in text for t in self.added):
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                if any(t in text[a:b] for t in self.added):
                    start[a + 1 : b] = False
                    whole[a] = True
        at = np.flatnonzero(start)
        return at, whole[at]

    def _append(self, ids: np.ndarray) -> int:
        """The place in ``flat`` where the ids are put."""
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        at = self.n_flat
        self.flat[at : at + len(ids)] = ids
        self.n_flat += len(ids)
        return at

    def _encode(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each pre-token buf[start:end] are put, and how many there are."""
        at, n = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        lines = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int32)])
        plain = (lines[end] == lines[start]) & (self.ranked is not None)
        some = np.flatnonzero(plain)
        if len(some):  # one below the other, so that line feeds part their ids
            size = end[some] - start[some] + 1
            stop = np.cumsum(size)
            joined = buf[np.minimum(np.repeat(start[some] - stop + size, size) + np.arange(stop[-1]), len(buf) - 1)]
            joined[stop - 1] = 10
            found = self.ranked.encode_to_numpy(joined.tobytes().decode(), allowed_special=set(), disallowed_special=())
            ends = np.flatnonzero(found == self.line_feed)
            n[some] = np.diff(ends, prepend=-1) - 1
            at[some] = self._append(np.delete(found, ends)) + np.cumsum(n[some]) - n[some]
        rest = np.flatnonzero(~plain).tolist()
        for i, ids in zip(rest, self._ask([buf[start[i] : end[i]].tobytes().decode() for i in rest]) if rest else []):
            at[i], n[i] = self._append(np.array(ids, np.uint32)), len(ids)
        return at, n

    def __call__(self, buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[rows[i]:rows[i + 1]] (UTF-8), one after the other, and where those of each text begin (and the end)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        start, whole = self.starts(buf, rows)
        end = np.append(start[1:], len(buf))
        asked = whole | (end - start > LONGEST)
        short = np.flatnonzero(~asked)
        coded = pa.array(_hash_words(buf, start[short], end[short])).dictionary_encode()
        values, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.known) + len(values) > REMEMBERED:
            self._forget()
        found = np.searchsorted(self.known, values)
        found[found == len(self.known)] = 0
        hit = self.known[found] == values if len(self.known) else np.zeros(len(values), bool)
        own_at, own_n = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        own_at[hit], own_n[hit] = self.at[found[hit]], self.n[found[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            seen = np.empty(len(values), np.int64)
            seen[place[::-1]] = short[::-1]  # one place where each occurs
            new = new[np.argsort(values[new])]
            own_at[new], own_n[new] = self._encode(buf, start[seen[new]], end[seen[new]])
            known = np.concatenate([self.known, values[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.at, self.n = known[order], np.concatenate([self.at, own_at[new]])[order], np.concatenate([self.n, own_n[new]])[order]
        at, n = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        at[short], n[short] = own_at[place], own_n[place]
        kept = self.n_flat
        for i in np.flatnonzero(asked).tolist():
            (ids,) = self._ask([buf[start[i] : end[i]].tobytes().decode()])
            at[i], n[i] = self._append(np.array(ids, np.uint32)), len(ids)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - upto[:-1], n) + np.arange(upto[-1])]
        self.n_flat = kept
        return ids, upto[np.searchsorted(start, rows)]


def _ranked(model: dict) -> tiktoken.Encoding | None:
    """The merges of a byte-level BPE as ranks; None if its ids do not follow the order of its merges."""
    vocab = model["vocab"]
    merged = [vocab[x.replace(" ", "") if isinstance(x, str) else "".join(x)] for x in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or len(vocab) != 256 + len(merged):
        return None
    # fixed value: bytes that are no visible sign are written as the signs from U+0100 on, in order
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    sign = {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    return tiktoken.Encoding("ranks", pat_str=r"[^\n]+|\n", mergeable_ranks={bytes(sign[c] for c in k): i for k, i in vocab.items()}, special_tokens={})


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
