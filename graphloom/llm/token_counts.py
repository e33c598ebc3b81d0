"""Token counts by a compiled finite-state transducer.

The merges of a byte-pair vocabulary with word ends are compiled into a deterministic transducer
over bytes (the last byte of a word is a symbol of its own). A state holds what later symbols can
still change: the longest suffix that begins some token and, for each shorter cut of it, the token
that ends there and the count since then. A transition is annotated with the tokens it emits; a
merge over the cut takes back emitted tokens, so the number may be negative. States are made when
first met, as in a lazily determinised automaton, and the table is flushed when it is full.

A text is cut into chunks of equal length which run in step. A chunk's state map is constant from
its first word end on, so the map is that chunk's head, the count after it and the exit state. The
maps compose by a prefix scan: each head starts from the exit of the last constant map before it.

Defined cases: null or empty texts have 0 bytes and 0 tokens; strings of added tokens inside a text
count as one token each, as the library has it; repeated rows give repeated results; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
CHUNK = 512
#: Cells of the transition table before it is flushed.
CELLS = 20_000_000


def tokenizer_path(name: str) -> str:
    """The place of a named public vocabulary, or the path itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts the tokens of words given as symbols: bytes, plus 256 for a word's last byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(END)
            out = [letters[c] for c in (token[: -len(END)] if last else token)]
            if last and out:
                out[-1] += 256
            return tuple(out)

        added = {t["content"] for t in spec["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.token = {symbols(t): i for t, i in spec["model"]["vocab"].items() if t not in added and t != END}
        self.text = {i: s for s, i in self.token.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(symbols(a), symbols(b)): r for r, (a, b) in enumerate(merges)}
        self.begins = {s[:n] for s in self.token for n in range(1, len(s))}
        self.valid: dict[tuple[int, int], bool] = {}
        self.width, self.column = 1, np.full(512, -1, np.int64)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.config: list[tuple] = []
        self.next = np.full((256, self.width), -1, np.int32)
        self.emits = np.zeros((256, self.width), np.int8)
        self._state(((), ((0, -1, 0),)))

    def _state(self, config: tuple) -> int:
        at = self.states.get(config)
        if at is None:
            at = self.states[config] = len(self.config)
            self.config.append(config)
            if at >= len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.emits = np.concatenate((self.emits, np.zeros_like(self.emits)))
            self.next[at, 0] = at
        return at

    def bpe(self, parts: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """Merges by rank, smallest first, as the vocabulary's training defines them."""
        while len(parts) > 1:
            ranks = [self.rank.get(p, sys.maxsize) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == sys.maxsize:
                break
            i = ranks.index(low)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def stands(self, a: int, b: int) -> bool:
        """Whether token a, then token b, is how their joined text is cut."""
        known = self.valid.get((a, b))
        if known is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            x, y = self.text[a], self.text[b]
            known = self.valid[a, b] = self.bpe([(s,) for s in x + y]) == [x, y]
        return known

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        suffix, cuts = self.config[state]
        found = None
        for k, last, since in cuts:
            t = self.token.get((*suffix[len(suffix) - k :], symbol))
            if t is not None and (last < 0 or self.stands(last, t)):
                found = (t, since + 1)
                break
        if found is None:
            raise ValueError(f"no token ends at symbol {symbol}")
        token, emitted = found
        if symbol >= 256:
            return 0, emitted
        kept = [(k + 1, last, since - emitted) for k, last, since in cuts if (*suffix[len(suffix) - k :], symbol) in self.begins]
        longest = max((k for k, _, _ in kept), default=0)
        new = (*suffix, symbol)
        return self._state((new[len(new) - longest :], (*kept, (0, token, 0)))), emitted

    def prepare(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols as columns of the table, which is widened for new ones."""
        fresh = np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0))
        if len(fresh):
            self.column[fresh] = np.arange(self.width, self.width + len(fresh))
            self.width += len(fresh)
            grow = ((0, 0), (0, len(fresh)))
            self.next = np.pad(self.next, grow, constant_values=-1)
            self.emits = np.pad(self.emits, grow)
        return self.column[symbols]

    def run(self, cols: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states, as indexes into self.config, and counts of runs of columns in step."""
        symbol = np.zeros(self.width, np.int64)
        symbol[self.column[self.column >= 0]] = np.flatnonzero(self.column >= 0)
        state, count = state.astype(np.int64), np.zeros(len(start), np.int64)
        padded = np.append(cols, 0)
        size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for power in np.unique(size):
            lanes = np.flatnonzero((size == power) & (length > 0))
            if not len(lanes):
                continue
            now, total, end = state[lanes], np.zeros(len(lanes), np.int64), length[lanes]
            base = start[lanes]
            for j in range(int(end.max())):
                col = padded[np.where(j < end, base + j, len(cols))]
                at = now * self.width + col
                to = self.next.ravel()[at]
                if (to < 0).any():
                    for cell in np.unique(at[to < 0]):
                        s, c = divmod(int(cell), self.width)
                        t, emitted = self._step(s, int(symbol[c]))
                        self.next[s, c], self.emits[s, c] = t, emitted
                    to = self.next.ravel()[at]
                total += self.emits.ravel()[at]
                now = to.astype(np.int64)
            state[lanes], count[lanes] = now, total
        return state, count

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.added and "<" in text and self.added.search(text):
                parts = self.added.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                s = word_symbols(part)
                if len(s):
                    pieces.append(s)
                    owner.append(i)
        if not pieces:
            return out
        if len(self.config) * self.width > CELLS:
            self._reset()
        flat = np.concatenate(pieces)
        cols = self.prepare(flat)
        sizes = np.array([len(p) for p in pieces])
        offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        chunks = -(-sizes // CHUNK)
        piece = np.repeat(np.arange(len(pieces)), chunks)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = offset[piece] + nth * CHUNK
        end = np.minimum(start + CHUNK, offset[piece] + sizes[piece])
        ends = np.flatnonzero(flat >= 256)
        first = np.append(ends, len(flat))[np.searchsorted(ends, start)] + 1
        constant = (first <= end) | (nth == 0)
        body = np.where(nth == 0, start, np.minimum(first, end))
        exits, counts = self.run(cols, body, np.where(constant, end - body, 0), np.zeros(len(start)))
        # The scan: the chunk whose map was the last to be constant, for each chunk that needs an entry state.
        latest = np.maximum.accumulate(np.where(constant, np.arange(len(start)), -1))
        heads = np.flatnonzero(constant & (nth > 0))
        before = latest[heads - 1]
        _, more = self.run(cols, end[before], body[heads] - end[before], exits[before])
        counts[heads] += more
        np.add.at(out, np.array(owner)[piece], counts)
        return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    kind = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            kind[c] = 1 if first == "L" else 2
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kind


def word_symbols(text: str) -> np.ndarray:
    """The text's symbols after NFC, lower case and the cut into words."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    text = text.lower()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[code]
    begins = (kind == 2) & True
    begins[0] = kind[0] > 0
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    at = np.flatnonzero((code == 0x27) & begins)
    if len(at):
        # The endings 's 't 'm 'd and 're 've 'll are words where a word begins.
        pad = np.concatenate((code, np.zeros(3, np.uint32)))
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        tails = at[short | long]
        after = tails + np.where(long, 3, 2)[short | long]
        begins[tails + 1] = False
        after = after[after < n]
        begins[after[kind[after] > 0]] = True
    last = np.zeros(n, bool)
    last[:-1] = begins[1:] | (kind[1:] == 0)
    last[-1] = True
    raw = np.frombuffer(text.encode(), np.uint8)
    word = kind > 0
    if len(raw) > n:
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        flag = np.zeros(len(raw), bool)
        flag[np.cumsum(size) - 1] = last
        last, word = flag, np.repeat(word, size)
    return (raw.astype(np.int64) + 256 * last)[word]


_MACHINES: dict[str, Transducer] = {}


def machine(name: str) -> Transducer:
    if name not in _MACHINES:
        _MACHINES[name] = Transducer(tokenizer_path(name))
    return _MACHINES[name]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 2048, batch_chars: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = machine(tokenizer)
        for b in batches:
            texts = [t or "" for t in b[text_col]]
            tokens, at = np.zeros(len(texts), np.int64), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= batch_chars):
                    chars += len(texts[to])
                    to += 1
                tokens[at:to] = tool.count(texts[at:to])
                at = to
            yield pd.DataFrame({"doc_id": b[id_col].astype("Int64"), "n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": tokens, "over_limit": tokens > limit})

    return docs.select(id_col, text_col).mapInPandas(each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
