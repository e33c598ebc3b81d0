"""Personal data: patterns, and a linear-chain conditional random field for what they miss.

The field labels tokens by features of their shape and their neighbours. It is trained on a small
labelled table that is written out below as forms and built with a fixed seed, by gradient steps on
the exact log-likelihood, and decoded by Viterbi in numpy batches. Tokens without a digit or an at
sign, written or spelled in brackets, are no data by definition, so the best path passes through
"nothing" there and a text falls apart into short chains that are decoded together. Spans it adds
touch no base span; base spans always stay. Neighbours are whole words of any length; a shape, in which
runs are shortened, is told by its first 24 signs. Only where nothing parts a run without spaces, the
part of an address before its at sign is looked for over the 64 characters that mail standards allow.

Defined cases: null or empty texts hold nothing; a pattern's failing match is dropped and not tried
again; very long runs of one character take linear time; repeated rows give repeated results; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.spans import Span, apart, digests

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["", *KINDS]
DIM = 1 << 13

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each at sign with the longest run before it that no earlier match holds, and a domain behind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def patterns(text: str) -> list[Span]:
    out = emails(text)
    if any(c in text for c in "0123456789"):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


TOKEN = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]|[(\[{](?:at|AT)[)\]}]")
EDGE = ".,;:!?\"'|*#$%&"


def shape(token: str) -> str:
    """Letters as x or X, digits as 9, runs shortened to two, other characters as they are."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_A-Z]", "x", re.sub(r"[A-Z]", "X", token)))
    return re.sub(r"(.)\1{2,}", r"\1\1", s)[:24]


def features(before: str, token: str, after: str) -> tuple[int, ...]:
    """Hashed facts about a token and its neighbours; those of ordinary length are remembered."""
    return _remembered(before, token, after) if len(before) + len(token) + len(after) < 400 else _features(before, token, after)


def _features(before: str, token: str, after: str) -> tuple[int, ...]:
    core = token.strip(EDGE)
    digits = re.sub(r"[^0-9]", "", core)
    other = len(core) - len(digits)
    names = [
        "bias", f"s={shape(core)}", f"p={before.strip(EDGE).lower()}", f"n={after.strip(EDGE).lower()}", f"ps={shape(before.strip(EDGE))}", f"ns={shape(after.strip(EDGE))}",
        f"d={min(len(digits), 20)}", f"o={min(other, 6)}", f"dots={min(core.count('.'), 5)}", f"dash={min(core.count('-'), 4)}", f"at={'@' in core}", f"sp={bool(re.search(r'[(\[{](?:at|dot)[)\]}]', core, re.I))}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)}", f"hex={bool(re.fullmatch(r'(?=.*[a-f])[0-9a-f]{16,}', core))}", f"par={core[:1] == '('}", f"pd={min(len(re.sub(r'[^0-9]', '', before)), 12)}", f"nd={min(len(re.sub(r'[^0-9]', '', after)), 12)}",
    ]
    return tuple(zlib.crc32(n.encode()) % DIM for n in names)


_remembered = lru_cache(100_000)(_features)

#: The labelled table: forms for each label. 9 stands for a digit, w for a word.
FORMS = {
    "phone": ["(999) 999-9999", "999-999-9999", "999.999.9999", "+9 (999) 999-9999", "+99 999 9999999", "0999 9999999", "(999)999-9999", "1-999-999-9999"],
    "email": ["w.99@w.w", "w@w9.w.w", "w[at]w.w", "w(at)w.w", "w.w(at)w.w", "w99[at]w[dot]w", "w@w.w"],
    "ip": ["999.99.9.99", "99.99.999.9:9999", "9.9.99.999/24", "999.999.99.99"],
    "card": ["9999-9999-9999-9999", "9999 9999 9999 9999", "9999999999999999"],
    "": ["9999", "99", "99.99", "9.9", "9.9.9", "99/99/9999", "9999-99-99", "99:99", "9,999", "99%", "v9.9", "$99.99", "9999999999999998", "9999999", "w9", "9w", "9999999999", "999999", "deadbeef99999999", "@w", "w@", "@", "99-99", "999-999", "[9]", "(9999)", "9.9.9.9.9.9", "#9999"],
}
CUES = {"phone": ["call", "tel", "phone", "fax", "mobile"], "email": ["mail", "contact", "email", "write"], "ip": ["ip", "host", "server", "address"], "card": ["card", "visa", "pay"], "": ["in", "page", "version", "on", "token", "order"]}
FILL = "the of and to in that it was for on with as be by this are or from at which".split()


def labelled_table(rows: int = 1500, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sentences of tokens with labels."""
    rng, out = random.Random(seed), []

    def word() -> str:
        return "".join(rng.choice(["th", "an", "er", "on", "re", "st", "le", "en", "a", "o", "mi"]) for _ in range(rng.randint(1, 4)))

    def filled(form: str, card: bool) -> str:
        while True:
            s = "".join(str(rng.randint(0, 9)) if c == "9" else word() if c == "w" else c for c in form)
            if not card or luhn(re.sub(r"[^0-9]", "", s)):
                return s

    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 4)):
                tokens.append(rng.choice([rng.choice(FILL), word()]))
                tags.append(0)
            label = rng.choice(["phone", "email", "ip", "card", "", "", "", ""])
            if rng.random() < 0.4:
                tokens.append(rng.choice(CUES[label]))
                tags.append(0)
            parts = filled(rng.choice(FORMS[label]), label == "card").split(" ")
            parts[-1] += rng.choice(["", "", "", ".", ","])
            tokens += parts
            tags += [LABELS.index(label)] * len(parts)
        for _ in range(rng.randint(1, 3)):
            tokens.append(word())
            tags.append(0)
        out.append((tokens, tags))
    return out


class Field:
    """A linear-chain conditional random field: unary weights by feature, and transitions."""

    def __init__(self) -> None:
        self.unary = np.zeros((DIM, len(LABELS)))
        self.step = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Padded unary scores, lengths, and feature ids; label 0 is forced where nothing is marked."""
        size = np.array([len(c) for c in chains])
        score = np.zeros((len(chains), int(size.max()), len(LABELS)))
        ids = []
        for i, c in enumerate(chains):
            f = np.array([features(c[j - 1] if j else "", c[j], c[j + 1] if j + 1 < len(c) else "") for j in range(len(c))])
            ids.append(f)
            score[i, : len(c)] = self.unary[f].sum(axis=1)
            free = np.array([bool(MARK.search(t)) for t in c])
            score[i, : len(c)][~free, 1:] = -1e4
        return score, size, ids

    def fit(self, table: list[tuple[list[str], list[int]]], epochs: int = 25, rate: float = 0.1, decay: float = 1e-4) -> "Field":
        rng = np.random.default_rng(3)
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(table)), max(1, len(table) // 64)):
                chains, tags = [table[i][0] for i in part], [table[i][1] for i in part]
                score, size, ids = self.scores(chains)
                node, edge = _marginals(score, size, self.step)
                gu, gt = np.zeros_like(self.unary), -edge
                for i, (f, y) in enumerate(zip(ids, tags, strict=True)):
                    diff = -node[i, : len(y)]
                    diff[np.arange(len(y)), y] += 1
                    np.add.at(gu, f.ravel(), np.repeat(diff, f.shape[1], axis=0))
                    np.add.at(gt, (y[:-1], y[1:]), 1)
                pace = rate / (1 + epoch / 5)
                self.unary += pace * (gu / 8 - decay * self.unary)
                self.step += pace * (gt / 64 - decay * self.step)
        return self

    def decode(self, chains: list[list[str]], cells: int = 1 << 16) -> list[np.ndarray]:
        """The best labels of every chain, by Viterbi over many chains in step: those of like lengths, some cells at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(chains)
        order, at = sorted(range(len(chains)), key=lambda i: len(chains[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(chains[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            part, at = order[at:end], end
            score, size, _ = self.scores([chains[i] for i in part])
            best, back = score[:, 0], np.zeros(score.shape, np.int8)
            last = best.argmax(axis=1)
            for t in range(1, score.shape[1]):
                path = best[:, :, None] + self.step
                back[:, t] = path.argmax(axis=1)
                best = path.max(axis=1) + score[:, t]
                last = np.where(size - 1 == t, best.argmax(axis=1), last)
            labels = np.zeros(score.shape[:2], np.int64)
            now, rows = last, np.arange(len(part))
            for t in range(score.shape[1] - 1, -1, -1):
                labels[:, t] = now
                # A chain's last label stands for all places after its end.
                now = np.where((0 < t) & (t < size), back[rows, t, now], now)
            for i, n, y in zip(part, size.tolist(), labels, strict=True):
                out[i] = y[:n]
        return out


def _marginals(score: np.ndarray, size: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, longest, k = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    live = np.arange(longest)[None, :] < size[:, None]
    alpha[:, 0] = score[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + score[:, t]
    for t in range(longest - 2, -1, -1):
        to = np.logaddexp.reduce(step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(live[:, t + 1, None], to, 0)
    total = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
    node = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
    edge = np.zeros((k, k))
    for t in range(1, longest):
        pair = alpha[:, t - 1, :, None] + step + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
        edge += np.exp(pair[live[:, t]]).sum(axis=0)
    return node, edge


@lru_cache(1)
def trained() -> Field:
    return Field().fit(labelled_table())


#: Runs without spaces that are longer than this are cut where no kind goes on, first at the first of these.
LONGEST = 120
CUTS = [
    re.compile(r"""["'`,;<>=&?|\\^~$#!*]|[^\x00-\x7f]|(?<![0-9]):|:(?![0-9])|[{\[](?!(?:at|dot)[}\]])|(?<![{\[]at)(?<![{\[]dot)[}\]]""", re.I),
    re.compile(r"[/:_]"),
]
#: Fixed value: characters that mail standards allow before an at sign.
LONGEST_LOCAL = 64
ESCAPE = re.compile(r"%([2-7][0-9A-Fa-f])")
AT = re.compile(r"@|[(\[{]at[)\]}]", re.I)
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[(\[{]dot[)\]}])[A-Za-z0-9-]+)*", re.I)
NUMBER = re.compile(r"(?<![0-9])(?<![0-9][().:/+-])[+(]?[0-9][0-9().:/+-]{5,}[0-9](?![().:/+-]?[0-9])")

#: A token, its start in the text or -1 for a neighbour, and the text's places of its run if that was decoded.
Entry = tuple[str, int, list[int] | None]


def unescaped(run: str) -> tuple[str, list[int]]:
    """The run with printable escapes such as %40 decoded, and where each character starts and the last one ends."""
    out, places, at = [], [], 0
    for m in ESCAPE.finditer(run):
        out.append(run[at : m.start()])
        places += range(at, m.start())
        out.append(chr(int(m[1], 16)).replace("\x7f", "\n"))
        places.append(m.start())
        at = m.end()
    return "".join(out) + run[at:], [*places, *range(at, len(run) + 1)]


def cut(run: str, level: int) -> str:
    """The run with line ends in place of what parts its pieces; places stay."""
    if level < len(CUTS):
        return CUTS[level].sub("\n", run)
    # Nothing parts it: addresses around at signs, and numbers of the length that the kinds have.
    out = ["\n"] * len(run)
    for m in AT.finditer(run):
        s, h = m.start(), HOST.match(run, m.end())
        while s > max(0, m.start() - LONGEST_LOCAL) and run[s - 1] in LOCAL_CHARS:
            s -= 1
        if h and s < m.start():
            out[s : h.end()] = run[s : h.end()]
    for m in NUMBER.finditer(run):
        out[m.start() : m.end()] = m[0]
    return "".join(out)


def word_before(text: str, at: int) -> list[str]:
    """The whole word before a place, if there is one, in a list."""
    reach = 64
    while True:
        first = max(0, at - reach)
        word = text[first:at].split()[-1:]
        # Whole where the text begins, or white space stands before it.
        if not first or (word and text[first:at].rstrip()[: -len(word[0])]):
            return word
        reach *= 4


def word_after(text: str, at: int) -> list[str]:
    """The whole word after a place, if there is one, in a list."""
    m = TOKEN.search(text, at)
    return [m[0]] if m else []


def chains(text: str, level: int = 0) -> list[list[Entry]]:
    """Marked tokens with their unmarked neighbours, cut where two unmarked tokens meet.

    level counts how often the text, a run without spaces, has been cut; line ends then part chains.
    """
    out: list[list[Entry]] = []
    end, last = -1, None
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, start).end()
        if end - start > LONGEST and level <= len(CUTS):
            run, places = unescaped(text[start:end]) if not level else (text[start:end], range(end - start + 1))
            places = [start + p for p in places]
            inner: dict[int, list[int]] = {}  # pieces of one run share its places
            parts = chains(cut(run, level), level + 1)
            for chain in parts:
                for _, s, at in chain:
                    if s >= 0 and at is not None and id(at) not in inner:
                        inner[id(at)] = [places[p] for p in at]
                out.append([(t, s, None if s < 0 else places if at is None else inner[id(at)]) for t, s, at in chain])
            continue
        left, right = word_before(text, start), word_after(text, end)
        if level:  # beyond a cut, a word may say what follows, a number does not go on
            left = [x for x in left if not MARK.search(x) or text[start - 1] != "\n"]
            right = [x for x in right if not MARK.search(x) or text[end] != "\n"]
        gap = text[last:start] if last is not None else None
        token = (text[start:end], start, None)
        if gap is not None and gap.isspace() and not (level and "\n" in gap):
            out[-1][-1:] = [token, (right[0] if right else "", -1, None)]
        else:
            out.append([(left[0] if left else "", -1, None), token, (right[0] if right else "", -1, None)])
        last = end
    return out


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans of one text, and those that the field adds."""
    return next(find_all([text], field))


def find_all(texts: list[str], field: Field, most: int = 1 << 22) -> Iterator[tuple[list[Span], list[Span]]]:
    """The same of each text, decoded together up to so many characters."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= most):
            held += len(texts[end])
            end += 1
        part, at = texts[at:end], end
        found = [chains(t) for t in part]
        labels = iter(field.decode([[t for t, _, _ in c] for chain in found for c in chain]))
        for text, own in zip(part, found, strict=True):
            yield labelled(patterns(text), own, [next(labels) for _ in own])


def labelled(base: list[Span], held: list[list[Entry]], decoded: list[np.ndarray]) -> tuple[list[Span], list[Span]]:
    """The base spans, and the labelled ones of the chains that touch none of them."""
    added: list[Span] = []
    for chain, labels in zip(held, decoded, strict=True):
        last = None
        for (token, start, places), label in zip(chain, labels, strict=True):
            if not label or start < 0:
                last = None
                continue
            lead = len(token) - len(token.lstrip(EDGE))
            s, e = start + lead, start + len(token.rstrip(EDGE))
            if places and e > s:
                s, e = places[s], places[e]
            number = LABELS[label] == "card" and sum(c.isdigit() for c in token) >= 12
            if last == label and not number:
                added[-1] = (added[-1][0], added[-1][1], e)
            elif e > s:
                added.append((LABELS[label], s, e))
            last = label
    return base, apart(added, base)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    field = docs.sparkSession.sparkContext.broadcast(trained())
    return digests(docs, lambda texts: find_all(texts, field.value), KINDS, KINDS, id_col, text_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
