"""Hierarchical packing of documents into sequences of several lengths.

Documents are routed to tiers by length, tiers being powers of two up to the longest sequence.
Every tier is packed into sequences of its own size, longest first; a gap is filled by the largest
documents of the shorter tiers that fit, and closed by the first part of one more. A document
longer than a sequence fills whole ones first. Full sequences have no padding; what cannot fill
one any more is kept for the next round, and at the end of a task is cut into powers of two, so
that only a rest shorter than the least tier is padded.

Every task packs what it reads, in rounds of bounded size: nothing is shuffled, and no partition is
too large. Packing follows the order of rows in a partition, so a task that is run again gives the
same rows. Sequence ids hold the partition in their upper bits.

Step groups are dealt after packing: all partitions' sequences of one tier are counted through, so
that each group of a tier holds the same number of sequences, with one short group at most for each
tier. Groups of all tiers hold the same number of tokens.

Defined cases: a null or empty text is a document of the end id alone; very long texts are cut;
repeated rows are packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import workers
from graphloom.llm.keys import stored
from graphloom.llm.token_counts import TOKENIZER, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, nth long, ids binary"


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, remembered by word.

    White space separates words for this vocabulary, so a text's ids are its words' ids. New plain
    words are cut into pieces, which are far fewer; only pieces not met before are encoded. Other
    new words are encoded one by one. Texts with control characters that Python takes for white
    space and the library does not go to it whole.
    """

    odd = re.compile("[\x1c-\x1f]")
    #: Signs with one undoubted lower case, that no normal form changes or joins to a neighbour.
    plain = re.compile("[!-~\xa1-\xac\xae-įĲ-ňŊ-ž]+")
    #: Fixed value: the cut that the vocabulary's file names, on lower-case text.
    cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, most: int = 160 << 20):
        from tokenizers import Tokenizer

        #: Bytes that the two tables may take, by a rough count of 120 for an entry besides its word and ids.
        self.tool, self.most, self.known, self.pieces, self.held = Tokenizer.from_file(path), most, {}, {}, 0
        vocab = self.tool.get_vocab()
        #: Whether an id ends a piece.
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Keep the ids of new plain words; all their new pieces are encoded in one call."""
        parts = [self.cut.findall(w.lower()) for w in fresh]
        found: set[str] = set()
        found.update(*parts)
        new = [x for x in found if x not in self.pieces]
        ids = np.array(self.tool.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int64)
        edge = 4 * np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))
        raw = ids.astype("<u4").tobytes()
        self.pieces.update((x, raw[i:j]) for x, i, j in zip(new, edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        get = self.pieces.__getitem__
        self.known.update((w, b"".join(map(get, p))) for w, p in zip(fresh, parts, strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        words = [None if self.odd.search(t) else t.split() for t in texts]
        seen: set[str] = set()
        seen.update(*(w for w in words if w is not None))
        fresh = [w for w in seen if w not in self.known]
        self.held += sum(120 + 5 * len(w) for w in fresh)
        if self.held > self.most:
            self.known.clear()
            self.pieces.clear()
            fresh = list(seen)
            self.held = sum(120 + 5 * len(w) for w in fresh)
        if fresh:
            # Strings of added tokens are left to the library, with the word they stand in.
            easy = [w for w in fresh if "<|" not in w and self.plain.fullmatch(w)]
            self._learn(easy)
            self.known.update((w, self._whole(w)) for w in fresh if w not in self.known)
        get = self.known.__getitem__
        # A table that one call has filled beyond the bound goes with the call.
        if self.held > self.most:
            self.known, self.pieces, self.held = {}, {}, 0
        return [self._whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


def word_ids(name: str) -> WordIds:
    """One for each worker process, kept from task to task."""
    return workers.kept(name, lambda: WordIds(tokenizer_path(name)))


class Packer:
    """Packs documents, given as (id, ids as bytes), into sequences; yields rows of pieces."""

    def __init__(self, partition: int, longest: int = 4096, least: int = 64, keep_ids: bool = False):
        self.longest, self.least, self.keep_ids = longest, least, keep_ids
        self.tiers = [1 << k for k in range(least.bit_length() - 1, longest.bit_length())]
        self.next = partition << 33
        #: Sequences so far of each length.
        self.made: dict[int, int] = {}
        #: Waiting pieces by tier: (doc, start, ids, doc_tokens), shortest first.
        self.wait: dict[int, list] = {t: [] for t in self.tiers}
        self.tokens = 0

    def tier(self, n: int) -> int:
        return min(self.longest, max(self.least, 1 << (n - 1).bit_length()))

    def add(self, doc, ids: bytes) -> None:
        n, ids = len(ids) // 4, memoryview(ids)  # cutting copies nothing
        self.wait[self.tier(n)].append((doc, 0, ids, n))
        self.tokens += n

    def _take(self, tier: int, room: int):
        """The largest waiting piece of tiers up to this one that fits, or the start of one that doesn't."""
        for t in (t for t in reversed(self.tiers) if t <= tier and self.wait[t]):
            held = self.wait[t]
            if t // 2 >= room and t > self.least:
                continue
            lo, hi = 0, len(held)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if len(held[mid][2]) <= 4 * room else (lo, mid)
            if lo:
                return held.pop(lo - 1)
        for t in self.tiers:  # cut the shortest that is longer
            if self.wait[t]:
                held = self.wait[t]
                doc, start, ids, n = held.pop(0)
                rest = (doc, start + room, ids[4 * room :], n)
                to = self.wait[self.tier(len(rest[2]) // 4)]
                at = 0
                while at < len(to) and len(to[at][2]) < len(rest[2]):
                    at += 1
                to.insert(at, rest)
                return doc, start, ids[: 4 * room], n
        return None

    def _sequence(self, size: int, tier: int, out: list) -> None:
        offset, rows = 0, []
        while offset < size and (piece := self._take(tier, size - offset)):
            doc, start, ids, n = piece
            length = len(ids) // 4
            rows.append((doc, start, length, zlib.crc32(ids), n, offset, ids))
            offset += length
        # A power of two, which a full sequence and a short rest may be, needs no padding.
        padded = self.longest if offset & (offset - 1) else offset
        nth = self.made.get(padded, 0)
        self.made[padded] = nth + 1
        for doc, start, length, crc, n, at, ids in rows:
            out.append((doc, start, length, crc, n, self.next, at, padded, nth, bytes(ids) if self.keep_ids else None))
        self.next += 1
        self.tokens -= offset

    def pack(self, last: bool) -> list:
        """Sequences that can be filled now; at the last call, all that is left."""
        out: list = []
        for held in self.wait.values():
            held.sort(key=lambda p: len(p[2]))
        for tier in reversed(self.tiers):
            while self.wait[tier] and self.tokens >= tier:
                self._sequence(tier, tier, out)
        while last and self.tokens:
            size = next((t for t in reversed(self.tiers) if t <= self.tokens), self.least)
            self._sequence(size, self.longest, out)
        return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 2, longest: int = 4096, round_tokens: int = 1 << 20, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: where it comes from, its sequence and place, and its ids."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), longest, keep_ids=keep_ids)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, texts = b[id_col].astype("Int64").tolist(), [t or "" for t in b[text_col]]
            for at in range(0, len(texts), 256):
                for doc, coded in zip(ids[at : at + 256], ids_of(texts[at : at + 256]), strict=True):
                    packer.add(None if doc is pd.NA else int(doc), coded + end)
                    if packer.tokens >= round_tokens and (rows := packer.pack(False)):
                        yield _frame(rows)
        if rows := packer.pack(True):
            yield _frame(rows)

    return docs.select(id_col, text_col).mapInPandas(workers.thrifty(each, keeps=tokenizer), SCHEMA)


def with_step_groups(pieces: DataFrame, step_tokens: int = 1 << 20, small: int = 1_000_000) -> DataFrame:
    """Pieces with step_group in place of nth: groups of step_tokens tokens, padding included, of sequences of one length.

    Packing has numbered the sequences of each length within its partition; a few counts for each partition, which
    are summed up over partitions, shift these numbers, so pieces are neither sorted nor shuffled. The counts are
    broadcast up to so many rows.
    """
    part = F.shiftright("sequence_id", 33).alias("part")
    counts = pieces.where("offset = 0").select("sequence_length", part).groupBy("sequence_length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sequence_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = stored(counts.select("sequence_length", "part", before.alias("before")), "counts")
    shift = F.broadcast(shift) if shift.count() <= small else shift
    per = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("sequence_length")))
    group = F.floor((F.col("before") + F.col("nth")) / per) * 64 + F.round(F.log2(F.col("sequence_length").cast("double"))).cast("long")
    rest = [c for c in pieces.columns if c != "nth"]
    return pieces.withColumn("part", part).join(shift, ["sequence_length", "part"]).select(*rest, group.alias("step_group"))


def step_groups(pieces: DataFrame, step_tokens: int = 1 << 20) -> DataFrame:
    """Rows (sequence_id, step_group), one for each sequence."""
    return with_step_groups(pieces.where("offset = 0"), step_tokens).select("sequence_id", "step_group")


def pack_groups(docs: DataFrame, step_tokens: int = 1 << 20, **options) -> DataFrame:
    """The pieces of documents with their step groups; texts are tokenized once, and pieces written to the shared folder."""
    return with_step_groups(stored(pack_documents(docs, **options), "pieces"), step_tokens)


def _frame(rows: list) -> pd.DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pd.DataFrame({n: pd.array(c, dtype="Int64") if n == "doc_id" else list(c) if n == "ids" else np.array(c, np.int64) for n, c in zip(names, cols, strict=True)})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False).drop("ids")
