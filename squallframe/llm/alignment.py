"""Tokens of two tokenizers aligned by the bytes they cover, with how often ids are linked in all texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from squallframe.llm.common import arrow_batches, materialize, table, tidied

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How byte-level BPE cuts a text into words (fixed value of the tokenizer).
BYTE_BPE_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Links after which a task closes a chunk of documents, and characters that are encoded in one go.
CHUNK_LINKS, ENCODED_CHARS = 2_000_000, 1 << 20
#: Texts with a run of as much white space go through the slower library, as the other one's regular expressions run out of stack there.
LONG_RUN = re.compile(r"\s{10000}")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class ByteBpe:
    """The vocabulary of a byte-level BPE file; ``pieces`` has each id's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.path, byte = path, byte_of_character()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f).get("added_tokens", [])}
        # ids of merges are in their order, so they are ranks
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_BPE_WORDS, mergeable_ranks={p: i for i, p in enumerate(self.pieces) if i not in special}, special_tokens={})

    @cached_property
    def other(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> list[int]:
        if LONG_RUN.search(text):
            return self.other.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceBpe:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def padded(pieces: int, mark: str) -> np.ndarray:
    """Each id in decimal with a mark behind it, and spaces in front."""
    width = len(str(pieces)) + 1
    return np.array([f"{i}{mark}".rjust(width).encode() for i in range(pieces)], f"S{width}")


class Aligner:
    """Two tokenizers and what alignment needs of their vocabularies."""

    def __init__(self, folder: str):
        self.a, self.b = ByteBpe(f"{folder}/{BYTE_BPE}"), PieceBpe(f"{folder}/{PIECE_BPE}")
        self.a_sizes, self.b_sizes = (np.array([len(p) for p in t.pieces], np.int64) for t in (self.a, self.b))
        n_a, n_b = len(self.a.pieces), len(self.b.pieces)
        self.dtype = np.uint16 if max(n_a, n_b) <= 1 << 16 else np.uint32
        width = len(str(max(n_a, n_b))) + 1
        self.written = {(side, mark): padded(n, mark).astype(f"S{width}") for side, n, mark in (("a", n_a, ","), ("a", n_a, "|"), ("b", n_b, ","), ("b", n_b, ";"))}

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both; none for empty texts and those whose tokens' bytes aren't those of a space and the text."""
        none = np.zeros(0, self.dtype)
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts]), strict=True):
            a = self.a.encode(f" {text}") if text else []
            data = f" {text}".encode()
            whole = text and b"".join(map(self.a.pieces.__getitem__, a)) == data == b"".join(map(self.b.pieces.__getitem__, b))
            out.append((np.array(a, self.dtype), np.array(b, self.dtype)) if whole else (none, none))
        return out

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elementary intervals between the ends of both: the A and the B token that own each, and whether both end with it.

        Tokens that overlap share one interval, as both are runs of bytes, so each interval is one link.
        """
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends)

    def pair_codes(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
        return a[own_a].astype(np.int64) * len(self.b.pieces) + b[own_b]

    def groups_text(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, shared: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group in decimal."""
        last_a, last_b = own_a[shared], own_b[shared]
        ends_a, ends_b = (np.zeros(len(x), bool) for x in (a, b))
        ends_a[last_a], ends_b[last_b] = True, True
        text_a = np.where(ends_a, self.written["a", "|"][a], self.written["a", ","][a])
        text_b = np.where(ends_b, self.written["b", ";"][b], self.written["b", ","][b])
        # a token's place: those of its side before it, and the other side's tokens of the groups before (for B also of its own)
        groups_a, groups_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before_a = np.concatenate([[0], last_b + 1])[groups_a]
        out = np.empty(len(a) + len(b), text_a.dtype)
        out[np.arange(len(a)) + before_a] = text_a
        out[np.arange(len(b)) + last_a[groups_b] + 1] = text_b
        return out.tobytes().replace(b" ", b"")[:-1]

    def group_products(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of an A and a B token of one group, overlapping or not: number of the group, A and B token."""
        own_a, own_b, shared = self.overlaps(a, b)
        edges_a, edges_b = (np.concatenate([[-1], x[shared]]) for x in (own_a, own_b))
        n_a, n_b = np.diff(edges_a), np.diff(edges_b)
        group = np.repeat(np.arange(len(n_a)), n_a * n_b)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
        return group, edges_a[group] + 1 + k // n_b[group], edges_b[group] + 1 + k % n_b[group]


@lru_cache(maxsize=1)
def aligner(folder: str) -> Aligner:
    return Aligner(folder)


def in_parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= ENCODED_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def align(docs: DataFrame, folder: str = TOKENIZERS, *, id_col: str = "doc_id", text_col: str = "text", products: bool = False) -> DataFrame:
    """Groups of tokens of each text: id_col, a_ids and b_ids, and of each link its group and the two tokens' numbers.

    With ``products`` all pairs of a group's tokens are given instead of those that overlap. Texts without tokens have
    empty arrays.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(folder)
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(1).to_pylist()):
                rows = []
                for a, b in both.encode(part):
                    own_a, own_b, shared = both.overlaps(a, b)
                    group, own_a, own_b = both.group_products(a, b) if products else (np.cumsum(shared) - shared, own_a, own_b)
                    rows.append([x.astype(np.int32) for x in (a, b, group, own_a, own_b)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(5))], names=[id_col, "a_ids", "b_ids", "link_group", "link_a", "link_b"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, a_ids array<int>, b_ids array<int>, link_group array<int>, link_a array<int>, link_b array<int>")


DIGEST = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
DIGEST_SQL = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def encoded(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (chunk, id, ids of both as compressed bytes, digest) and, after those of a chunk, a row of its pairs of ids and their counts."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, codes, held = aligner(folder), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            for part in in_parts(batch.column(1).to_pylist()):
                rows = []
                for a, b in both.encode(part):
                    own_a, own_b, shared = both.overlaps(a, b)
                    digest = hashlib.sha256(both.groups_text(a, b, own_a, own_b, shared)).hexdigest() if len(a) else ""
                    rows.append((number, pa.compress(a.tobytes(), codec="zstd", asbytes=True), pa.compress(b.tobytes(), codec="zstd", asbytes=True), len(a), len(b), int(shared.sum()), len(own_a), digest))
                    codes.append(both.pair_codes(a, b, own_a, own_b))
                    held += len(own_a)
                    if held >= CHUNK_LINKS:
                        yield documents(batch.column(0).slice(at, len(rows)), rows)
                        yield pairs(number, codes, batch.schema.field(0).type)
                        at, rows, codes, held, number = at + len(rows), [], [], 0, number + 1
                if rows:
                    yield documents(batch.column(0).slice(at, len(rows)), rows)
                    at += len(rows)
        if held:
            yield pairs(number, codes, batch.schema.field(0).type)

    names = ["chunk", id_col, "a", "b", *(n for n, _ in DIGEST), "codes", "counts"]

    def documents(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        chunk, a, b, *digest = zip(*rows, strict=True)
        none = pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), ids, pa.array(a, pa.binary()), pa.array(b, pa.binary()), *(pa.array(d, t) for d, (_, t) in zip(digest, DIGEST, strict=True)), none, none], names=names)

    def pairs(number: int, codes: list[np.ndarray], id_arrow: pa.DataType) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(codes), return_counts=True)
        packed = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (keys, counts)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, id_arrow), *(pa.nulls(1, pa.binary()),) * 2, *(pa.nulls(1, t) for _, t in DIGEST), *packed], names=names)

    return docs.select(id_col, text_col).mapInArrow(lambda batches: tidied(run(batches)), f"chunk bigint, `{id_col}` {id_type}, a binary, b binary, {DIGEST_SQL}, codes binary, counts binary")


def link_counts(docs: DataFrame, folder: str = TOKENIZERS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each text: n_a and n_b tokens, n_groups, n_links, n_best, count_sum and groups_sha256.

    A pair of ids counts its links in all texts. Tasks encode texts once, in chunks of documents that end after
    CHUNK_LINKS links, and count a chunk's pairs before anything is shuffled; Spark sums the pairs, finds the highest count of
    each B id (a table no longer than the vocabulary, so it is broadcast) and sends each chunk only the counts of its own pairs,
    so no task or executor holds the counts of all pairs.

    Edge cases: null and empty texts, and those that a tokenizer changes, have no tokens (zeros and an empty digest); strings of
    special tokens are plain text; equal texts have equal values and each counts; null and repeated ids are kept row by row; a
    very long text is a chunk of its own, held by one task; an empty table gives no rows; other columns are ignored.
    """
    with arrow_batches(docs.sparkSession, 1000):
        rows = materialize(encoded(docs, folder, id_col, text_col))
    pieces = len(aligner(folder).b.pieces)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, counts = (np.frombuffer(x, np.int64) for x in (codes, counts))
                for i in range(0, len(codes), 20_000):
                    part = codes[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int64)), pa.array(part), pa.array(counts[i : i + 20_000])], names=["chunk", "code", "n"])

    with arrow_batches(docs.sparkSession, 16):
        per_chunk = materialize(rows.where("codes IS NOT NULL").select("chunk", "codes", "counts").mapInArrow(spread, "chunk bigint, code bigint, n bigint"))
    totals = per_chunk.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b_id", F.col("code") % pieces)
    highest = F.broadcast(totals.groupBy("b_id").agg(F.max("n").alias("most")))
    totals = totals.join(highest, "b_id").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    wanted = per_chunk.select("chunk", "code").join(totals, "code")

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        both = aligner(folder)
        codes = counts.column("code").to_numpy()
        order = np.argsort(codes)
        codes, n, best = codes[order], counts.column("n").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, sums = [], []
        sizes = (docs.column(c).to_pylist() for c in ("a", "n_a", "b", "n_b"))
        for a, n_a, b, n_b in zip(*sizes, strict=True):
            a, b = (np.frombuffer(pa.decompress(x, k * np.dtype(both.dtype).itemsize, codec="zstd"), both.dtype) for x, k in ((a, n_a), (b, n_b)))
            own_a, own_b, _ = both.overlaps(a, b)
            at = np.searchsorted(codes, both.pair_codes(a, b, own_a, own_b))
            n_best.append(int(best[at].sum()))
            sums.append(int(n[at].sum()))
        ids = docs.column(id_col)
        return pa.Table.from_arrays([ids, *(docs.column(c) for c, _ in DIGEST), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())], names=[id_col, *(c for c, _ in DIGEST), "n_best", "count_sum"])

    texts = rows.where("codes IS NULL").select("chunk", id_col, "a", "b", *(c for c, _ in DIGEST))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {DIGEST_SQL}, n_best bigint, count_sum bigint"
    return texts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(score, schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
