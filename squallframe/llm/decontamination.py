"""Benchmark passages in training texts, found by an FM-index of each shard of texts."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import ASCII_UPPER, materialize, table, tidied

WINDOW = 10
#: Words of one shard, which is one index; longer texts go over several, overlapping by a window.
SHARD_WORDS = 500_000
#: Every so many positions of a shard are stored in its index.
SAMPLED = 8
#: Windows of benchmark items are sent to the tasks in blocks of about so many (window, item) pairs, one pass over the texts
#: each; a pair has at most WINDOW words, so a block's size is bounded.
BLOCK_PAIRS = 400_000

#: Bytes as words see them: A-Z as a-z; digits, a-z and all of non-ASCII characters as they are; else a space.
TO_WORDS = bytes(c + 32 if chr(c) in ASCII_UPPER else c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of symbols below 2**bits that end with a 0; 0s count as different, by their places.

    Suffixes are sorted by as many symbols as fit into 60 bits, then runs of equal ones by doubled lengths. As a
    comparison ends at the next 0, suffixes that are equal up to one are in order already.
    """
    n, width = len(text), max(1, 60 // bits)
    packed, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    for k in range(width):
        symbol = padded[k : k + n]
        packed = (packed << bits) | np.where(open_, symbol, 0)
        open_ &= symbol != 0
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | ~open_[order][1:]
    del packed, padded
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    length = width
    while True:
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        items = order[at]
        after = rank[np.minimum(items + length, n - 1)]
        again = np.lexsort((after, rank[items]))
        items, after = items[again], after[again]
        group = rank[items]
        order[at] = items
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        first[at] = new
        rank[items] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        length *= 2


class Bits:
    """Bits with ranks: ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits.astype(np.uint8), np.zeros(64 + -n % 64, np.uint8)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        inside = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6] + np.bitwise_count(inside)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet tree (kept level by level): how often a symbol occurs before a place, and what stands at one."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[Bits, int]] = []
        for k in range(bits - 1, -1, -1):
            ones = (symbols >> k) & 1 == 1
            self.levels.append((Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros_like(at)
        for k, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            s, a = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + a, at - a)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol


class FMIndex:
    """Counts and places of phrases in a text of symbols, where 0 ends runs of words and is in no phrase."""

    def __init__(self, text: np.ndarray, bits: int):
        order = suffix_order(text, bits)
        self.tree = Wavelet(text[order - 1], bits)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        # walks to the left end at the latest where a run of words begins, so they never cross a 0
        stored = (order % SAMPLED == 0) | (text[order - 1] == 0)
        self.stored, self.places = Bits(stored), order[stored]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (a row, right-aligned), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.below[-1])
        for k in range(1, phrases.shape[1] + 1):
            at = np.flatnonzero((lengths >= k) & (high > low))
            if not len(at):
                break
            symbol = phrases[at, -k].astype(np.int64)
            low[at], high[at] = self.below[symbol] + self.tree.rank(symbol, low[at]), self.below[symbol] + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, by steps to the left up to a stored one."""
        rows, steps, places = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = self.stored.get(rows[open_])
            done = open_[here]
            places[done] = self.places[self.stored.rank(rows[done])] + steps
            open_ = open_[~here]
            at = rows[open_]
            symbol = self.tree.get(at)
            rows[open_] = self.below[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return places


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(__window, __item): each different window of each item, its words joined by spaces; the item's id as a string."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1) if words else 0)}
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array([item.as_py()] * len(found), pa.string())], names=["__window", "__item"])

    chosen = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return materialize(chosen.mapInArrow(windows, "__window string, __item string").distinct())


class Phrases:
    """Different windows as rows of symbols (right-aligned), the words that the symbols stand for, and the items of each."""

    def __init__(self, pairs: pa.Table, window: int):
        windows = pairs.column("__window").combine_chunks().dictionary_encode()
        words = pc.split_pattern(windows.dictionary, " ")
        encoded = words.values.dictionary_encode()
        self.words, symbols = encoded.dictionary, encoded.indices.to_numpy().astype(np.int32) + 1
        self.bits = max(1, len(self.words).bit_length())
        self.lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
        self.rows = np.zeros((len(words), window), np.int32)
        self.rows[np.arange(window) >= window - self.lengths[:, None]] = symbols
        items = pairs.column("__item").combine_chunks().dictionary_encode()
        known = np.asarray(items.is_valid())
        of, item = windows.indices.to_numpy()[known], items.indices.filter(items.is_valid()).to_numpy()
        order = np.argsort(of, kind="stable")
        self.names, self.item_codes, self.item_ends = items.dictionary, item[order], np.searchsorted(of[order], np.arange(len(words) + 1))

    def symbols(self) -> dict[bytes, int]:
        return {w.as_buffer().to_pybytes(): k for k, w in enumerate(self.words, 1)}

    def items(self, phrase: int) -> list[str]:
        return self.names.take(pa.array(self.item_codes[self.item_ends[phrase] : self.item_ends[phrase + 1]], pa.int32())).to_pylist()


def search_shard(pieces: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """Row, first word, end and phrase of each occurrence in pieces (row, number of the first word, symbols).

    Words that no phrase has become 0, and runs of them one 0: no phrase can lie across one.
    """
    symbols = np.concatenate([x for _, _, s in pieces for x in (s, [0])]).astype(np.int32)
    rows = np.repeat(np.arange(len(pieces)), [len(s) + 1 for _, _, s in pieces])
    word = np.concatenate([np.arange(first, first + len(s) + 1) for _, first, s in pieces])
    kept = np.ones(len(symbols), bool)
    kept[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols, rows, word = symbols[kept], rows[kept], word[kept]
    index = FMIndex(symbols, phrases.bits)
    low, high = index.find(phrases.rows, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    if not len(which):
        return
    ends = np.cumsum(high - low)
    suffixes = np.arange(len(which)) - np.repeat(ends - (high - low), high - low) + low[which]
    places = index.locate(suffixes)
    owners = np.array([r for r, _, _ in pieces])
    yield from zip(owners[rows[places]].tolist(), word[places].tolist(), (word[places] + phrases.lengths[which]).tolist(), which.tolist(), strict=True)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(TO_WORDS))]
    parts, at = [], 0
    for first, end in spans:
        parts.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def _pass(df: DataFrame, phrases: Phrases, window: int, shard_words: int) -> DataFrame:
    """Add what one block of items finds to __n_words, __first, __end and __items."""
    sent = df.sparkSession.sparkContext.broadcast(phrases)
    names = df.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        symbols = phrases.symbols()
        held: list[pa.RecordBatch] = []
        pieces: list[tuple[int, int, np.ndarray]] = []
        counts: list[int] = []
        hits: dict[int, list[tuple[int, int, int]]] = {}
        words = 0

        def end_shard() -> None:
            nonlocal pieces, words
            if pieces and len(phrases.lengths):
                for row, first, end, phrase in search_shard(pieces, phrases):
                    hits.setdefault(row, []).append((first, end, phrase))
            pieces, words = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            end_shard()
            done = 0
            for batch in held:
                found = {c: batch.column(c).to_pylist() for c in ("__first", "__end", "__items")}
                for k in range(batch.num_rows):
                    if (own := hits.get(done + k)) is not None:
                        spans = merge_spans([*zip(found["__first"][k] or [], found["__end"][k] or [], strict=True), *((f, e) for f, e, _ in own)])
                        found["__first"][k], found["__end"][k] = [s[0] for s in spans], [s[1] for s in spans]
                        found["__items"][k] = sorted(set(found["__items"][k] or []).union(*(phrases.items(p) for p in {p for _, _, p in own})))
                new = {
                    "__n_words": pa.array(counts[done : done + batch.num_rows], pa.int64()), "__first": pa.array(found["__first"], pa.list_(pa.int64())),
                    "__end": pa.array(found["__end"], pa.list_(pa.int64())), "__items": pa.array(found["__items"], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)
                done += batch.num_rows
            held.clear()
            counts.clear()
            hits.clear()

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                for text in batch.column("__text"):
                    ids = np.fromiter(map(symbols.get, found := words_of(text.as_py()), itertools.repeat(0)), np.int32, len(found))
                    row = len(counts)
                    counts.append(len(ids))
                    for first in range(0, max(len(ids), 1), shard_words):
                        piece = ids[first : first + shard_words + window - 1]
                        if words + len(piece) > shard_words + window:
                            end_shard()
                        pieces.append((row, first, piece))
                        words += len(piece)
                held.append(batch)
                if words > shard_words // 2 or len(counts) > 50_000:
                    yield from emit()
        yield from emit()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lambda b: tidied(search(b)), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Add to each row n_words, spans (merged, as words first to end) and items (ids as sorted strings).

    The items' windows are made and told apart in Spark and sent in blocks of about ``block_pairs``, dealt by window and
    item, each searched for in one pass over all texts. Columns of these names are replaced.

    Edge cases: null, empty and word-less texts have no words and no hits; an item without words is in no text;
    one shorter than the window is one window; windows of items with null ids give spans but no items; repeated
    items count once, repeated rows each have their hits; empty tables give no rows or no hits; very long texts
    are searched whole; other columns, whatever their names, are passed on.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    df = docs.select(
        *keep, F.col(text_col).alias("__text"), F.lit(None).cast("long").alias("__n_words"), F.lit(None).cast("array<long>").alias("__first"),
        F.lit(None).cast("array<long>").alias("__end"), F.lit(None).cast("array<string>").alias("__items"),
    )
    pairs = item_windows(benchmark, item_col, item_text_col, window)
    blocks = pairs.count() // block_pairs + 1
    for block in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("__window", "__item"), F.lit(blocks)) == block)
        df = _pass(df, Phrases(part.toArrow(), window), window, shard_words)
    spans = F.transform(F.arrays_zip(F.coalesce("__first", F.array().cast("array<long>")).alias("first"), F.coalesce("__end", F.array().cast("array<long>")).alias("end")), lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end")))
    return df.select(*keep, F.col("__n_words").alias("n_words"), spans.alias("spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows with the merged spans of benchmark passages cut out of their texts; rows left without words go.

    Rows without hits stay as they are. The number of characters is set anew where a text is cut.
    """
    names = docs.columns
    # columns of the rows' own that have the names of what is found are set aside meanwhile
    aside = {c: f"__own_{c}" for c in ("n_words", "spans", "items") if c in names}
    found = find_leaks(docs.withColumnsRenamed(aside), benchmark, text_col=text_col, **options)
    found = found.select("*", F.col("spans").alias("__spans")).drop("n_words", "spans", "items").withColumnsRenamed({v: k for k, v in aside.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars, kept = batch.column(text_col).to_pylist(), batch.column(chars_col).to_pylist() if chars_col in names else None, [True] * batch.num_rows
            for k, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    texts[k] = cut_words(texts[k], [(s["first"], s["end"]) for s in spans])
                    kept[k] = bool(words_of(texts[k]))
                    if chars is not None:
                        chars[k] = len(texts[k])
            new = {text_col: pa.array(texts, pa.string())}
            if chars is not None:
                new[chars_col] = pa.array(chars, batch.column(chars_col).type)
            out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)
            yield out.filter(pa.array(kept, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.select(*names, "__spans").mapInArrow(lambda b: tidied(cut(b)), schema)


def op8_fm_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
