"""Near duplicates by Order MinHash sketches and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import WORD, arrow_batches, materialize, row_hash, table, tidied
from squallframe.llm.components import components, near_components

#: The least edit similarity of near duplicates, and words of a k-mer: with edits of a fifth of the words, spread evenly,
#: no five words in a row stay as they are, but two of five k-mers of three words do.
SIMILARITY, KMER = 0.8, 3
#: Sketches of a text; k-mers of a sketch. Texts that have I of U k-mers in common share a sketch with probability
#: C(I, 2) / C(U, 2) if those are in the same order: with edits of a fifth, spread evenly, 1/16, and one of all with 0.955.
SKETCHES, PER_SKETCH = 48, 2
#: Keys that two texts must share to be compared first. The last comparison takes all that share one.
LIKELY = 4
#: Pairs whose shorter text has at most so many words are found by segments, none of them missed, instead of sketches.
SHORT = 33
#: Counters of a text's words, and the bits of each. A counter's code goes round in twice as many steps as it has bits, and
#: each step turns one bit over, so an edit turns two bits at most.
COUNTERS, CODES = 1024, np.array([0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000], np.uint8)
#: Rounds of comparing texts with one of their buckets' largest classes. More of them save few of the last comparisons (a
#: second one 1,409 of 162,055 on check_h), and each takes a dozen shuffles.
PIVOT_ROUNDS = 1
#: Rows of a bucket for each of the parts into which it is dealt for the last comparison.
PART_ROWS = 2000
#: Rows that tasks exchange with Python at a time, which are as wide as texts or their sketches.
BATCH_ROWS = 1000
#: Words of a text for each diagonal of a band that is aligned by diagonals in one matrix, and the matrix's largest size.
DIAGONAL_WORDS, DIAGONAL_CELLS = 40, 20_000_000
#: Of texts of more words than this, only words with more than 1/512 of all places get a mask of those.
MASKED = 4096

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _A)


class WordHashes(dict):
    """64-bit hashes of words, the latest ones remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words := (text or "").encode().lower().split()), np.uint64, len(words))


def text_id(words: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64))


def kmer_hashes(words: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of all k-mers in order (one of all words, if they are fewer), each with its occurrence so far."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _A + words[j : j + n]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        place = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (place - first).astype(np.uint64)
        h = mix(h + occurrence * _B)
    return h


def order_sketches(words: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """A hash for each sketch: its smallest k-mers under the sketch's own order of hashes, in text order.

    Long texts are gone through in blocks, of which each sketch keeps its smallest k-mers.
    """
    h = kmer_hashes(words)

    def smallest(at: np.ndarray) -> np.ndarray:
        """Of places (a row of them for each sketch, or the same for all) the PER_SKETCH smallest, a row for each."""
        ranked = (h[at] ^ SEEDS[:, None]) * _B
        ranked ^= ranked >> np.uint64(32)
        ranked *= _C
        if ranked.shape[1] <= PER_SKETCH:
            return np.broadcast_to(at, ranked.shape)
        chosen = np.empty((SKETCHES, PER_SKETCH), np.int64)
        for k in range(PER_SKETCH):  # the smallest that isn't taken yet
            chosen[:, k] = ranked.argmin(axis=1)
            ranked[np.arange(SKETCHES), chosen[:, k]] = np.iinfo(np.uint64).max
        return np.take_along_axis(np.broadcast_to(at, ranked.shape), chosen, axis=1)

    kept = [smallest(np.arange(k, min(k + block, len(h)))) for k in range(0, len(h), block)]
    chosen = kept[0] if len(kept) == 1 else smallest(np.concatenate(kept, axis=1))
    keys = SEEDS.copy()
    for column in h[np.sort(chosen, axis=1)].T:
        keys = (keys ^ column) * _A
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def most_edits(n: int, similarity: float) -> int:
    """Edits that a text of n words may be from a shorter similar one."""
    return int((1 - similarity) * n + 1e-9)


@lru_cache(maxsize=None)
def segment_plan(m: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a text of m words has its segment keys: words of the longer text, segment, its words and its place.

    A text of n words is cut into one segment more than the edits it may be away, so a similar one that isn't longer
    has one of them unchanged. If it is the first one that fits, it is moved by no more than the segments before it,
    and seen from the end by no more than those behind it; so these are the places where the shorter text has keys.
    """
    out = set()
    if m - most_edits(m, similarity) <= SHORT:
        n = m
        while n - most_edits(n, similarity) <= m and (n == m or m <= SHORT):
            parts = most_edits(n, similarity) + 1
            edges = [n * i // parts for i in range(parts + 1)]
            for i in range(parts):
                start, size = edges[i], edges[i + 1] - edges[i]
                after = parts - 1 - i
                if m > SHORT:
                    places = [start]
                else:
                    places = range(max(0, start - i, start + m - n - after), min(m - size, start + i, start + m - n + after) + 1)
                out |= {(n, i, size, at) for at in places}
            n += 1
    return tuple(np.array([x[k] for x in sorted(out)], np.int64) for k in range(4))


def segment_keys(words: np.ndarray, similarity: float) -> np.ndarray:
    n, part, size, at = segment_plan(len(words), similarity)
    h = np.zeros(len(n), np.uint64)
    for k in np.unique(size):
        one = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            one = one * _A + words[j : j + len(one)]
        h[size == k] = one[at[size == k]]
    return np.unique(mix(mix(h + n.astype(np.uint64) * _B) + part.astype(np.uint64) * _C)).view(np.int64)


def word_bits(words: np.ndarray) -> bytes:
    codes = CODES[np.bincount((words % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) % len(CODES)]
    return (codes[::2] | codes[1::2] << 4).tobytes()


def bucket_keys(words: np.ndarray, similarity: float) -> np.ndarray:
    """Sketches of a text of more than SHORT words; segment keys of all that can be similar to a shorter one."""
    if len(words) <= SHORT:
        return segment_keys(words, similarity)
    keys = order_sketches(words)
    return np.concatenate([keys, segment_keys(words, similarity)]) if len(words) - most_edits(len(words), similarity) <= SHORT else keys


def _by_diagonals(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edits from a to b if they are at most ``band``, else null: how far each diagonal of the band gets with e edits."""
    n, m = len(a), len(b)
    a = np.append(a, -1)
    padded = np.concatenate([np.full(band, -2), b, np.full(max(0, n + 1 + band - m), -2)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, n + 1)[: 2 * band + 1]
    mismatches = np.flatnonzero(rows != a)  # those of diagonal k are from k * (n + 1); each has one at its end
    base = np.arange(2 * band + 1) * (n + 1)

    def slide(far: np.ndarray) -> np.ndarray:
        there = mismatches[np.searchsorted(mismatches, base + np.minimum(far, n))] - base
        return np.where(far < 0, far, there)

    never = -(1 << 40)
    far = np.full(2 * band + 1, never)
    far[band] = 0
    far = slide(far)
    for edits in range(band + 1):
        if edits:
            left, right = np.append(never, far[:-1]), np.append(far[1:], never)
            # a changed word and a dropped one take a word of a; an added one doesn't
            new = np.maximum(np.maximum(far, right) + 1, left)
            new[(new > n) | (new + np.arange(-band, band + 1) > m)] = never
            far = slide(np.maximum(new, never))
        if far[m - n + band] >= n:
            return edits
    return None


def _by_bits(a: list[int], b: list[int], band: int) -> int | None:
    """The same, column by column, with the differences down a column's band as bits of whole numbers."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    band = min(band, n)
    places: dict[int, list[int]] = {}
    for i, word in enumerate(a):
        places.setdefault(word, []).append(i)
    masks = {word: sum(1 << i + band for i in at) for word, at in places.items() if n <= MASKED or len(at) > n >> 9}
    full, last = (1 << 2 * band + 1) - 1, 1 << 2 * band
    # rows j - band to j + band of a column, from the lowest bit on: where its edits are one more, or one less, than in the row before
    more, less = (1 << band + 1) - 1 << band, 0
    edits, most = band, 2 * band + m - n  # of the band's last row
    for j, word in enumerate(b):
        if word in masks:
            same = masks[word] >> j & full
        else:
            same = sum(1 << i + band - j for i in places.get(word, ()) if j - band <= i <= j + band)
        free = (((same & more) + more ^ more) | same | less) & full  # no edit to the row and column before
        right, left = less | full ^ (free | more), free & more  # one more, or one less, than in the column before
        if j < n - band:
            edits += not free & last
            if edits > most:
                return None
        else:  # along the last word
            edits += (right >> n - 1 - j + band & 1) - (left >> n - 1 - j + band & 1)
        free >>= 1
        more, less = left | full ^ (free | right), free & right
    return edits if edits <= band else None


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The number of words to add, drop or change between two texts if it is at most ``most``, else null."""
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    # each word that one text has more often than the other takes an edit
    _, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(which[: len(a)], minlength=which.max() + 1) - np.bincount(which[len(a) :], minlength=which.max() + 1)
    least = max(int(more[more > 0].sum()), int(-more[more < 0].sum()))
    if least > most:
        return None
    band = max(8, least)
    if band < most and band * DIAGONAL_WORDS <= len(a) and (2 * band + 1) * (len(a) + 1) <= DIAGONAL_CELLS:
        found = _by_diagonals(which[: len(a)], which[len(a) :], band)
        if found is not None:
            return found
    which = which.tolist()
    return _by_bits(which[: len(a)], which[len(a) :], most)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether 1 - edits / words of the longer text is at least the similarity."""
    return edits_within(a, b, most_edits(max(len(a), len(b)), similarity)) is not None


def packed_words(words: np.ndarray) -> bytes:
    """32-bit hashes of a text's words, compressed, as some texts repeat a few words over and over."""
    return zstandard.compress((words >> np.uint64(32)).astype(np.uint32).tobytes(), 1)


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(words), np.uint32).astype(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __raw, __text): of each row its id, a hash of its text as it stands, and the text."""
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__raw"), F.col(text_col).alias("__text"))


def sketch(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(__id, __raw, __tid, __words, __keys) of each row; texts without words have null for the last three."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[str | None, tuple] = ("", (None, None, None))
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(2):
                text = text.as_py()
                if text != last[0]:
                    words = hashes.of(text)
                    last = (text, (text_id(words), len(words), bucket_keys(words, similarity)) if len(words) else (None, None, None))
                out.append(last[1])
            tid, n, keys = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tid, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["__id", "__raw", "__tid", "__words", "__keys"])

    chosen = keyed(docs, id_col, text_col)
    return chosen.mapInArrow(lambda b: tidied(rows(b)), f"__id {chosen.schema['__id'].dataType.simpleString()}, __raw long, __tid long, __words long, __keys array<long>")


def words_by_id(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__tid, __hashes, __bits) of wanted texts (__tid, and in __w a row that has it): packed_words and word_bits."""
    rows_of = wanted.select("__tid", F.col("__w.__id").alias("__wid"), F.col("__w.__raw").alias("__wraw"))
    chosen = keyed(docs, id_col, text_col).join(rows_of, (F.col("__raw") == F.col("__wraw")) & F.col("__id").eqNullSafe(F.col("__wid"))).select("__tid", "__text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [hashes.of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(packed_words, words), pa.binary()), pa.array(map(word_bits, words), pa.binary())], names=["__tid", "__hashes", "__bits"])

    return chosen.mapInArrow(lambda b: tidied(rows(b)), "__tid long, __hashes binary, __bits binary").dropDuplicates(["__tid"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts (__a, __b) are similar, with their other columns, all of them long."""
    names = pairs.columns
    left = texts.select(F.col("__tid").alias("__a"), F.col("__hashes").alias("__ha"))
    right = texts.select(F.col("__tid").alias("__b"), F.col("__hashes").alias("__hb"))
    both = pairs.join(left, "__a").join(right, "__b").select(*names, "__ha", "__hb")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(unpacked(a.as_py()), unpacked(b.as_py()), similarity) for a, b in zip(batch.column("__ha"), batch.column("__hb"), strict=True)]
            yield batch.select(names).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(lambda b: tidied(rows(b)), ", ".join(f"{c} long" for c in names))


def text_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(__id, __raw, __tid, __words, __keys) of each row, and (__t, __exact, __class) of each text that has words.

    The last two are the smallest rows (no_id, __id, __raw) of the equal texts and of the class.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _text_classes(docs, id_col, text_col, similarity)


def _text_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    sketches = materialize(sketch(docs, id_col, text_col, similarity), drop_shuffles=True)
    row = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__raw")
    texts = sketches.where("__tid is not null").groupBy("__tid").agg(F.min(row).alias("__w"), F.first("__words").alias("__words"), F.first("__keys").alias("__keys"))
    texts = materialize(texts, drop_shuffles=True)
    buckets = texts.select(F.explode("__keys").alias("__key"), "__tid")
    firsts = buckets.groupBy("__key").agg(F.min("__tid").alias("__b"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    crowded = materialize(buckets.join(firsts, "__key"), drop_shuffles=True)  # the rows of buckets with several texts
    star = crowded.where("__tid <> __b").groupBy(F.col("__tid").alias("__a"), "__b").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= LIKELY)
    wanted = crowded.select("__tid").distinct().join(texts.select("__tid", "__w"), "__tid")
    words = materialize(words_by_id(docs, wanted, id_col, text_col), drop_shuffles=True)
    links = materialize(verified(star.select("__a", "__b"), words, similarity), drop_shuffles=True)
    found = near_components(links, "__a", "__b")
    classes = crowded.select("__key", "__tid").join(found, F.col("__tid") == F.col("node"), "left").select("__key", "__tid", F.coalesce("component", "__tid").alias("__c"))
    for turn in range(PIVOT_ROUNDS + 1):
        classes = materialize(classes)  # it is read twice, for the sizes and for the rows
        # of each bucket where classes meet: its rows, its largest class, and one of that class's texts
        sizes = classes.groupBy("__key", "__c").agg(F.count(F.lit(1)).alias("__n"), F.max_by("__tid", F.xxhash64("__tid", F.lit(turn))).alias("__pivot"))
        mixed = sizes.groupBy("__key").agg(F.sum("__n").alias("__size"), F.count(F.lit(1)).alias("__classes"), F.max_by(F.struct("__c", "__pivot"), F.struct("__n", "__c")).alias("__m")).where("__classes > 1")
        meeting = materialize(classes.join(mixed.select("__key", "__size", F.col("__m.__c").alias("__main"), F.col("__m.__pivot").alias("__pivot")), "__key"), drop_shuffles=True)
        if turn == PIVOT_ROUNDS:
            break
        often = meeting.where("__c <> __main").groupBy("__tid", "__c", "__main", "__pivot").agg(F.count(F.lit(1)).alias("__n"))
        tries = often.groupBy(F.col("__tid").alias("__a"), F.col("__c").alias("__ca")).agg(F.max_by(F.struct("__pivot", "__main"), F.struct("__n", "__pivot")).alias("__p"))
        more = materialize(verified(tries.select("__a", F.col("__p.__pivot").alias("__b"), "__ca", F.col("__p.__main").alias("__cb")), words, similarity).select(F.col("__ca").alias("__a"), F.col("__cb").alias("__b")).distinct(), drop_shuffles=True)
        links = links.union(more)
        merged = near_components(more, "__a", "__b")
        classes = meeting.select("__key", "__tid", "__c").join(merged, F.col("__c") == F.col("node"), "left").select("__key", "__tid", F.coalesce("component", "__c").alias("__c"))

    cross = meeting_pairs(meeting, texts, words, similarity)
    last = materialize(verified(cross, words, similarity).select(F.col("__ca").alias("__a"), F.col("__cb").alias("__b")).distinct(), drop_shuffles=True)
    found = components(links.union(last), "__a", "__b")

    members = texts.join(found, F.col("__tid") == F.col("node"), "left").select("__tid", F.col("__w").alias("__exact"), F.coalesce("component", "__tid").alias("__c"))
    smallest = members.groupBy("__c").agg(F.min("__exact").alias("__class"))
    return sketches, members.join(smallest, "__c").select(F.col("__tid").alias("__t"), "__exact", "__class")


def meeting_pairs(meeting: DataFrame, texts: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(__a, __b, __ca, __cb): pairs of texts of different classes that share a bucket, but for those that can't be similar.

    A bucket's texts stand on two sides: those of all but its largest class, each in its band of lengths and in one of the
    parts into which a large bucket is dealt; and all, in each band that similar ones may be in, and in all parts. A task
    holds the first side of a part while the other one passes by; pairs that lengths and word_bits rule out go no further.
    """
    own = meeting.groupBy("__tid").agg(F.sort_array(F.collect_list("__key")).alias("__keys"))
    own = own.join(texts.select("__tid", "__words"), "__tid").join(words.select("__tid", "__bits"), "__tid")
    parts, band = F.ceil(F.col("__size") / PART_ROWS).cast("int"), lambda n: F.floor(F.log2(n)).cast("int")
    lengths = F.sequence(band(F.col("__words") * similarity - 1e-3), band(F.col("__words") / similarity + 1e-3))
    rest = ("__tid", "__c", "__main", "__words", "__keys", "__bits")
    rows = meeting.join(own, "__tid")
    one = rows.where("__c <> __main").select("__key", F.pmod(F.xxhash64("__tid"), parts).cast("int").alias("__part"), band(F.col("__words")).alias("__band"), F.lit(0).alias("__side"), *rest)
    other = rows.withColumn("__band", F.explode(lengths)).withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = one.union(other.select("__key", "__part", "__band", F.lit(1).alias("__side"), *rest))
    group = ("__key", "__part", "__band")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            at = np.array([batch.column(k).to_numpy() for k in range(4)])
            tid, c, main, n = (batch.column(k).to_numpy() for k in range(4, 8))
            bits = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint64).reshape(len(n), COUNTERS // 16)
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), len(n)] if len(n) else [0]
            out = []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                here = (tid[s:e], c[s:e], n[s:e], batch.column(8).slice(s, e - s), bits[s:e])
                if at[3, s] == 0:
                    first = (*here[:3], here[3], here[4]) if held != tuple(at[:3, s]) else tuple(pa.chunked_array([*(x.chunks if isinstance(x, pa.ChunkedArray) else [x]), y]) if k == 3 else np.concatenate([x, y]) for k, (x, y) in enumerate(zip(first, here, strict=True)))
                    held = tuple(at[:3, s])
                elif held == tuple(at[:3, s]):
                    out += not_ruled_out(first, here, main[s], at[0, s], similarity)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["__a", "__b", "__ca", "__cb"])

    return both.repartition(*group).sortWithinPartitions(*group, "__side").mapInArrow(lambda b: tidied(pairs(b)), "__a long, __b long, __ca long, __cb long")


def not_ruled_out(first: tuple, other: tuple, main: int, key: int, similarity: float) -> list[tuple]:
    """Pairs of a bucket's two sides (ids, classes, lengths, keys, bits) that may be similar, each from one bucket only."""
    (ta, ca, na, keys_a, bits_a), (tb, cb, nb, keys_b, bits_b) = first, other
    keys_a, keys_b, out = keys_a.to_pylist(), keys_b.to_pylist(), []
    step = max(1, (4 << 20) // bits_a.nbytes)
    for k in range(0, len(tb), step):
        b = slice(k, k + step)
        longer, apart = np.maximum(na[:, None], nb[b]), np.abs(na[:, None] - nb[b])
        most = np.floor((1 - similarity) * longer + 1e-9)
        open_ = (ca[:, None] != cb[b]) & ((cb[b] == main) | (ca[:, None] < cb[b])) & (apart <= most)
        x, y = np.nonzero(open_)
        # one text has (turned bits + difference of lengths) / 2 words more than the other has at the least
        turned = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 1 << 14):
            turned[i : i + (1 << 14)] = np.bitwise_count(bits_a[x[i : i + (1 << 14)]] ^ bits_b[k + y[i : i + (1 << 14)]]).sum(axis=1)
        near = turned + apart[x, y] <= 2 * most[x, y]
        # a pair is taken from the first of the buckets that it shares
        out += [(ta[i], tb[j], ca[i], cb[j]) for i, j in zip(x[near], k + y[near], strict=True) if shared_first(keys_a[i], keys_b[j]) == key]
    return out


def shared_first(a: list[int], b: list[int]) -> int:
    """The smallest number that two sorted lists have in common."""
    other = set(b)
    return next(x for x in a if x in other)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of rows that are linked by near-duplicate texts: id_col, class_id, exact_id and n_words.

    Texts are compared as sequences of words (white space, A-Z as a-z). Two texts are candidates if they share a
    sketch or, if one has at most SHORT words, a segment of words (which all similar ones do), and linked if aligning
    them takes edits of at most 1 - similarity of the longer one's words.
    Classes are the connected components of all such links; equal texts are one text from the start.

    No bucket's pairs are written out. Each text is first compared with the smallest one of each bucket that they
    share often enough. Then, for a few rounds, texts that aren't in the largest class of a bucket are compared with one of
    that class, which joins what belongs together by few comparisons; until then classes are only joined as far as one
    step shows. At last all candidates whose classes still differ are compared, in the buckets where classes meet, so
    that no link between classes is lost, and the components of all links found are taken.

    class_id and exact_id are the smallest ids of the class and of the equal texts. Edge cases: a row whose text is
    null or has no words is a class of its own, under its own id; texts of fewer than KMER words are compared by all
    of them as one k-mer; null ids are kept and are never the smallest, unless a class has no others; rows of one id
    with different texts are in the classes of their texts; repeated rows have the same class; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    sketches, named = text_classes(docs, id_col, text_col, similarity)
    out = sketches.select("__id", "__tid", "__words").join(named, F.col("__tid") == F.col("__t"), "left")
    return out.select(
        F.col("__id").alias(id_col), F.when(F.col("__t").isNull(), F.col("__id")).otherwise(F.col("__class.__id")).alias("class_id"),
        F.when(F.col("__t").isNull(), F.col("__id")).otherwise(F.col("__exact.__id")).alias("exact_id"), F.coalesce("__words", F.lit(0)).cast("long").alias("n_words"),
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id. Rows without words all stay.

    Rows are told apart by id and text, so where an id is repeated with different texts, each text is judged by its own
    class. A row with a null id is taken only from a class in which no row has an id. Of rows with the same id and text,
    the one with the smallest hash of all its columns stays; columns of map type don't count for it.
    """
    _, named = text_classes(docs, id_col, text_col, similarity)
    kept = named.select("__class").distinct().select(F.col("__class.__id").alias("__kept_id"), F.col("__class.__raw").alias("__kept_raw"))
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    rows = docs.where(has_words).select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__raw"), F.struct(*docs.columns).alias("__row"), row_hash(docs).alias("__all"))
    rows = rows.join(kept, (F.col("__raw") == F.col("__kept_raw")) & F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi")
    chosen = rows.groupBy("__raw", "__id").agg(F.min_by("__row", "__all").alias("__row")).select("__row.*")
    return chosen.unionByName(docs.where(~has_words))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
