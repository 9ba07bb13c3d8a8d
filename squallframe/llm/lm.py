"""Language-model scores from a log-frequency Bloom filter of word and word-pair counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.common import materialize, table

#: Words counted in one go in a task, and words scored in one go.
CHUNK_WORDS, SCORED_WORDS = 3_000_000, 1_000_000
#: The filter's size is BITS_PER_ENTRY for each entry. It has parts of about PART_BYTES, and neighbouring parts make blocks
#: of at most MAX_FILTER_BYTES, of which a task has one at a time.
BITS_PER_ENTRY, PART_BYTES, MAX_FILTER_BYTES = 20, 128 << 10, 64 << 20
#: Words whose exact counts are sent to all tasks; those of all others are joined.
MAX_FREQUENT = 1 << 18
#: Weight of a context's own count against the smoothing of its pairs.
PRIOR = 10.0

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Hash of the end of a text, which stands before its first word too. No word hashes to it but by chance.
END = xxhash.xxh3_64_intdigest(b" end ")
WORDS, PAIRS = 0, 1
PACKED = "kind int, bucket int, keys binary, counts binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + right)


class Vocabulary(dict):
    """Numbers of words in the order in which they are met; the end of a text is 0."""

    def __init__(self):
        super().__init__()
        self.hashes = [END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words and its end."""
        words = (text or "").encode().lower().split()
        return np.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), 0)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers (or the steps between ascending ones) byte by byte, the lowest bytes first, compressed without loss."""
    values = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    steps = np.diff(values, prepend=np.uint64(0)) if ascending else values
    planes = np.ascontiguousarray(steps.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) if ascending else steps.astype(np.uint64, copy=False)


def packed_counts(docs: DataFrame, text_col: str, bucket_bits: int) -> DataFrame:
    """Counts of all words (with ends) and of neighbouring pairs, summed over all texts, in buckets of their hashes.

    Tasks count in chunks; what is shuffled is one row of packed hashes and counts for each chunk and bucket.
    """

    def rows_of(kind: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        keys, counts = summed(keys, counts)
        edges = np.searchsorted(keys, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits)) if bucket_bits else np.zeros(0, np.int64)
        return [(kind, b, packed(k, ascending=True), packed(c)) for b, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges), strict=True)) if len(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Vocabulary(), [np.zeros(1, np.int64)], 0

        def chunk() -> pa.RecordBatch:
            ids, hashes = np.concatenate(held), np.array(words.hashes, np.uint64)
            out = rows_of(WORDS, hashes, np.bincount(ids[1:], minlength=len(hashes)))
            pairs, counts = np.unique((ids[:-1] << 32) | ids[1:], return_counts=True)
            out += rows_of(PAIRS, pair_keys(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF]), counts)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "keys", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(ids := words.numbers(text.as_py()))
                size += len(ids)
                if size >= CHUNK_WORDS:
                    yield chunk()
                    words, held, size = Vocabulary(), [np.zeros(1, np.int64)], 0
        if size:
            yield chunk()

    def merge(group: pa.Table) -> pa.Table:
        kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
        keys = np.concatenate([unpacked(x.as_py(), ascending=True) for x in group.column("keys")])
        counts = np.concatenate([unpacked(x.as_py()) for x in group.column("counts")]).astype(np.int64)
        keys, counts = summed(keys, counts)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "keys": pa.array([packed(keys, ascending=True)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})

    return docs.select(text_col).mapInArrow(count, PACKED).groupBy("kind", "bucket").applyInArrow(merge, PACKED)


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: n for counts from 2**n to below 2**(n + 1)."""
    return np.frexp(counts.astype(np.float64))[1] - 1


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of hashes."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class LogBloom:
    """Quantised counts of hashes: one of level n is entered n times, as (hash, 1) to (hash, n).

    A level is asked for by probing upwards until an entry is missing, so it is never too low and seldom too high.
    A hash's top bits choose its part of the filter; an entry sets up to four bits of one 64-bit word there.
    """

    def __init__(self, bucket_bits: int, words_per_part: int, first_part: int = 0, words: np.ndarray | None = None):
        self.bucket_bits, self.words_per_part, self.first_part = bucket_bits, words_per_part, first_part
        self.words = np.zeros(words_per_part << bucket_bits, np.uint64) if words is None else words

    def _probe(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.array([level], np.uint64) * _A)
        at = (part_of(keys, self.bucket_bits) - self.first_part) * self.words_per_part + ((h >> np.uint64(32)) % np.uint64(self.words_per_part)).astype(np.int64)
        mask = np.zeros(len(keys), np.uint64)
        for k in range(4):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return at, mask

    def enter(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            chosen = keys[levels >= level]
            if len(chosen):
                at, mask = self._probe(chosen, level)
                np.bitwise_or.at(self.words, at, mask)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        found, open_, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(open_) and level < 64:
            at, mask = self._probe(keys[open_], level)
            open_ = open_[(self.words[at] & mask) == mask]
            found[open_] = level
            level += 1
        return found


class BlockedBloom:
    """A filter in blocks of neighbouring parts, each broadcast by itself and held by a task only while it is asked."""

    def __init__(self, bucket_bits: int, words_per_part: int, parts_per_block: int, blocks: list):
        self.bucket_bits, self.words_per_part, self.parts_per_block, self.blocks = bucket_bits, words_per_part, parts_per_block, blocks

    def levels(self, keys: np.ndarray) -> np.ndarray:
        block = part_of(keys, self.bucket_bits) // self.parts_per_block
        found = np.zeros(len(keys), np.int64)
        for k, sent in enumerate(self.blocks):
            at = np.flatnonzero(block == k)
            if len(at):
                one = LogBloom(self.bucket_bits, self.words_per_part, k * self.parts_per_block, sent.value)
                found[at] = one.levels(keys[at])
                if len(self.blocks) > 1:
                    sent.__dict__.pop("_value", None)  # it is read again from the executor's file
        return found


def mean_count(levels: np.ndarray) -> np.ndarray:
    """The count that stands for an entered level, which is one more than its count's; 0.5 for what the filter doesn't hold."""
    return np.where(levels > 1, np.exp2(levels - 0.5), np.where(levels == 1, 1.0, 0.5))


class Model:
    """What tasks get: the filter (by itself), totals, and the exact counts of the most frequent words (sorted by hash)."""

    def __init__(self, bloom: BlockedBloom | None, tokens: int, types: int, pair_share: float, hashes: np.ndarray, counts: np.ndarray):
        self.bloom, self.tokens, self.types, self.pair_share = bloom, tokens, types, pair_share
        self.hashes, self.counts = hashes, counts

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        return mean_count(self.bloom.levels(hashes))

    def log10_pairs(self, left: np.ndarray, right: np.ndarray, left_counts: np.ndarray, right_counts: np.ndarray) -> np.ndarray:
        """Smoothed log10 probabilities of words after the ones before them, from hashes and quantised counts.

        A pair's share of its context is mixed with the word's own share; the pairs that occur more than once make up
        ``pair_share`` of all, which is what frequent contexts give to their pairs at most.
        """
        single = (right_counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        level = self.bloom.levels(pair_keys(left, right))
        share = np.where(level > 0, np.minimum(mean_count(level) / left_counts, 1.0), 0.0)
        weight = self.pair_share * left_counts / (left_counts + PRIOR)
        return np.log10(weight * share + (1 - weight) * single)


def train(
    docs: DataFrame, *, text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, max_frequent: int = MAX_FREQUENT, bits_per_entry: int = BITS_PER_ENTRY, part_bytes: int = PART_BYTES
) -> tuple[Model, DataFrame]:
    """The model of all texts, and a table (__h, __c) of the counts of the words that aren't in its exact part.

    The filter's layout comes from the counts alone, so it is the same whatever the partitions are, and has the same error
    at all sizes. Counts of all sizes are in it, from 1 on.
    """
    spark = docs.sparkSession
    bucket_bits = min(16, max(4, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))
    totals = materialize(packed_counts(docs, text_col, bucket_bits), drop_shuffles=True)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, counts in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                counts = unpacked(counts.as_py()).view(np.int64)
                levels = level_of(counts)
                n, total = np.bincount(levels), np.bincount(levels, counts)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(total.astype(np.int64))], names=["kind", "level", "n", "total"])

    table_ = totals.mapInArrow(histogram, "kind int, level int, n long, total long").groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    tokens = sum(r.total for r in table_ if r.kind == WORDS)
    types = sum(r.n for r in table_ if r.kind == WORDS)
    entries = sum(r.n * (r.level + 1) for r in table_)
    pair_share = sum(r.total for r in table_ if r.kind == PAIRS and r.level >= 1) / max(tokens, 1)
    filter_words = entries * bits_per_entry // 64 + 1
    part_bits = min(24, max(0, (8 * filter_words // part_bytes).bit_length()))
    per_part = -(-filter_words // (1 << part_bits)) * 9 // 8 + 8  # parts don't have quite the same number of entries
    parts_per_block = max(1, min(1 << part_bits, max_filter_bytes // (8 * per_part)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(2), batch.column(3), strict=True):
                keys, levels = unpacked(keys.as_py(), ascending=True), level_of(unpacked(counts.as_py())) + 1
                at = part_of(keys, part_bits)  # keys are sorted, and so are their parts
                for part in np.unique(at):
                    first, end = np.searchsorted(at, [part, part + 1])
                    one = LogBloom(part_bits, per_part, int(part), np.zeros(per_part, np.uint64))
                    one.enter(keys[first:end], levels[first:end])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([one.words.tobytes()], pa.binary())], names=["part", "words"])

    def joined(group: pa.Table) -> pa.Table:
        words = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint64) for x in group.column("words")])
        return pa.table({"part": group.column("part").slice(0, 1).combine_chunks(), "words": pa.array([words.tobytes()], pa.binary())})

    filter_parts = materialize(totals.mapInArrow(parts, "part int, words binary").groupBy("part").applyInArrow(joined, "part int, words binary"), drop_shuffles=True)
    blocks = []
    for first in range(0, 1 << part_bits, parts_per_block):
        words_of = np.zeros(per_part * min(parts_per_block, (1 << part_bits) - first), np.uint64)
        for r in filter_parts.where(F.col("part").between(first, first + parts_per_block - 1)).toLocalIterator():
            words_of[(r.part - first) * per_part : (r.part - first + 1) * per_part] = np.frombuffer(r.words, np.uint64)
        blocks.append(spark.sparkContext.broadcast(words_of))
    bloom = BlockedBloom(part_bits, per_part, parts_per_block, blocks)

    by_level = sorted((r for r in table_ if r.kind == WORDS), key=lambda r: -r.level)
    frequent, kept = 64, 0
    for r in by_level:
        if kept + r.n > max_frequent:
            break
        frequent, kept = r.level, kept + r.n

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(2), batch.column(3), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(keys.as_py(), ascending=True).view(np.int64)), pa.array(unpacked(counts.as_py()).view(np.int64))], names=["__h", "__c"])

    counts = totals.where(F.col("kind") == WORDS).mapInArrow(words, "__h long, __c long")
    often = counts.where(F.col("__c") >= float(2**frequent)).toPandas()
    hashes = often["__h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(bloom, tokens, types, pair_share, hashes[order], often["__c"].to_numpy(np.int64)[order])
    return model, counts.where(F.col("__c") < float(2**frequent))


def score_texts(docs: DataFrame, model: Model, rare: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of each row's whole text: id_col, n_tokens, n_known, base_score and score.

    Frequent words are looked up in the tasks. A row's other words are joined with their counts by hash, as a
    shuffle of about a tenth of all words.

    Edge cases: a null, empty or blank text has its end as only token; a word that training doesn't have counts 0;
    repeated rows and equal texts have equal scores; with an empty training table all counts are 0; an empty table
    gives no rows; null ids are kept; other columns are ignored, whatever their names.
    """
    # a broadcast can't hold other ones, so the filter's blocks go with the function
    bloom = model.bloom
    sent = docs.sparkSession.sparkContext.broadcast(Model(None, model.tokens, model.types, model.pair_share, model.hashes, model.counts))
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = chosen.schema["__id"].dataType.simpleString()
    bottom = model.tokens + 0.5 * (model.types + 1)

    def scored(ids: list, texts: list[np.ndarray], hashes: np.ndarray, model: Model) -> pa.RecordBatch:
        """Each word and each pair is looked up once."""
        exact, quantised = model.exact(hashes), model.word_counts(hashes)
        right = np.concatenate(texts)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        pairs, which = np.unique((np.concatenate([[0], right[:-1]]) << 32) | right, return_inverse=True)  # a text's first word comes after an end
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        log10 = model.log10_pairs(hashes[a], hashes[b], quantised[a], quantised[b])[which]
        base = np.where(exact > 0, np.log10((exact + 0.5) / bottom), 0.0)[right]
        others = [hashes[t[exact[t] == 0]].view(np.int64) for t in texts]
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.add.reduceat((exact[right] > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)),
            pa.array(np.add.reduceat(log10, starts)), pa.array(others, pa.list_(pa.int64())),
        ], names=["__id", "__n", "__known", "__base", "__score", "__others"])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        model.bloom = bloom
        words, ids, texts, size = Vocabulary(), [], [], 0
        for whole in batches:
            for k in range(whole.num_rows):
                texts.append(words.numbers(whole.column(1)[k].as_py()))
                ids.append(whole.column(0).slice(k, 1))
                size += len(texts[-1])
                if size >= SCORED_WORDS:
                    yield scored(ids, texts, np.array(words.hashes, np.uint64), model)
                    words, ids, texts, size = Vocabulary(), [], [], 0
        if texts:
            yield scored(ids, texts, np.array(words.hashes, np.uint64), model)

    rows = materialize(chosen.mapInArrow(scores, f"__id {kind}, __n long, __known long, __base double, __score double, __others array<long>"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())  # the checkpoint's rows keep their numbers
    others = rows.select("__row", F.explode("__others").alias("__word")).join(rare, F.col("__word") == F.col("__h"), "left")
    count = F.coalesce("__c", F.lit(0))
    sums = others.groupBy(F.col("__row").alias("__r")).agg(F.sum(F.log10((count + 0.5) / bottom)).alias("__more"), F.count_if(count > 0).alias("__more_known"))
    out = rows.drop("__others").join(sums, F.col("__row") == F.col("__r"), "left")
    return out.select(
        F.col("__id").alias(id_col), F.col("__n").alias("n_tokens"), (F.col("__known") + F.coalesce("__more_known", F.lit(0))).alias("n_known"),
        (F.col("__base") + F.coalesce("__more", F.lit(0.0))).alias("base_score"), F.col("__score").alias("score"),
    )


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0))
    model, rare = train(docs.where(fold != 1))
    scored = score_texts(docs, model, rare)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
