"""Importance resampling towards a target distribution.

A text's features are its runs of one to three words, hashed into buckets.
Bucket counts over the whole raw and target tables give an array of integer
gains (log ratio of smoothed shares); a text's weight is the sum of the gains
of its features.  Weights plus Gumbel noise from a hash of the id are scores,
whose highest are a draw without replacement.

Ranks come from a distributed radix sort from the least significant digit.
The key is the score, descending, then the id.  A pass reads rows in the order
of the last one, block by block, and counts each row's place among the rows
of its block and digit (a stable counting sort); prefix sums of the counts by
(digit, block) give where each block's rows of a digit start in the whole, and
so every row's destination.  Destinations deal the rows to the next pass.  High digits that all rows
share need no pass.  The histogram of the key's first digit, counted before,
tells which rows lie surely behind the draw; only the others are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.llm.shared import CRC_TABLE_SQL, documents, join_counted
from terrascore.session import materialize

BUCKETS = 10_000
SHARE, LEAST_WORDS, SEED = 5, 20, 42
DIGIT_BITS = 12
#: rows of a block, at most
BLOCK_ROWS = 1 << 20
#: bytes of text whose features are computed at once
CHUNK = 1 << 20
#: longest word whose shift is looked up; a longer one is read again
LONGEST = 64

# bytes of words stay, upper case becomes lower, all others become a space
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k with value b of a CRC-32 adds once n bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.empty((LONGEST + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 1):
        tables[n] = one[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
    return tables


def _shifted(tables: np.ndarray, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat, at = tables.reshape(-1), n * 1024
    out = flat[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def features(texts: list[str | None], tables: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of 1, 2 and 3 words: (CRC-32 of each run joined by spaces, the
    number of its text); and each text's number of words."""
    words: list[bytes] = []
    sizes = []
    for text in texts:
        found = text.encode().translate(_WORDS).split() if text else []
        words += found
        sizes.append(len(found))
    sizes = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    out, run = [(crc, owner)], crc
    space = np.uint32(zlib.crc32(b" "))
    long_ones = np.flatnonzero(length > LONGEST)
    for n in (2, 3):
        if len(run) < 2:
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            run = run[:0]
            continue
        # CRC of "run word" from those of the run and of the word that follows
        head = _shifted(tables, run[:-1], np.ones(len(run) - 1, np.int64)) ^ space
        more = _shifted(tables, head, np.minimum(length[n - 1:], LONGEST)) ^ crc[n - 1:]
        for i in long_ones[long_ones >= n - 1] - (n - 1):
            more[i] = zlib.crc32(words[i + n - 1], int(head[i]))
        inside = owner[n - 1:] == owner[:len(owner) - n + 1]
        out.append((more[inside], owner[n - 1:][inside]))
        run = more
    return out, sizes


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK or len(part) >= 4096:
            yield part
            part, size = [], 0
    if part:
        yield part


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the table's whole texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = shift_tables(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _chunks(batch.column(0).to_pylist()):
                for crc, _ in features(part, tables)[0]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for bucket, n in table.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # <= buckets rows
        counts[bucket] = n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), a long a bucket."""
    s_all, t_all, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(raw.astype(float), target.astype(float))], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_features, weight.  NULL and
    wordless texts have no features and weight 0."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # a long a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, gain = shift_tables(), sent.value.astype(float)
        for batch in batches:
            words, counts, weights = [], [], []
            for part in _chunks(batch.column(1).to_pylist()):
                found, sizes = features(part, tables)
                words.append(sizes)
                counts.append(sum(np.bincount(o, minlength=len(part)) for _, o in found))
                # sums of whole numbers: exact in doubles below 2^53
                weights.append(sum(np.bincount(o, gain[c % np.uint32(len(gain))], len(part)) for c, o in found).astype(np.int64))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x)) for x in (words, counts, weights)]],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths from a hash of the id (NULL as '')."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def _passes(rows: DataFrame, keys: list[str]) -> list[tuple[str, int]]:
    """(key, shift) of each digit, least significant first, below the bits
    that all rows share.  Keys are longs read as unsigned."""
    flip = F.lit(-(1 << 63))
    ends = rows.agg(*[f(F.col(k).cast("long").bitwiseXOR(flip)).alias(f"{k}{i}") for k in keys for i, f in enumerate((F.min, F.max))]).head()
    return [(k, s) for k in reversed(keys) if ends[f"{k}0"] is not None
            for s in range(0, _unsigned(ends[f"{k}0"] ^ ends[f"{k}1"]).bit_length(), DIGIT_BITS)]


def radix_places(rows: DataFrame, keys: list[str], blocks: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``_pos``: 0-based place in ascending order of ``keys``
    (longs read as unsigned, most significant first; not NULL).  Rows with
    equal keys keep the order in which they are read."""
    spark = rows.sparkSession
    rows = materialize(rows, "radix-rows")
    n = rows.count()
    blocks = max(blocks or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows))
    each = max(1, -(-n // blocks))
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_block", "_digit", "_local")]])
    passes = _passes(rows, keys) or [(keys[-1], 0)]
    placed = None
    for key, shift in passes:
        digit = F.shiftrightunsigned(F.col(key).cast("long"), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        first = placed is None
        if first:  # a task's rows are a block, in the order of the file
            dealt = rows.select(*names, digit.alias("_digit"), F.lit(0).cast("long").alias("_at"))
        else:
            dealt = (placed.select(*names, digit.alias("_digit"), F.floor(F.col("_pos") / each).alias("_at"), "_pos")
                     .repartition(blocks, "_at").sortWithinPartitions("_at", "_pos"))

        def count(batches: Iterator[pa.RecordBatch], first=first) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            seen, block = np.zeros(1 << DIGIT_BITS, np.int64), None
            for batch in batches:
                digits = batch.column(len(names)).to_numpy(zero_copy_only=False)
                at = np.full(len(digits), TaskContext.get().partitionId(), np.int64) if first else batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
                local = np.empty(len(digits), np.int64)
                edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(digits)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if block is None or at[a] != block:
                        seen[:], block = 0, at[a]
                    d = digits[a:b]
                    order = np.argsort(d.astype(np.uint16), kind="stable")
                    counts = np.bincount(d, minlength=len(seen))
                    starts = np.cumsum(counts) - counts
                    local[a + order] = np.arange(b - a) - starts[d[order]] + seen[d[order]]
                    seen += counts
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(at), batch.column(len(names)), pa.array(local)],
                                                 names=[*names, "_block", "_digit", "_local"])

        counted = materialize(dealt.mapInArrow(count, schema), "radix-counted")
        counts = materialize(counted.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n")), "radix-counts")
        # digits are few; a digit's blocks are
        before = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select("_digit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        start = (counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(base), "_digit")
                 .select("_digit", "_block", (F.col("_base") + F.col("_earlier")).alias("_start")))
        start = materialize(start, "radix-starts")
        placed = join_counted(counted, start, ["_digit", "_block"]).select(*names, (F.col("_start") + F.col("_local")).alias("_pos"))
    return placed


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """(doc_id, n_words, score, ...) -> the same rows and ``rank``: the
    floor(share * N / 100) highest scores of the N rows with at least
    ``least_words`` words have ranks from 1, all other rows NULL.  Ties go to
    the smaller doc_id, NULL last; rows with equal id and score take
    consecutive ranks."""
    # the highest score first: the complement of its unsigned form
    high = F.col("score").bitwiseXOR(F.lit(-(1 << 63)))
    keyed = (scored.withColumn("_score", F.bitwise_not(high)).withColumn("_no_id", F.col("doc_id").isNull().cast("long"))
             .withColumn("_id", F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0))))
    able = keyed.where(F.col("n_words") >= least_words)
    ends = able.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).head()
    k = share * ends["n"] // 100
    plain = [*scored.columns, F.lit(None).cast("long").alias("rank")]
    if k == 0:
        return scored.select(*plain)
    shift = max(0, (ends["high"] - ends["low"]).bit_length() - DIGIT_BITS)
    coarse = F.shiftrightunsigned(F.lit(ends["high"]) - F.col("score"), shift)
    left, last = k, None
    for row in able.groupBy(coarse.alias("d")).count().orderBy("d").collect():  # <= 2^DIGIT_BITS rows
        left, last = left - row["count"], row["d"]
        if left <= 0:
            break
    near = F.coalesce((F.col("n_words") >= least_words) & (coarse <= last), F.lit(False))
    placed = radix_places(keyed.where(near), ["_score", "_no_id", "_id"], **options)
    drawn = placed.select(*scored.columns, F.when(F.col("_pos") < k, F.col("_pos") + 1).alias("rank"))
    return keyed.where(~near).select(*plain).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS) -> DataFrame:
    """Texts (doc_id, text) and target texts (text) -> doc_id, n_words,
    n_features, weight, score, rank; a row for each row of ``docs``.  Other
    columns are not read; empty tables count as 0 features."""
    gains = bucket_gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    scored = weigh(docs, gains).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    return draw(materialize(scored, "resample-scored"), share, least_words)


def op13_resample(spark, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), target).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP13_SQL = rf"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_SQL}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_SQL}') AS w FROM benchmark),
f AS (SELECT r, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM d),
g AS (SELECT unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM b),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
k AS (SELECT f, xor(list_reduce([4294967295] || [('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT FOR i IN range(len(x) // 2)],
                                lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tbl),
fs AS (SELECT r, bucket, count(*) AS n FROM f JOIN k USING (f) GROUP BY r, bucket),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM fs GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fs JOIN gain USING (bucket) GROUP BY r),
z AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
             count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM o
"""
