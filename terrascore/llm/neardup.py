"""Near-duplicate classes by HyperMinHash.

Sketch.  A document is the set of its distinct five-word shingles (64-bit
hashes; with fewer words, the whole sequence is one shingle).  Each of 128
hash functions has a bucket that keeps the leading-zero count and ten
mantissa bits of the smallest hash: a 16-bit register.  (One function per
bucket rather than one hash split over buckets: the buckets of a short text
would be empty then, and bands of empty buckets lose links.)

Candidates.  Four registers packed into a long are a band.  Two sets of
similarity s share at least one of 32 bands with probability
1 - (1 - s^4)^32, at s = 0.75 all but 5 in a million.

Links.  Equal sets are one class, represented by its smallest doc_id, so a
group of copies is one vertex.  Every class in a bucket is first compared
with the bucket's smallest id.  What that leaves in different components is
then compared pair by pair, so no candidate link between components is left
out, while a large group of near copies, joined by its hub, is never
expanded into its pairs.  A pair must pass the collision-corrected estimate
of its similarity (with 0.25 to spare, over six standard errors) and then
the exact test on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.components import components
from terrascore.llm.shared import documents, drop_state, give_back, worker_memo
from terrascore.session import materialize

SHINGLE = 5
BANDS, ROWS = 32, 4
SIMILARITY = 0.75
SLACK = 0.25
CHUNK = 1 << 20  # bytes of text hashed at once
MANTISSA = 10
MARKS = 1 << 20  # words of 64 marks at most in the broadcast filter of ids

_U = np.uint64
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2^64
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made():
        rnd = np.random.default_rng(20)
        return (rnd.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1),
                rnd.integers(0, 1 << 63, n, dtype=np.uint64))

    return worker_memo(("dup-functions", n), made)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made():
        up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    # one table is kept; longer ones, for a text beyond CHUNK, are not
    return worker_memo(("dup-powers", n), made) if n <= CHUNK else made()


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end, the first byte of each text, -> a hash
    for each word and the place of each text's first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(starts), np.int64)
    low = _LOWER[data]
    word = ~_GAPS[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[starts[starts < n]] = False
    first = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = starts[(starts > 0) & (starts <= n)] - 1
    after[ends] = False
    last = np.flatnonzero(word & ~after)
    up, down = _powers(CHUNK if n <= CHUNK else 1 << int(n).bit_length())
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((low.astype(_U) + _U(1)) * up[:n], out=total[1:])
    hashes = _mix((total[last + 1] - total[first]) * down[first] + (last - first + 1).astype(_U))
    return hashes, np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct shingles of one document's word hashes, sorted."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, SHINGLE)
    h = words[:n - k + 1] + _U(k)
    for j in range(1, k):
        h = h * _BASE + words[j:n - k + 1 + j]
    return np.unique(_mix(h))


def registers(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash of each function."""
    a, b = _functions(n)
    least = np.full(n, ~_U(0))
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        step = max(1, 65536 // len(part))
        for i in range(0, n, step):
            least[i:i + step] = np.minimum(least[i:i + step],
                                           (part * a[i:i + step, None] + b[i:i + step, None]).min(axis=1))
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << MANTISSA) | bits.astype(np.uint16)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a string column: (first row, word hashes, places of the
    rows' first words and the end).  Nulls have no words."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        bounds = offsets[at:stop + 1]
        hashes, places = word_hashes(data[bounds[0]:bounds[-1]], bounds - bounds[0])
        yield at, hashes, places
        at = stop


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, set_key (16 bytes, the same for
    equal sets; NULL if empty), bands (array of longs)."""
    import hashlib

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_state()
        for batch in batches:
            sizes, keys, bands = [], [], []
            for _, hashes, places in _texts(batch.column(1)):
                for i in range(len(places) - 1):
                    s = shingle_hashes(hashes[places[i]:places[i + 1]])
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(registers(s).view("<i8") if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, shingles (sorted array of longs)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_state()
        for batch in batches:
            found = []
            for _, hashes, places in _texts(batch.column(1)):
                found += [shingle_hashes(hashes[places[i]:places[i + 1]]).view(np.int64)
                          for i in range(len(places) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))],
                                             names=["id", "shingles"])
        give_back()

    return docs.select("id", "text").mapInArrow(sets, "id long, shingles array<long>")


def _chance(n: int, m: int) -> float:
    """Chance that registers of different smallest hashes among 2^(n/2) and
    2^(m/2) agree."""
    return worker_memo(("dup-chance", n, m), lambda: _chance_of(n, m))


def _chance_of(n: int, m: int) -> float:
    zeros = np.arange(48)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    cell = [np.exp(2 ** (k / 2) * np.log1p(-low)) - np.exp(2 ** (k / 2) * np.log1p(-np.minimum(high, 1 - 1e-16))) for k in (n, m)]
    return float((cell[0] * cell[1]).sum())


def estimates(bands_a: np.ndarray, bands_b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of pairs of sketches."""
    same = (bands_a.view(np.uint16) == bands_b.view(np.uint16)).mean(axis=1)
    half = [np.round(2 * np.log2(np.maximum(x, 1))).astype(int) for x in (n, m)]
    chance = np.array([_chance(min(p), max(p)) for p in zip(*map(np.ndarray.tolist, half))])
    return (same - chance) / (1 - chance)


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose estimate comes
    within SLACK of it."""
    side = classes.select("id", "n_shingles", "bands")
    a = side.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bands").alias("ra"))
    b = side.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bands").alias("rb"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = [batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (4, 5)]
                likely = estimates(*flat, *(batch.column(i).to_numpy() for i in (2, 3))) >= similarity - SLACK
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(likely))

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb")
    return (joined.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
            .mapInArrow(keep, "a long, b long"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (id, text) of a written table of distinct ids.

    A join would shuffle every text to find a few.  So the ids are marked in
    at most MARKS words of 64 bits, which are broadcast and let through the
    wanted texts and few others; the exact join follows.  Were the words to
    fill up, more texts would be shuffled and the result stay the same."""
    hashed = F.xxhash64("id")
    word, bit = F.pmod(hashed, F.lit(MARKS)).alias("word"), F.shiftrightunsigned(hashed, 58).cast("int").alias("bit")
    marks = (ids.select(word, bit).groupBy("word")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    near = (texts.select("id", "text", word, bit).join(F.broadcast(marks), "word")
            .where(F.expr("shiftrightunsigned(mask, bit) & 1L = 1L")))
    return near.select("id", "text").join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    pairs = materialize(_likely(pairs, classes, similarity), "dup-likely")
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "dup-ids")
    sets = materialize(shingle_sets(_texts_of(docs, ids)), "dup-sets")
    per = F.lit(round(similarity * 100))
    x = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
         .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
         .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"),
                 (F.size("sa") + F.size("sb")).alias("sum")))
    return x.where(F.col("both") * 100 >= per * (F.col("sum") - F.col("both"))).select("a", "b").distinct()


def _prefix_pairs(open_: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Classes (id, label) -> pairs (a, b) of different labels, among them all
    that reach the similarity.

    Shingles are ordered by how many of these classes hold them, rarest
    first.  Two sets that reach it share one of their first n - s * n + 1
    shingles, and at the first shared one enough are left in both orders.
    Variants of one text hold their own changes first, so those too far from
    the text to be linked have no pair, however many they are.
    """
    sets = materialize(shingle_sets(_texts_of(docs, open_.select("id"))), "dup-open-sets")
    tokens = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    own = F.sort_array(F.collect_list(F.struct("df", "token")))  # a document's own shingles
    ranked = tokens.join(held, "token").groupBy("id", "n").agg(own.alias("all"))
    length = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    posts = materialize(ranked.join(open_, "id").select("id", "n", "label", F.posexplode(F.slice("all", F.lit(1), length)).alias("i", "x"))
                        .where("x.df > 1").select("id", "n", "label", "i", F.col("x.token").alias("token")), "dup-posts")
    x, y = posts.alias("x"), posts.alias("y")
    left = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    wanted = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9
    return (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") < F.col("y.label")) & (left >= wanted))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; a row for
    each row of ``docs``.

    Rows without words or text have an empty set and are linked with
    nothing.  Rows that share a doc_id are one document: a link of one is a
    link of all.  A NULL doc_id has a NULL component_id, takes part in no
    link and is kept.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketches(docs), "dup-sketches")
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # a class of equal sets is its smallest doc_id
    reps = materialize(linked.groupBy("set_key").agg(F.min("doc_id").alias("id")), "dup-reps")
    classes = materialize(linked.join(reps, (linked["set_key"] == reps["set_key"]) & (linked["doc_id"] == reps["id"]))
                          .select("id", linked["set_key"], "n_shingles", "bands").dropDuplicates(["set_key", "id"]), "dup-classes")

    bands = classes.select("id", F.posexplode("bands").alias("band", "key"))
    full = materialize(bands.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("top"))
                       .where("hub <> top").drop("top"), "dup-buckets")
    members = materialize(bands.join(full, ["band", "key"]), "dup-members")
    first = materialize(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "dup-first")
    links = _verified(first, classes, docs, similarity)
    # rows of one doc_id with several texts belong together
    several = (linked.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("lo"), F.max(F.xxhash64("set_key")).alias("hi"))
               .where("lo <> hi").select("doc_id"))
    same_id = (linked.join(several, "doc_id", "left_semi").join(reps, "set_key")
               .select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    links = materialize(links.unionByName(same_id), "dup-links")
    labels = components(links)

    # classes that share a bucket, not a component: all their links between components
    known = members.select("band", "key", "id", "hub").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = (known.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select("band", "key"))
    open_ = materialize(known.join(mixed, ["band", "key"]).select("id", "label").distinct(), "dup-open")
    rest = materialize(_prefix_pairs(open_, docs, similarity).join(first, ["a", "b"], "left_anti"), "dup-rest")
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, classes, docs, similarity))
        labels = components(links)

    named = reps.join(labels, "id", "left").select("set_key", F.coalesce("label", "id").alias("component_id"))
    key = F.coalesce("set_key", F.concat(F.lit("empty "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    out = (rows.withColumn("set_key", F.when(F.col("doc_id").isNotNull(), key)).drop("bands")
           .join(named, "set_key", "left")
           .withColumn("component_id", F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
