"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the
toxic text's own vocabulary: words whose first letters (or which as a whole)
stand in toxic documents far more often than chance allows, by a likelihood
ratio over documents.  Windows of sixteen words are compressed with the
ordinary dictionary and with both; the bytes that the toxic one saves are
near 0 on ordinary text, since the common base cancels.  Each saving has a
log likelihood ratio, from its frequency in labelled toxic and ordinary
documents; a logistic regression on a document's sums of them, its mean and
its largest savings calibrates the score.

Both fits use a bounded sample of labelled rows (``FIT_DOCS``), drawn by a
hash of doc_id; near copies in it count once, as one much copied toxic text
would otherwise make its whole vocabulary suspicious.  Scoring reads every
text as a whole, in tasks that hold the dictionaries (33 KB).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.llm.shared import documents, fold, worker_state
from terrascore.session import materialize

#: labelled documents, at most, of each label in each of the two fits
FIT_DOCS = {1: 1500, 0: 3500}
THRESHOLD = 0.7
WINDOW = 16
#: bytes of the toxic dictionary at least, and for each unit; of the ordinary one
TOXIC_BYTES, UNIT_BYTES, ORDINARY_BYTES = 1024, 48, 32768
EVIDENCE = 16.0
#: words of a unit in the toxic dictionary's samples
FORMS = 40
WORD = re.compile(r"[^\W\d_]+")
LEAST, MOST = -4, 12  # savings beyond count as these


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(words: list[str]) -> list[bytes]:
    return [f" {' '.join(words[i:i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def _units(word: str) -> set[str]:
    return {word[:k] for k in (4, 5, 6, 7, 8) if len(word) >= k} | {word + " "}


def without_copies(rows: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Texts without their near copies: those of the same label that share three
    of four smallest hashes of five-word runs with one before.  A passage that
    two texts share makes neither a copy."""
    seen, left = set(), []
    for words, label in rows:
        runs = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
        sign = [min(zlib.crc32(f"{k} {r}".encode()) for r in runs) for k in range(4)]
        most = [(label, k, *sign[:k], *sign[k + 1:]) for k in range(4)]
        if not seen.intersection(most):
            left.append((words, label))
        seen.update(most)
    return left


def toxic_units(rows: list[tuple[list[str], int]]) -> set[str]:
    """Words and word beginnings over-represented in toxic documents."""
    seen = {0: Counter(), 1: Counter()}
    for words, label in rows:
        seen[label].update(set().union(*map(_units, set(words))))
    n = Counter(label for _, label in rows)
    p = n[1] / max(1, len(rows))
    found = set()
    for unit, a in seen[1].items():
        b = seen[0][unit]
        expected = (a + b) * p
        if a * max(1, n[0]) > 4 * (b + 0.5) * n[1] and len(unit) > 3:
            ratio = a * math.log(a / expected) + (b * math.log(b / ((a + b) * (1 - p))) if b else 0.0)
            if 2 * ratio > EVIDENCE:
                found.add(unit)
    return {u for u in found if not any(u[:k] in found for k in range(4, len(u)))}


def toxic_samples(rows: list[tuple[list[str], int]], units: set[str]) -> list[bytes]:
    """Training samples with every unit's commonest words as often as any
    other's, so that a common insult leaves room for the rest."""
    words: dict[str, Counter] = {u: Counter() for u in sorted(units)}
    for text, label in rows:
        for word in text if label else ():
            for u in _units(word) & units:
                words[u][word] += 1
    ranked = [[w for w, _ in c.most_common(FORMS)] for c in words.values()]
    return [f" {' '.join(w[i % len(w)] for w in ranked)} ".encode() for i in range(FORMS)] if ranked else []


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end serves as it is
        return b"".join(samples)[-size:]


def fit_dictionaries(rows: list[tuple[str | None, int]], toxic_bytes: int | None = None,
                     ordinary_bytes: int = ORDINARY_BYTES) -> tuple[bytes, bytes]:
    """Labelled texts -> (toxic, ordinary) dictionary.  The toxic one has room
    for the units found, the ordinary one is trained on all ordinary windows."""
    known = without_copies([(words_of(t), y) for t, y in rows])
    units = toxic_units(known)
    toxic = toxic_samples(known, units)
    ordinary = [x for w, y in known if not y for x in windows(w)]
    return (_dictionary(toxic_bytes or max(TOXIC_BYTES, UNIT_BYTES * len(units)), toxic) if toxic else b""), _dictionary(ordinary_bytes, ordinary)


def _compressors(toxic: bytes, ordinary: bytes):
    """The ordinary and the joint compressor, kept by the worker."""
    import zstandard as z

    def both():
        how = z.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=16,
                                          strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

        def made(data: bytes):
            known = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=known, compression_params=how)

        return made(ordinary), made(toxic + ordinary)

    return worker_state(("toxicity", len(toxic), zlib.crc32(toxic + ordinary)), both)


def savings(text: str | None, plain, both) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    a, b = plain.compress, both.compress
    return np.array([len(a(x)) - len(b(x)) for x in windows(words_of(text))], dtype=np.int64)


def features(saved: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """A document's savings -> what the regression reads."""
    if not len(saved):
        return np.zeros(6)
    r = ratios[np.clip(saved, LEAST, MOST) - LEAST]
    top = np.sort(saved)[::-1]
    return np.array([top[0], top[:3].mean(), saved.mean(), np.sign(r.sum()) * np.log1p(abs(r.sum())),
                     r.sum() / np.sqrt(len(r)), r.mean()])


def likelihood_ratios(saved: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of each saving's frequency in toxic and ordinary documents;
    a long document counts as 200 windows at most."""
    n = MOST - LEAST + 1
    counts = np.full((2, n), 0.5)
    for s, y in zip(saved, labels):
        if len(s):
            counts[y] += np.bincount(np.clip(s, LEAST, MOST) - LEAST, minlength=n) * min(1, 200 / len(s))
    share = np.log(counts / counts.sum(axis=1, keepdims=True))
    return share[1] - share[0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    hold = np.eye(z.shape[1]) * ridge * len(x)
    hold[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + hold, z.T @ (p - y) + hold @ w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _savings_table(docs: DataFrame, dictionaries) -> DataFrame:
    """(text, toxic) -> toxic, saved (array)."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, both = _compressors(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([savings(t.as_py(), plain, both) for t in batch.column(0)], pa.list_(pa.int64()))],
                names=["toxic", "saved"])

    return docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, "toxic int, saved array<long>")


def fit(docs: DataFrame, labels: DataFrame, fit_docs: dict[int, int] | None = None):
    """Labelled rows (doc_id, toxic) and their texts -> a model, or None when
    either label is missing."""
    bound = fit_docs or FIT_DOCS
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_draw", F.xxhash64(F.lit(10), "doc_id"))
    chosen = None
    for label, n in bound.items():
        some = known.where(F.col("toxic") == label).orderBy("_draw", "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = materialize(docs.select("doc_id", "text").where("doc_id IS NOT NULL")
                         .join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id"), "toxic-sample")
    rows = [(r["text"], int(r["toxic"])) for r in sample.orderBy("doc_id").select("text", "toxic").collect()]  # bounded
    if len({y for _, y in rows}) < 2:
        return None
    dictionaries = fit_dictionaries(rows)
    measured = _savings_table(sample.repartition(sample.sparkSession.sparkContext.defaultParallelism), dictionaries).collect()
    saved, y = [np.array(r["saved"], dtype=np.int64) for r in measured], np.array([r["toxic"] for r in measured])
    ratios = likelihood_ratios(saved, y)
    return dictionaries, ratios, *logistic(np.array([features(s, ratios) for s in saved]), y)


def score(docs: DataFrame, model, keep: Sequence[str] = ("doc_id",), out: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """(doc_id, text) -> doc_id, score, predicted; a row for each row.  NULL,
    empty and wordless texts get the score of a text that saves nothing;
    without a model every score is 0.  ``keep`` names the columns of ``docs``
    that go along instead of doc_id, ``out`` the two new ones."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(out[0]), F.lit(0).alias(out[1]))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read = [*keep, *(["text"] if "text" not in keep else [])]
    at, made = read.index("text"), [*keep, out[0]]
    kinds = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField(out[0], T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, ratios, weights, intercept = sent.value
        plain, both = _compressors(*dictionaries)
        for batch in batches:
            x = np.array([features(savings(t.as_py(), plain, both), ratios) for t in batch.column(at)]).reshape(-1, len(weights))
            logit = np.clip(x @ weights + intercept, -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(made) - 1], pa.array(1 / (1 + np.exp(-logit)))], names=made)

    return (docs.select(*read).mapInArrow(rate, kinds)
            .select(*made, (F.col(out[0]) >= THRESHOLD).cast("int").alias(out[1])))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
