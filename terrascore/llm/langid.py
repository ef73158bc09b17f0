"""Language identification with bit-sliced Bloom filters of n-grams.

A slot of the filter is a bit mask over languages: bit l is set when a
letter trigram that is typical of language l hashes to the slot.  The AND of
a trigram's three slots names all languages that hold it, in one look-up for
all of them.  A text's hits per language (popcounts of the masks' bits) are
corrected for the false positives that the fill of the language's slice
predicts, and the language with the most left wins.

A trigram is typical of the languages where it is at least ``TYPICAL`` times
as frequent as where it is most frequent.  The filters are fitted on a
bounded sample of labelled texts (``FIT_DOCS`` a language, drawn by a hash of
doc_id); prediction reads every text as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.llm.shared import documents, drop_state, fold, join_counted, worker_memo

#: labelled texts a language, at most, that the filters are fitted on
FIT_DOCS = 1000
TYPICAL = 0.25
HASHES = 3
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
CHUNK = 1 << 19  # characters looked up at once

_U = np.uint64


def _letters() -> np.ndarray:
    return worker_memo("letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letter trigrams of lower-cased texts, runs of other
    characters being one boundary, and how many each text has."""
    low = [f"\0{t.lower()}\0" if t else "\0" for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), sizes)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]          # the character after a letter: the boundary behind a word
    keep[:-1] |= letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1])  # before a word
    c, o = np.where(letter, points, 0)[keep].astype(_U), owner[keep]
    # the boundary behind a word and that before the next are one
    twice = np.zeros(len(c), bool)
    twice[1:] = (c[1:] == 0) & (c[:-1] == 0) & (o[1:] == o[:-1])
    c, o = c[~twice], o[~twice]
    if len(c) < 3:
        return np.zeros(0, _U), np.zeros(len(low), np.int64)
    inside = (o[2:] == o[:-2]) & ((c[:-2] > 0) | (c[1:-1] > 0))
    codes = (c[:-2] << _U(42)) | (c[1:-1] << _U(21)) | c[2:]
    return codes[inside], np.bincount(o[2:][inside], minlength=len(low))


def _slots(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = codes * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    step = (h * _U(0xBF58476D1CE4E5B9)) | _U(1)
    for i in range(HASHES):
        yield ((h + _U(i) * step) * _U(0x94D049BB133111EB)) >> _U(64 - bits)


class Filters:
    """Bit-sliced Bloom filters: ``masks`` has a row of 64-bit words per slot."""

    def __init__(self, languages: list[str], codes: np.ndarray, members: np.ndarray):
        self.languages = languages
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(codes)) * SLOTS_PER_GRAM))))
        words = -(-max(1, len(languages)) // 64)
        self.masks = np.zeros((words, 1 << self.bits), _U)
        for w in range(words):
            own = np.zeros(len(codes), _U)
            for i in range(64 * w, min(len(languages), 64 * w + 64)):
                own |= members[:, i].astype(_U) << _U(i - 64 * w)
            for slot in _slots(codes, self.bits):
                np.bitwise_or.at(self.masks[w], slot.astype(np.int64), own)
        fill = np.array([((self.masks[i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(languages))])
        self.false = fill ** HASHES

    def state(self) -> tuple:
        """Plain values, which a broadcast carries to workers without this class."""
        return self.languages, self.bits, self.masks, self.false

    @classmethod
    def of(cls, state: tuple) -> Filters:
        made = cls.__new__(cls)
        made.languages, made.bits, made.masks, made.false = state
        return made

    def hits(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Corrected number of each text's n-grams in each language."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((len(sizes), len(self.languages)))
        slots = [s.astype(np.int64) for s in _slots(codes, self.bits)]
        for w, masks in enumerate(self.masks):
            found = masks[slots[0]]
            for s in slots[1:]:
                found &= masks[s]
            for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                total = np.concatenate([[0], np.cumsum((found >> _U(i - 64 * w)) & _U(1), dtype=np.int64)])
                out[:, i] = total[ends[1:]] - total[ends[:-1]]
        return np.clip((out - sizes[:, None] * self.false) / (1 - self.false), 0, None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, sizes = grams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        hits = self.hits(codes, sizes)
        best = hits.argmax(axis=1)
        top = hits[np.arange(len(texts)), best]
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
        return names, np.where(sizes > 0, np.clip(top / np.maximum(sizes, 1), 0, 1), 0.0)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, typical: float = TYPICAL) -> Filters:
    """Labelled texts (doc_id, text, lang) -> filters; rows without text or
    lang are not used."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(4), "doc_id"), 12) / F.lit(float(1 << 52))
    # of a language's ids about twice as many as wanted lie below its bound, so its rank reads no more, however many rows it has
    bounds = known.groupBy("lang").agg((F.lit(2.0 * fit_docs + 100) / (F.approx_count_distinct("doc_id", 0.02) + F.lit(1))).alias("_bound"))  # a NULL id is one too
    near = (join_counted(known.select("doc_id", "lang", draw.alias("_draw")), bounds, ["lang"]).where(F.col("_draw") < F.col("_bound"))
            .select("doc_id", "lang", "_draw").distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id"))
    ids = near.withColumn("_r", rank).where(F.col("_r") <= fit_docs).select(F.col("doc_id").alias("_id")).distinct()
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                for part in _chunks([t for t, x in zip(batch.column(0).to_pylist(), langs) if x == lang]):
                    codes, n = np.unique(grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"])

    counts = (sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1"))
    table = counts.toPandas()  # trigrams of the bounded sample
    languages = sorted(set(table["lang"]))
    codes, where = np.unique(table["gram"].to_numpy(np.int64), return_inverse=True)
    rate = np.zeros((len(codes), len(languages)))
    rate[where, [languages.index(x) for x in table["lang"]]] = table["n"]
    rate /= np.maximum(rate.sum(axis=0), 1)
    return Filters(languages, codes.view(_U), (rate > 0) & (rate >= typical * rate.max(axis=1, keepdims=True, initial=0)))


def identify(docs: DataFrame, filters: Filters, keep: Sequence[str] = ("doc_id",),
             out: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score; a row for each row.
    ``keep`` names the columns of ``docs`` that go along instead of doc_id,
    ``out`` the two new ones.

    ``und`` with score 0 if a text is NULL or has no letter; ties go to the
    language that sorts first.  ``score`` is the share of the text's trigrams
    that the language holds, corrected for false positives.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters.state())
    read = [*keep, *(["text"] if "text" not in keep else [])]
    at, made = read.index("text"), [*keep, *out]
    kinds = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep]
                         + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_state()
        known = Filters.of(sent.value)
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for part in _chunks(batch.column(at).to_pylist()):
                n, s = known.predict(part)
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(made) - 2], pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                                             names=made)

    return docs.select(*read).mapInArrow(predict, kinds)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, filters).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
