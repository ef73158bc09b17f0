"""Best-fit packing of tokenised documents, planned over a length histogram.

A document's ids, ended by one separator id, are cut into pieces of at most
``capacity`` ids (only longer documents have more than one piece).  The plan
needs only how many pieces have each length: lengths are taken in descending
order, and each run of equal pieces goes to the open sequences whose room
fits best, counts at a time.  Work and size of the plan depend on the
capacity, not on the number of documents.  Pieces then take the planned
slots by their rank within their length, which comes from range-partitioned
running counts, so a length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.shared import give_back, worker_state
from terrascore.operators.ranks import ordinal_rank
from terrascore.session import materialize

CAPACITY = 4096
SEPARATOR = 1
#: bytes of pieces and their ids, about, in each of the two halves of a worker's memo
MEMO_BYTES = 24 << 20
#: longest remembered piece
MEMO_WORD = 48
#: characters of text encoded at once
CHUNK = 1 << 20


class _Encoder(dict):
    """The tokenizer with a memo from a piece of a word to its ids; a word
    between white space has the ids of its pieces.

    The fast way holds for Latin text in NFC with plain white space and no
    special token: there the pre-tokenizer's split, made on the lower-cased
    text, gives pieces that hold no white space and whose ids don't depend on
    what stands around them.  Any other text goes to the tokenizer as a whole.
    """

    # the tokenizer's own split pattern for such text (fixed value)
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    OTHER = re.compile("[^\t-\r -\x7e\xa1-ɏ‐-‧]|<\\|")
    PLAIN = bytes([*range(9, 14), *range(32, 127)])  # what OTHER leaves of ASCII

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.model = self.whole.model
        self.latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # byte-level letters: printable bytes stand for themselves, the others for U+0100 onwards
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in plain)
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}
        self.size, self.older = 0, {}

    def __missing__(self, word: str) -> bytes:
        if not word.isalpha():  # the memo keeps pieces: a word and the same with a comma are one entry
            if word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]  # what no letter is stands alone
            pieces = (self.ASCII if word.isascii() else self.latin).findall(word)
            if len(pieces) > 1:
                return b"".join([self[p] for p in pieces])
        ids = self.older.get(word)
        if ids is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= MEMO_WORD:
            if self.size > MEMO_BYTES:  # pieces in use come back from the older half
                self.older, self.size = dict(self), 0
                self.clear()
            self[word] = ids
            self.size += 160 + len(word) + len(ids)  # with what Python adds to each
        return ids

    def plain(self, text: str) -> bool:
        if text.isascii():  # the same test, quicker
            return not text.encode().translate(None, self.PLAIN) and "<|" not in text
        return not self.OTHER.search(text) and unicodedata.is_normalized("NFC", text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, of which a chunk is read at a time.  The texts'
        words are split and made distinct by Arrow, so that the memo is asked
        once for each distinct word of a chunk."""
        for part in _chunks(texts):
            plain = [self.plain(t) for t in part]
            words = pc.ascii_split_whitespace(pa.array([t.lower() if ok else "" for t, ok in zip(part, plain)], pa.string()))
            coded = words.values.dictionary_encode()
            found = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
            flat = np.frombuffer(b"".join(found), "<u4")
            # a chunk has fewer than 2^31 ids, but for a single text beyond that
            kind = np.int32 if sum(map(len, part)) < 1 << 28 else np.int64
            sizes = np.fromiter(map(len, found), kind, len(found)) // 4
            at = coded.indices.to_numpy()
            length, first = sizes[at], (np.cumsum(sizes, dtype=kind) - sizes)[at]
            ends = np.concatenate([[0], np.cumsum(length, dtype=kind)]).astype(kind)
            # each word's ids in their place
            place = np.repeat(first - ends[:-1], length)
            place += np.arange(ends[-1], dtype=kind)
            blob = flat[place].tobytes()
            edges = (4 * ends[words.offsets.to_numpy()].astype(np.int64)).tolist()
            del words, coded, found, flat, sizes, at, length, first, ends, place
            for i, ok in enumerate(plain):
                yield blob[edges[i]:edges[i + 1]] if ok else array("I", self.whole.encode(part[i], add_special_tokens=False).ids).tobytes()


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoder(tokenizer_json: str) -> _Encoder:
    return worker_state(("packing", zlib.crc32(tokenizer_json.encode())), lambda: _Encoder(tokenizer_json))


def pieces(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY,
           separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if
    asked for, ids.  NULL and empty text is the separator alone."""
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_file, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    end = array("I", [separator]).tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            texts = (t.as_py() or "" for t in batch.column(1))  # a batch's texts are not all held twice
            for ids, doc in zip(coder.encode_all(texts), batch.column(0).to_pylist()):
                ids += end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out["doc_id"].append(doc)
                    out["piece"].append(i)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype("int32"))
            if not with_ids:
                del out["ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(out.values(), types)], names=list(out))
        give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
             pa.list_(pa.int32())]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, first
    sequence, pieces per sequence, offset).  Pieces of a length with ranks
    from ``first rank`` to the next row's fill consecutive sequences."""
    rows, room_of, rooms, n_seq = [], {}, [], 0  # rooms: sorted rooms that have open sequences

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in room_of:
                bisect.insort(rooms, room)
            room_of.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = room_of[room].pop()
                if not room_of[room]:
                    del room_of[room], rooms[at]
            else:
                room, first, n = capacity, n_seq, -(-left // (capacity // length))
                n_seq += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                put_back(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                rows.append((length, rank, first, each, capacity - room))
                put_back(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put_back(room, first, n)
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) -> + sequence_id, offset.

    Repeated rows are packed one by one; ties within a length go by doc_id,
    piece and checksum.  No rows give no rows."""
    ranked = materialize(ordinal_rank(materialize(parts, "pack-pieces"), ["doc_id", "piece", "ids_crc32"],
                                      ["length"], out="_rank"), "pack-ranked")
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}  # <= capacity rows
    rows = np.array(plan_slots(counts, capacity) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    # one number orders (length, rank): ranks are below the largest count
    width = max([1, *counts.values()])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    plan = parts.sparkSession.sparkContext.broadcast((rows[:, 0] * width + rows[:, 1], rows))
    names = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = plan.value
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False) - 1
            _, first_rank, first, each, offset = slots[np.searchsorted(keys, length * width + rank, "right") - 1].T
            nth = rank - first_rank
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first + nth // each), pa.array(offset + nth % each * length)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces packed with their ids -> one row per sequence: sequence_id, ids."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(part, lambda p: p["ids"])).alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
