"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn is ``open role header_end
text close`` with the template's three control strings, which are tokens of
their own.  Where a control string stands in a role or text an escape
character is put behind its first letter, and escape characters of the text
are doubled; so control strings mark turns and nothing else, and rendering
can be undone.  The rendered text is encoded once, with offsets; the sorted
spans of the turns to learn from meet the token spans by binary search, which
gives the loss mask.  No token straddles a span's end, since spans lie between
control tokens.

A conversation's turns come sorted to one task, which reads them as a stream.
One beyond ``PART_CHARS`` is rendered in several parts of whole turns; as each
turn starts with a control token, its tokens are those of the whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm.shared import worker_state

#: rendered characters after which a conversation goes on in another part
PART_CHARS = 1 << 21
#: tokens after which a batch of output is passed on
BATCH_TOKENS = 1 << 18

FORMATTED = ("conv_id long, part int, n_turns int, text string, ids array<int>, starts array<int>, stops array<int>, "
             "loss array<boolean>")


@dataclass(frozen=True)
class Template:
    """Control strings, strings that the tokenizer takes for its own special
    tokens (escaped as well), the escape character, and the roles to learn."""

    open: str = "[INST]"
    header_end: str = "[/INST]"
    close: str = "</s>"
    reserved: tuple[str, ...] = ("<|endoftext|>",)
    escape: str = "\u2060"
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = [self.open, self.header_end, self.close, *self.reserved]
        if any(len(m) < 2 or self.escape in m for m in marks) or len(self.escape) != 1 or len(set(marks)) < len(marks):
            raise ValueError("control strings differ, have two characters or more, and hold no escape character")
        if any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b)) if k < len(a)) or any(
                a != b and a in b for a in marks for b in marks):
            raise ValueError("no control string may start inside another")

    def compiled(self):
        """(what to escape, what to unescape, a turn)."""
        e = re.escape(self.escape)
        marks = [self.open, self.header_end, self.close, *self.reserved]
        special = "|".join([f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks] + [e])
        o, h, c = map(re.escape, (self.open, self.header_end, self.close))
        return re.compile(special), re.compile(f"{e}+"), re.compile(f"{o}(.*?){h}(.*?){c}", re.DOTALL)

    def escaped(self, text: str, special: re.Pattern) -> str:
        return special.sub(lambda m: m.group() + self.escape, text)

    def unescaped(self, text: str, runs: re.Pattern) -> str:
        # a doubled escape character stood in the text, a single one was put in
        return runs.sub(lambda m: self.escape * (len(m.group()) // 2), text)


def loss_mask(starts: np.ndarray, stops: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens [start, stop) meet one of the sorted, disjoint, non-empty
    spans (rows start, stop)."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")  # the first span that ends behind the token's start
    return (at < len(spans)) & (spans[np.minimum(at, len(spans) - 1), 0] < stops)


def _tokenizer(vocabulary: str, marks: list[str]):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_str(vocabulary)
    made.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in marks])
    return made


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def format_conversations(rows: DataFrame, template: Template | None = None, tokenizer_file: str | None = None,
                         part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, n_turns, text, ids,
    starts, stops, loss: a row per conversation, or several parts of a very
    long one, in order in one partition.

    Turns go by ``turn``, NULL first; equal ones by role and text, so repeated
    rows are turns that repeat.  NULL role or text is empty.  NULL conv_id is a
    conversation of its own.  An empty table gives no rows; other columns are
    not read.  ``starts`` and ``stops`` are the tokens' code point offsets in
    ``text``; ``loss`` holds for tokens of texts whose role is learned.
    """
    t = template or Template()
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = f.read()
    marks = [t.open, t.header_end, t.close]
    key = ("chat", zlib.crc32(vocabulary.encode()), *marks)
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)  # one file
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = narrow.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(key, lambda: _tokenizer(sent.value, marks))
        special = t.compiled()[0]
        out: list[tuple] = []

        def encoded(conv, part: int, pieces: list[str], spans: list[tuple[int, int]], n: int) -> None:
            text = "".join(pieces)
            got = coder.encode(text, add_special_tokens=False)
            where = np.array(got.offsets, np.int32).reshape(-1, 2)
            out.append((conv, part, n, text, np.array(got.ids, np.int32), where[:, 0], where[:, 1],
                        loss_mask(where[:, 0], where[:, 1], np.array(spans, np.int64).reshape(-1, 2))))

        def passed() -> pa.RecordBatch:
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()),
                      *[_lists(list(c), pa.int32()) for c in cols[4:7]], _lists(list(cols[7]), pa.bool_())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "n_turns", "text", "ids", "starts", "stops", "loss"])

        conv, part, pieces, spans, n, size, begun, tokens = None, 0, [], [], 0, 0, False, 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                new = not begun or c != conv
                if begun and (new or size >= part_chars):
                    encoded(conv, part, pieces, spans, n)
                    part, pieces, spans, n, size, tokens = part + 1, [], [], 0, 0, tokens + len(out[-1][4])
                    if tokens >= BATCH_TOKENS:
                        yield passed()
                        tokens = 0
                if new:
                    conv, part, begun = c, 0, True
                head = f"{t.open}{t.escaped(role, special)}{t.header_end}"
                body = t.escaped(text, special)
                if body and role in t.learn:
                    spans.append((size + len(head), size + len(head) + len(body)))
                pieces += [head, body, t.close]
                size += len(head) + len(body) + len(t.close)
                n += 1
        if begun:
            encoded(conv, part, pieces, spans, n)
        if out:
            yield passed()

    return turns.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What ``format_conversations`` gave -> conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, from the rendered text, the
    offsets and the mask alone.  Reads the rows as a stream; the parts of a
    conversation must follow each other in one partition, as they come."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, runs, turn = t.compiled()
        conv, begun, state = None, False, None

        def ended():
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([size])],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ids, parts, texts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, (c, part, text) in enumerate(zip(ids, parts, texts)):
                if part == 0:
                    if begun:
                        yield ended()
                    conv, begun, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in turn.finditer(text):
                    state[0] += 1
                    state[1].update(f"{t.unescaped(m[1], runs)}\n{t.unescaped(m[2], runs)}\n".encode())
                starts, stops, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (5, 6, 7))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))  # runs of learned tokens
                for a, b in zip(edge[::2], edge[1::2]):
                    learned = t.unescaped(text[starts[a]:stops[b - 1]], runs)
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
        if begun:
            yield ended()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: the conversation of the query whose texts hold the control strings themselves (fixed values)
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "cast(conv_id AS long) AS conv_id", "cast(turn AS long) AS turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))))


def _escaped_sql(col: str) -> str:
    """SQL for the length of a text after escaping: a character for each
    escape character and control string in it."""
    t = Template()
    marks = [t.open, t.header_end, t.close, *t.reserved, t.escape]
    return f"(length({col})" + "".join(f" + (length({col}) - length(replace({col}, '{m}', ''))) // {len(m)}" for m in marks) + ")"


OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(Template().open + Template().header_end + Template().close)} + {_escaped_sql('role')} + {_escaped_sql('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
