"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a table of more rows than this is never broadcast
BROADCAST_ROWS = 200_000

#: words of texts split at ASCII white space
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: SQL for a table ``tbl`` of one row: the 256 steps of CRC-32, by its rule
CRC_TABLE_SQL = """tbl AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def join_counted(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``on``; ``small`` (cheap to read twice) is broadcast only if a
    count finds at most ``BROADCAST_ROWS`` rows, else it is an ordinary join
    that AQE splits where a key is hot."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, list(on), how)


def uniform(seed: int, *cols: Column) -> Column:
    """A repeatable number in (0, 1) from 52 bits of the columns' MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2 ** 52))


def fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as ''. """
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_state(key, make: Callable):
    """What ``make()`` gave for ``key``, kept by this worker process from task
    to task.  Task code is unpickled for each task with globals of its own, so
    it is held outside of them; a worker keeps one thing at a time, and none of
    the tables that ``worker_memo`` kept for the stage before."""
    import sys
    import types

    kept = sys.modules.setdefault("_terrascore_worker", types.ModuleType("_terrascore_worker"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.value = None, None
        kept.__dict__.pop("memo", None)
        give_back()
        kept.value = make()
        kept.key = key
    return kept.value


def drop_state() -> None:
    """Gives up what ``worker_state`` keeps; a task that needs none of it calls
    this, so that a stage doesn't hold what the one before has built."""
    import sys

    kept = sys.modules.get("_terrascore_worker")
    if getattr(kept, "value", None) is not None:
        kept.key, kept.value = None, None
        give_back()


def give_back() -> None:
    """Hands memory that Python and Arrow no longer use to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_memo(key, make: Callable):
    """Like ``worker_state`` for small tables, of which a worker keeps all."""
    import sys
    import types

    kept = sys.modules.setdefault("_terrascore_worker", types.ModuleType("_terrascore_worker")).__dict__.setdefault("memo", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
