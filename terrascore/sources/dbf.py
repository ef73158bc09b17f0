"""dBase (.dbf) attribute tables as a Spark Python data source.

``spark.read.format("dbf").load(path)`` reads one file or a folder of
``.dbf`` files.  Records are fixed width, so every file is split into
record ranges (``recordsPerPartition``) that tasks read independently:
a task seeks to its first record and decodes its range column by column
into an Arrow batch.  The schema comes from the first file's field
descriptors (C -> string, N/F -> long or double, L -> boolean,
D -> date).

``df.write.format("dbf").save(folder)`` writes from Arrow batches,
column-wise: a task writes a part file for every ``recordsPerFile`` records
(strings sized to the file's longest value, integers with 0 decimals,
doubles in their shortest form that reads back as the same number), so it
holds one part at a time.  The parts are staged beside the table and
published when the job commits; an attempt that failed or was repeated leaves nothing in the table.
Files are opened through ``pyarrow.fs``, so the folder may be a local or
mounted path or a URI of shared storage (``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import datetime as _dt
import struct
import uuid

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.types import (BooleanType, DateType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)


def _fs(path: str):
    """(filesystem, path inside it) for a local path or a URI (file:,
    hdfs://, s3://, ...), so tasks read and write shared storage directly."""
    from urllib.parse import urlparse

    from pyarrow import fs

    u = urlparse(path)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), (u.path if u.scheme else path)
    return fs.FileSystem.from_uri(path)


def _is_remote(path: str) -> bool:
    from urllib.parse import urlparse

    return urlparse(path).scheme not in ("", "file")


def _files(path: str) -> list[str]:
    from pyarrow import fs

    f, p = _fs(path)
    info = f.get_file_info(p)
    if info.type == fs.FileType.Directory:
        sel = f.get_file_info(fs.FileSelector(p))
        names = sorted(i.path for i in sel if i.type == fs.FileType.File and i.path.lower().endswith(".dbf"))
        return [_rejoin(path, p, n) for n in names]
    return [path]


def _rejoin(orig: str, inner: str, child: str) -> str:
    """Child path in the same form as ``orig`` (remote URI) or a local path."""
    return orig.rstrip("/") + child[len(inner.rstrip("/")):] if _is_remote(orig) else child


def read_header(path: str):
    """(n_records, header_len, record_len, fields[(name, type, length, decimals, offset)])."""
    f, p = _fs(path)
    with f.open_input_file(p) as fh:
        head = fh.read(32)
        n, hlen, rlen = struct.unpack("<IHH", head[4:12])
        fields, off = [], 1  # byte 0 of a record is the deletion flag
        while True:
            d = fh.read(32)
            if not d or d[0] == 0x0D:
                break
            name = d[:11].split(b"\x00")[0].decode("ascii", "replace").strip()
            ftype = chr(d[11])
            length, dec = d[16], d[17]
            fields.append((name, ftype, length, dec, off))
            off += length
    return n, hlen, rlen, fields


def _spark_type(ftype: str, length: int, dec: int):
    if ftype == "C":
        return StringType()
    if ftype in ("N", "F"):
        return LongType() if dec == 0 and length <= 20 else DoubleType()
    if ftype == "L":
        return BooleanType()
    if ftype == "D":
        return DateType()
    return StringType()


#: records decoded at once
READ_RECORDS = 50_000


class DbfPartition(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        super().__init__((path, start, count))
        self.path, self.start, self.count = path, start, count


class DbfReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema = options, schema

    def partitions(self):
        per = int(self.options.get("recordsPerPartition", 250_000))
        parts = []
        for f in _files(self.options["path"]):
            n = read_header(f)[0]
            for s in range(0, n, per):
                parts.append(DbfPartition(f, s, min(per, n - s)))
        return parts or [DbfPartition("", 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        _, hlen, rlen, fields = read_header(partition.path)
        enc = self.options.get("encoding", "latin-1")
        f, p = _fs(partition.path)
        with f.open_input_file(p) as fh:
            fh.seek(hlen + partition.start * rlen)
            for left in range(partition.count, 0, -READ_RECORDS):
                yield self._decoded(fh.read(min(left, READ_RECORDS) * rlen), rlen, fields, enc)

    def _decoded(self, buf, rlen, fields, enc):
        import numpy as np
        import pyarrow as pa

        m = np.frombuffer(buf, dtype=np.uint8)[: (len(buf) // rlen) * rlen].reshape(-1, rlen)
        m = m[m[:, 0] != ord("*")]  # deleted records
        cols = []
        for (name, ftype, length, dec, off), fld in zip(fields, self.schema.fields):
            # one fixed-width byte string per record, decoded column-wise
            raw = np.ascontiguousarray(m[:, off:off + length]).view(f"S{length}").ravel()
            txt = np.char.strip(np.char.decode(raw, enc, "replace"))
            blank = txt == ""
            t = fld.dataType
            if isinstance(t, StringType):
                cols.append(pa.array(txt.astype(object), pa.string(), mask=blank))
            elif isinstance(t, (LongType, DoubleType)):
                bad = blank | (np.char.strip(txt, "*.") == "")
                vals = np.where(bad, "0", txt)
                if isinstance(t, LongType):
                    try:  # exact for all 64-bit values (no detour through float)
                        cols.append(pa.array(vals.astype(np.int64), pa.int64(), mask=bad))
                        continue
                    except (ValueError, OverflowError):
                        pass
                try:
                    num = vals.astype(np.float64)
                except ValueError:  # stray characters: parse value by value
                    num = np.array([_to_float(v) if not b else 0.0 for v, b in zip(vals, bad)], np.float64)
                    bad = bad | np.isnan(num)
                if isinstance(t, LongType):
                    cols.append(pa.array(num.astype(np.int64), pa.int64(), mask=bad))
                else:
                    cols.append(pa.array(num, pa.float64(), mask=bad))
            elif isinstance(t, BooleanType):
                first = np.char.upper(np.char.ljust(txt, 1).astype("U1"))
                val = np.isin(first, ["T", "Y"])
                cols.append(pa.array(val, pa.bool_(), mask=~(val | np.isin(first, ["F", "N"]))))
            elif isinstance(t, DateType):
                ok = np.char.str_len(txt) == 8
                c = np.ascontiguousarray(np.where(ok, txt, "19700101").astype("U8")).view("U1").reshape(-1, 8)
                part = [np.ascontiguousarray(c[:, a:b]).view(f"U{b - a}").ravel() for a, b in ((0, 4), (4, 6), (6, 8))]
                iso = np.char.add(np.char.add(np.char.add(np.char.add(part[0], "-"), part[1]), "-"), part[2])
                cols.append(pa.array(iso.astype("datetime64[D]"), pa.date32(), mask=~ok))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema.fields])


def _to_float(v: str) -> float:
    try:
        return float(v)
    except ValueError:
        return float("nan")


class DbfCommit(WriterCommitMessage):
    """The staged part files of a task that ended well."""

    def __init__(self, names: list[str], rows: int):
        self.names, self.rows = names, rows


def _fixed_width(values, width: int, right: bool):
    """Byte strings (numpy 'S') padded to ``width`` as an (n, width) uint8 block; longer ones are an error."""
    import numpy as np

    b = np.asarray(values)
    if len(b) and int(np.char.str_len(b).max()) > width:
        raise ValueError(f"a value needs more than the {width} bytes of its dBase field")
    b = b.astype(f"S{width}")
    b = np.char.rjust(b, width) if right else np.char.ljust(b, width)
    return np.frombuffer(b.tobytes(), dtype=np.uint8).reshape(-1, width)


def _encoded(fld, col) -> tuple[tuple[str, str, int, int], object]:
    """A column of one part -> (name, type, length, decimals), bytes block."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    t, n = fld.dataType, len(col)
    valid = pc.is_valid(col).to_numpy(zero_copy_only=False)
    if isinstance(t, StringType):
        txt = pc.fill_null(col, "").to_numpy(zero_copy_only=False).astype(str)
        enc = np.char.encode(txt, "latin-1")  # an unmappable character is an error
        w = max(int(np.char.str_len(enc).max()) if n else 1, 1)
        if w > 254:
            raise ValueError(f"{fld.name}: a dBase text field holds 254 bytes, a value has {w}")
        return (fld.name, "C", w, 0), _fixed_width(enc, w, right=False)
    if isinstance(t, (LongType, IntegerType)):
        ln, d, ftype = 20, 0, "N"
        txt = np.char.mod("%d", pc.fill_null(col, 0).to_numpy(zero_copy_only=False))
    elif isinstance(t, BooleanType):
        ln, d, ftype = 1, 0, "L"
        txt = np.where(pc.fill_null(col, False).to_numpy(zero_copy_only=False), "T", "F")
    elif isinstance(t, DateType):
        ln, d, ftype = 8, 0, "D"
        days = pc.fill_null(col.cast(pa.int32()), 0).to_numpy(zero_copy_only=False)
        txt = np.char.replace(days.astype("datetime64[D]").astype("U10"), "-", "")
    else:
        # a NaN is a missing value; the shortest form of a double has 24 characters at most
        ln, d, ftype = 25, 10, "N"
        num = col.cast(pa.float64())
        valid &= ~pc.fill_null(pc.is_nan(num), False).to_numpy(zero_copy_only=False)
        if pc.any(pc.is_inf(num)).as_py():
            raise ValueError(f"{fld.name}: a dBase number field holds no infinity")
        txt = pc.fill_null(num, 0.0).cast(pa.string()).to_numpy(zero_copy_only=False).astype(str)
    txt = np.where(valid, txt, "")
    return (fld.name, ftype, ln, d), _fixed_width(np.char.encode(txt.astype(str), "latin-1"), ln, right=(ftype == "N"))


class DbfWriter(DataSourceArrowWriter):
    """Arrow batches in; each column becomes a block of fixed-width bytes
    (numpy string operations) that is copied into the record buffer.

    Made on the driver; tasks write into a staging folder of the job, and
    ``commit`` moves the files of the attempts that Spark accepted."""

    def __init__(self, options, schema):
        self.options, self.schema = options, schema
        self.job = uuid.uuid4().hex

    def _places(self):
        fsys, inner = _fs(self.options["path"])
        return fsys, inner.rstrip("/"), f"{inner.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        long = [f.name for f in self.schema.fields if len(f.name.encode()) > 10]
        if long:
            raise ValueError(f"dBase field names have 10 bytes at most: {', '.join(long)}")
        fsys, _, staging = self._places()
        fsys.create_dir(staging, recursive=True)
        most = int(self.options.get("recordsPerFile", 100_000))
        names, total, held, size = [], 0, [], 0

        def part(table):
            name = f"part-{TaskContext.get().partitionId():05d}-{len(names):05d}-{uuid.uuid4().hex[:8]}.dbf"
            with fsys.open_output_stream(f"{staging}/{name}") as fh:
                for piece in self._file(table):
                    fh.write(piece)
            names.append(name)

        for batch in iterator:
            while batch.num_rows:
                some = batch.slice(0, most - size)
                batch = batch.slice(some.num_rows)
                held.append(some)
                size += some.num_rows
                total += some.num_rows
                if size >= most:
                    part(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            part(pa.Table.from_batches(held))
        return DbfCommit(names, total)

    def _file(self, table):
        """The bytes of a part file: header, records, end mark."""
        import numpy as np

        n = table.num_rows
        specs, blocks = zip(*[_encoded(f, c.combine_chunks()) for f, c in zip(self.schema.fields, table.columns)])
        rlen = 1 + sum(sp[2] for sp in specs)
        rec = np.full((n, rlen), ord(" "), dtype=np.uint8)
        off = 1
        for blk, sp in zip(blocks, specs):
            rec[:, off:off + sp[2]] = blk
            off += sp[2]
        today = _dt.date.today()
        yield struct.pack("<BBBBIHH20x", 3, today.year - 1900, today.month, today.day, n, 32 + 32 * len(specs) + 1, rlen)
        for nm, t, ln, d in specs:
            yield struct.pack("<11sc4xBB14x", nm.encode("ascii", "replace"), t.encode(), ln, d)
        yield b"\x0D"
        yield rec.tobytes()
        yield b"\x1A"

    def commit(self, messages):
        fsys, inner, staging = self._places()
        for m in messages:
            for name in m.names if m else ():
                fsys.move(f"{staging}/{name}", f"{inner}/{name}")
        self._drop(fsys, staging)

    def abort(self, messages):
        fsys, _, staging = self._places()
        self._drop(fsys, staging)

    def _drop(self, fsys, staging) -> None:
        from pyarrow import fs

        if fsys.get_file_info(staging).type == fs.FileType.Directory:
            fsys.delete_dir(staging)


class DbfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        files = _files(self.options["path"])
        _, _, _, fields = read_header(files[0])
        return StructType([StructField(n, _spark_type(t, ln, d), True) for n, t, ln, d, _ in fields])

    def reader(self, schema):
        return DbfReader(self.options, schema)

    def writer(self, schema, overwrite):
        return DbfWriter(self.options, schema)


def register_dbf(spark) -> None:
    spark.dataSource.register(DbfDataSource)
