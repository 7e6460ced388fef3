"""Many small Parquet files into few, by copying encoded blocks and rewriting footers."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.operators import file_footer as ff
from stratawave.operators.order import free, positions, running_sum
from stratawave.session import changes, cut, importable, shared_dir, whole_groups, whole_tables

TARGET_BYTES = 256 << 20
#: Bytes that one copy holds in memory, and bytes of a block that small blocks are joined to.
COPY_BYTES, JOINED_BYTES = 8 << 20, 16 << 20
#: What names a record, and what may differ between its copies.
RECORD, COPY = ("source_uri", "topic", "msg_id"), ("fragment_id", "received_at")
#: Ids whose blocks of 2 to this power meet in one task.
ID_BLOCK = 16
#: How blocks of fragments are encoded: pages without a dictionary stand for themselves.
ENCODED = {"compression": "snappy", "use_dictionary": False, "write_statistics": False, "store_schema": False}
PARTS = pa.schema([("topic", pa.string()), *((c, pa.int64()) for c in ("fragment_id", "held", "owned", "rows")), ("file", pa.string()), *((c, pa.int64()) for c in ("blocks", "bytes", "sources"))])
REPORT = "file string, schema_id string, sources long, blocks long, rows long, bytes long, refused string"


def filesystem(uri: str):
    """The file system of a path as Spark writes it, and the path within; such paths are not percent-encoded."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, path = rest.lstrip("/").partition("/")
    base, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return base, f"{root.rstrip('/')}/{path}"


def open_path(path: str):
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)


class Output:
    """A file under way.

    Blocks whose columns have no dictionary page are joined: pages stand for themselves, so the
    pages of many small blocks follow each other in one larger block, still encoded. Blocks
    with a dictionary are copied as they are. The metadata of finished blocks is kept encoded,
    so that millions of blocks need little memory.
    """

    def __init__(self, fs, final: str, footer: list, like):
        self.fs, self.final, self.footer, self.like = fs, final, footer, like
        self.ordered = ff.ordered_columns(footer)
        self.temporary = f"{final.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.out.write(ff.MAGIC)
        self.at, self.groups, self.rows, self.sources = 4, [], 0, 0
        self.joined: ff.Joined | None = None

    def add(self, handle, footer: list) -> None:
        """All blocks of an open file."""
        for row_group in ff.get(footer, 4, (ff.STRUCT, []))[1]:
            rows = ff.get(row_group, 3)
            if not rows:
                continue  # a block without rows may have no pages
            columns = ff.get(row_group, 1)[1]
            places = [ff.span(column) for column in columns]
            if any(ff.get(ff.get(column, 3), 11) for column in columns) or sum(n for _, n in places) > JOINED_BYTES:
                self.flush()
                offsets = []
                for start, left in places:
                    offsets.append(self.at)
                    self.copy(handle, start, left)
                self.groups.append(ff.encoded(ff.STRUCT, ff.moved(row_group, offsets, len(self.groups))))
                self.rows += rows
                continue
            pages = []
            for start, n in places:
                handle.seek(start)
                pages.append(handle.read(n))
            counts = [(ff.get(ff.get(column, 3), 5), ff.get(ff.get(column, 3), 6)) for column in columns]
            self.join(row_group, rows, pages, counts, [ff.get(ff.get(column, 3), 12) for column in columns])
        self.sources += 1

    def join(self, like: list, rows: int, pages: list, counts: list[tuple[int, int]], statistics: list | None) -> None:
        """Add one block's pages to the larger block under way; ``like`` is a block of the same kind, counts are values and uncompressed bytes by column."""
        if self.joined is None or not self.joined.takes(like):
            self.flush()
            self.joined = ff.Joined(like, self.ordered)
        self.joined.add(rows, pages, counts, statistics)
        self.rows += rows
        if self.joined.bytes >= JOINED_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.joined is None:
            return
        for pages in self.joined.pages:
            self.out.write(b"".join(pages))
        self.groups.append(ff.encoded(ff.STRUCT, self.joined.row_group(self.at, len(self.groups))))
        self.at += self.joined.bytes
        self.joined = None

    def copy(self, handle, start: int, left: int) -> None:
        self.at += left
        handle.seek(start)
        while left:
            piece = handle.read(min(left, COPY_BYTES))
            if not piece:
                raise ValueError(f"a source of {self.final} ends within a block")
            self.out.write(piece)
            left -= len(piece)

    def close(self) -> int:
        """Write the footer, hold what was written against the sources, and move the file into place; its size."""
        import pyarrow.parquet as pq

        self.flush()
        ff.put(self.footer, 3, ff.I64, self.rows)
        ff.put(self.footer, 4, ff.LIST, ff.encoded_list(ff.STRUCT, self.groups))
        tail = ff.encoded(ff.STRUCT, self.footer)
        self.out.write(tail + struct.pack("<I", len(tail)) + ff.MAGIC)
        self.out.close()
        with self.fs.open_input_file(self.temporary) as handle:
            found = pq.read_metadata(handle)
        counted = sum(found.row_group(i).num_rows for i in range(found.num_row_groups))
        if not found.schema.equals(self.like) or found.num_row_groups != len(self.groups) or counted != self.rows or found.num_rows != self.rows:
            raise ValueError(f"the blocks written to {self.final} do not match their sources")
        if self.fs.get_file_info(self.final).is_file:  # of an attempt that was lost
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
        return self.at + len(tail) + 8


def copy_blocks(sources: Iterable[tuple[str, object]], name, out_dir: str, opened=open_path) -> Iterator[dict]:
    """Write the blocks of ``sources`` (name, and what ``opened`` opens) to one file for each schema among them.

    Sources are read once and one at a time. A file is written under a temporary name and
    moved into place, so that a task that runs again replaces its own output. What was
    written is read back, and its schema, blocks and rows are held against the sources'.
    """
    import pyarrow.parquet as pq

    fs, root = filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    outputs: dict[bytes, Output] = {}
    for label, source in sources:
        try:
            with opened(source) as handle:
                footer = ff.read_footer(handle)
                schema = ff.schema_of(footer)
        except (ValueError, IndexError, struct.error) as wrong:
            yield {"file": label, "schema_id": None, "sources": 1, "blocks": 0, "rows": 0, "bytes": 0, "refused": str(wrong)}
            continue
        with opened(source) as handle:
            if schema not in outputs:
                like = pq.read_metadata(handle).schema
                final = f"{root}/part-{name}-{hashlib.sha256(schema).hexdigest()[:16]}.parquet"
                outputs[schema] = Output(fs, final, [list(f) for f in footer], like)
            outputs[schema].add(handle, footer)
    for schema, output in outputs.items():
        size = output.close()
        yield {"file": output.final, "schema_id": hashlib.sha256(schema).hexdigest()[:16], "sources": output.sources, "blocks": len(output.groups), "rows": output.rows, "bytes": size, "refused": None}


def footer_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each file by its footer as pyarrow reads it; null where it can't."""
    import pyarrow.parquet as pq

    def rows(path: str) -> int | None:
        try:
            with open_path(path) as handle:
                return pq.read_metadata(handle).num_rows
        except (ValueError, OSError):
            return None

    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "rows": pd.array([rows(p) for p in batch["path"]], "Int64")})


def consolidate(spark: SparkSession, source: str, out_dir: str, target_bytes: int = TARGET_BYTES, by_folder: bool = False) -> DataFrame:
    """Copy the blocks of all Parquet files below ``source`` into files of about ``target_bytes`` below ``out_dir``.

    No page is decoded: column blocks are copied byte by byte, offsets move, and one
    footer describes them all. Files whose schemas differ go to different outputs; files
    without rows add no block and files of length 0 are passed over; what is no Parquet file is reported in ``refused`` and left alone.
    Sources are never changed. ``out_dir`` must be new, in a folder that all executors see.

    Result, once the files are in place: one row for each output (file, schema_id,
    sources, blocks, rows, bytes) and for each refused file. The rows of the outputs are
    checked against those of the sources' footers when written, and in sum here: files
    against the listing, rows against the footers of all files not refused.

    Files fill outputs in the order of their paths by the running sum of their sizes, so
    that no output is larger than ``target_bytes`` and one more file. With ``by_folder``
    each folder below ``source`` has its own outputs, in a folder of the same name.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source).select("path", "length")
    root = spark._jvm.org.apache.hadoop.fs.Path(source)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    folder = F.regexp_replace(F.substr("path", F.lit(len(base) + 2)), "/?[^/]*$", "") if by_folder else F.lit("")
    ordered = positions(listing.withColumn("folder", folder), ["folder"], ["path"], "place")
    summed = running_sum(ordered, ["folder"], "place", {"upto": F.col("length")})
    placed = cut(summed.select("path", "folder", F.floor((F.col("upto") - F.col("length")) / target_bytes).alias("bin")))
    tasks = placed.groupBy("folder").agg((F.max("bin") + 1).alias("bins")).agg(F.sum("bins")).first()[0] or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["folder", "bin"]):
            for (inner, number), part in group.groupby(["folder", "bin"]):
                if out := list(copy_blocks([(x, x) for x in part["path"]], f"{int(number):06d}", f"{out_dir}/{inner}".rstrip("/"))):
                    yield pd.DataFrame(out)

    report = placed.repartition(int(tasks), "folder", "bin").sortWithinPartitions("folder", "bin", "path").mapInPandas(run, REPORT)
    done = cut(report)
    refused = done.filter("refused IS NOT NULL").select(F.col("file").alias("path"))
    footers = listing.select("path").mapInPandas(footer_rows, "path string, rows long")
    want = listing.count(), footers.join(refused, "path", "left_anti").agg(F.sum("rows")).first()[0] or 0
    got = tuple(x or 0 for x in done.agg(F.sum("sources"), F.sum("rows")).first())
    if got != want:
        raise ValueError(f"{got[0]} files with {got[1]} rows were seen to of {want[0]} files with {want[1]} rows below {source}")
    return done


def consolidated(spark: SparkSession, source: str, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The table below ``source`` from few files in the shared folder, and the report of :func:`consolidate`.

    Where a file was refused or none was copied, the table is read from ``source`` itself, so
    that no row is missing; a file that Spark can't read either is an error there.
    """
    out = f"{shared_dir(spark)}/consolidated-{uuid.uuid4().hex}"
    report = consolidate(spark, source, out, target_bytes)
    if report.filter("refused IS NOT NULL").take(1) or not report.take(1):
        return spark.read.parquet(source), report
    return spark.read.schema(spark.read.parquet(source).schema).parquet(out), report


def record_codes(table: pa.Table, rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether it has no msg_id, and a number that agrees for rows of one record in a group: msg_id, or the number of its content ``rest``."""
    nameless = table["msg_id"].is_null().to_numpy()
    codes = table["msg_id"].fill_null(0).to_numpy().copy()
    if nameless.any():
        contents = table.select(rest).filter(pa.array(nameless)).to_pylist() if rest else [None] * int(nameless.sum())
        codes[nameless] = pd.factorize(np.array([repr(c) for c in contents], object))[0]
    return nameless, codes


def step(*arrays: np.ndarray) -> np.ndarray:
    """True where any of the arrays differs from the place before; the first place differs."""
    out = np.ones(len(arrays[0]), bool)
    out[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return out


def compactor(columns: list[str], keys: list[str], out_dir: str, run: str, target_rows: int):
    """Rows sorted by (keys, fragment_id) to files in which every record occurs once, and the report of it."""
    rest = [c for c in columns if c not in RECORD + COPY]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        name, number, output, like = f"{run}-{TaskContext.get().partitionId():06d}", 0, None, None

        def finished() -> pa.RecordBatch:
            size = output.close()
            return pa.RecordBatch.from_pylist([{"file": output.final, "rows": output.rows, "blocks": len(output.groups), "bytes": size, "sources": output.sources}], schema=PARTS)

        for table in whole_tables(batches, keys):
            group = np.cumsum(changes(table.select(keys).to_pandas(), keys))
            unplaced = table["fragment_id"].is_null().to_numpy()
            fragment = table["fragment_id"].fill_null(0).to_numpy()
            nameless, codes = record_codes(table, rest)
            starts = np.flatnonzero(step(group, unplaced, fragment))
            part = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fragment))))
            # the first row of each record in the order of the fragments; records of each part
            order = np.lexsort((part, codes, nameless, group))
            kept = np.zeros(len(part), bool)
            kept[order[step(group[order], nameless[order], codes[order])]] = True
            held = np.bincount(part[order][step(part[order], nameless[order], codes[order])], minlength=len(starts))
            owned = np.bincount(part[kept], minlength=len(starts))
            body = table.select(columns)
            body = body if kept.all() else body.filter(pa.array(kept)).combine_chunks()
            # what is left of each part is one encoded block, as its stored file would be
            landing = pa.BufferOutputStream()
            ends = np.cumsum(owned[owned > 0])
            with pq.ParquetWriter(landing, body.schema, **ENCODED) as writer:
                for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                    writer.write_table(body.slice(a, b - a))
            landed = landing.getvalue()
            if like is None:
                first = pa.BufferOutputStream()
                pq.write_table(body.slice(0, 1), first, **ENCODED)
                footer = ff.read_footer(io.BytesIO(first.getvalue()))
                like = ff.get(footer, 4)[1][0]
                schema = pq.read_metadata(pa.BufferReader(first.getvalue())).schema
                fields = len(ff.get(like, 1)[1])
            blocks = pq.read_metadata(pa.BufferReader(landed))
            pages, values, raw, rows, taken = [[] for _ in range(fields)], [0] * fields, [0] * fields, 0, 0
            for i in range(blocks.num_row_groups):
                block = blocks.row_group(i)
                for k in range(fields):
                    column = block.column(k)
                    pages[k].append(landed.slice(column.data_page_offset, column.total_compressed_size))
                    values[k] += column.num_values
                    raw[k] += column.total_uncompressed_size
                rows, taken = rows + block.num_rows, taken + 1
                full = (output.rows if output else 0) + rows >= target_rows
                if full or i == blocks.num_row_groups - 1:
                    if output is None:
                        output = Output(fs, f"{root}/part-{name}-{number:04d}.parquet", [list(f) for f in footer], schema)
                    output.join(like, rows, [b"".join(p) for p in pages], list(zip(values, raw)), None)
                    output.sources += taken
                    pages, values, raw, rows, taken = [[] for _ in range(fields)], [0] * fields, [0] * fields, 0, 0
                if full:
                    yield finished()
                    output, number = None, number + 1
            del landed, landing, blocks, pages
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [table["topic"].take(at).combine_chunks(), table["fragment_id"].take(at).combine_chunks(), pa.array(held), pa.array(owned), pa.array(np.bincount(part, minlength=len(starts))), *(pa.nulls(len(starts), f.type) for f in list(PARTS)[5:])],
                schema=PARTS,
            )
        if output is not None:
            yield finished()

    return task


def compact_records(message: DataFrame, out_dir: str, target_rows: int = 1_000_000) -> DataFrame:
    """Files of about ``target_rows`` rows in which every record occurs exactly once; the report of their blocks.

    ``message`` has fragment_id, source_uri, topic and msg_id and any other columns, and
    stands for the files of its fragments. Of a record's copies the one in the smallest
    fragment is kept, once; rows without fragment_id count as a fragment behind all
    others; rows without msg_id are one record only where all columns but fragment_id and
    received_at agree. What is left of each fragment is one encoded block, as its file
    would be; the pages of the blocks are copied into files byte by byte and footers made
    for them, as :func:`consolidate` does.

    Rows move once, to where all copies of a record meet: by series and blocks of ids, so
    that a series with most of the rows is spread too. Files follow the order of topics.

    Result, once the files are in place, from a table beside ``out_dir``: for each part of
    a fragment (its topic, fragment_id, held records, owned records and rows), and for
    each file, whose fragment and held are null, file, rows, blocks, bytes and sources
    (parts copied). The rows seen are checked against those of ``message``, the rows
    written against the records owned, and each file against its footer.
    """
    spark = message.sparkSession
    importable(spark)
    columns, block = message.columns, free(message, "record_block")
    rest = [F.col(f"`{c}`") for c in columns if c not in RECORD + COPY]
    nameless = F.xxhash64(*rest) if rest else F.lit(0)
    placed = message.withColumn(block, F.when(F.col("msg_id").isNull(), -1 - F.pmod(nameless, F.lit(64))).otherwise(F.shiftright("msg_id", ID_BLOCK)))
    keys, total = ["topic", "source_uri", block], message.count()
    tasks = max(-(-total // target_rows), min(spark.sparkContext.defaultParallelism, -(-total // 50_000)), 1)
    task = compactor(columns, keys, out_dir, uuid.uuid4().hex[:12], target_rows)
    report = f"{out_dir}-report"
    (
        placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys, F.col("fragment_id").asc_nulls_last())
        .mapInArrow(task, "topic string, fragment_id long, held long, owned long, rows long, file string, blocks long, bytes long, sources long").write.parquet(report)
    )
    done = spark.read.parquet(report)
    seen, owned, written = done.agg(F.sum(F.when(F.col("file").isNull(), F.col("rows"))), F.sum("owned"), F.sum(F.when(F.col("file").isNotNull(), F.col("rows")))).first()
    if (seen or 0) != total or (owned or 0) != (written or 0):
        raise ValueError(f"{seen} of {total} rows were seen, {written} rows were written for {owned} records")
    return done


def fragment_roles(fragment: DataFrame, report: DataFrame) -> DataFrame:
    """What became of each fragment, from the report of :func:`compact_records`.

    A record is (source_uri, topic, msg_id) and belongs to the smallest fragment_id that
    holds it. Result: fragment_id, held (records it holds), owned (records that belong to
    it) and role: ``drop`` where it owns none (also where it holds no row), ``copy`` where
    it owns all it holds and holds none twice, else ``rewrite``. Repeated fragment rows
    count once.
    """
    parts = report.filter("file IS NULL AND fragment_id IS NOT NULL").groupBy("fragment_id").agg(*(F.sum(c).alias(c) for c in ("held", "owned", "rows")))
    role = F.when(F.coalesce("owned", F.lit(0)) == 0, "drop").when((F.col("owned") == F.col("held")) & (F.col("rows") == F.col("held")), "copy").otherwise("rewrite")
    zero = F.lit(0).cast("long")
    return fragment.select("fragment_id").distinct().join(parts, "fragment_id", "left").select("fragment_id", F.coalesce("held", zero).alias("held"), F.coalesce("owned", zero).alias("owned"), role.alias("role"))
