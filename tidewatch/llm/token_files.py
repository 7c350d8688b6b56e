"""Token-ID output: every text to ids, ids to block files (``pfor``), and back.

Documents are range-partitioned by id, so that file order is document order; each task encodes
its documents and writes files of about ``FILE_IDS`` ids to the shared folder. Names come from
the task's place, and a file appears by one rename: a task run again replaces its own files.
Spark reads the files back as binary rows, one file to a row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import encoder, vocabulary_path
from .frames import keyed, out_id, parts, shared_folder
from .pfor import read, write
from .words import flat, slices

END = 1
FILE_IDS = 1 << 21


def write_token_files(docs: DataFrame, folder: str, end: int = END, path: str | None = None, n_parts: int | None = None) -> list[int]:
    """Write all documents in ascending id order; return the ids of each part, a number a task.

    A null or empty text is its end id alone; a null doc_id comes first; rows of one id keep an
    order fixed by their text; other columns are not read.
    """
    path = path or vocabulary_path()
    own = keyed(docs)
    placed = own.repartitionByRange(n_parts or 2 * parts(docs.sparkSession), "_id", "_fp").sortWithinPartitions("_id", "_fp")

    def save(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        waiting, held, total, number = [], 0, 0, 0

        def flush():
            nonlocal waiting, held, total, number
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*waiting, strict=True))
            name = f"{root}/part-{part:08d}-{number:06d}.pfor"
            with files.open_output_stream(f"{root}/_{part}-{number}-{attempt}.tmp") as out:
                out.write(write(doc_ids, lengths, ids, total))
            files.move(f"{root}/_{part}-{number}-{attempt}.tmp", name)
            waiting, held, total, number = [], 0, total + len(ids), number + 1

        coder = encoder(path)
        for batch in batches:
            for piece in slices(batch, most=8 << 20):
                ids, first = coder.encode(flat(piece.column("text")))
                n = np.diff(first)
                with_end = np.full(len(ids) + len(n), end, np.uint32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                waiting.append((piece.column("_id").to_numpy(), n + 1, with_end))
                held += len(with_end)
                if held >= FILE_IDS:
                    flush()
        if waiting:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total], pa.int64())], ["part", "n_ids"])

    got = dict(placed.mapInArrow(save, "part long, n_ids long").collect())  # a pair of numbers a task
    return [got.get(k, 0) for k in range(max(got, default=-1) + 1)]


def written(spark: SparkSession, folder: str, ids_per_part: list[int]) -> DataFrame:
    """``path, content`` of the folder's files; no rows where no document was written, for then there is no folder."""
    if not sum(ids_per_part):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")


def read_token_files(spark: SparkSession, folder: str, ids_per_part: list[int]) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files alone."""
    before = np.append(0, np.cumsum(ids_per_part)).tolist()

    def load(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part = int(name.as_py().rsplit("part-", 1)[1][:8])
                doc_ids, lengths, ids, in_part = read(content.as_buffer().to_pybytes())
                last = np.cumsum(lengths)
                start = last - lengths
                step = max(1, len(doc_ids) // max(1, len(ids) // 500_000))
                for at in range(0, len(doc_ids), step):
                    to = min(at + step, len(doc_ids))
                    own = ids[start[at]:last[to - 1]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids[at:to]), pa.array(start[at:to] + in_part + before[part]), pa.array(lengths[at:to]),
                        pa.ListArray.from_arrays(pa.array(np.append(start[at:to], last[to - 1]) - start[at], pa.int32()), pa.array(own))],
                        ["_id", "start", "n_tokens", "ids"])

    files = written(spark, folder, ids_per_part)
    return files.mapInArrow(load, "_id long, start long, n_tokens long, ids array<long>").select(out_id(), "start", "n_tokens", "ids")


def token_file_digest(spark: SparkSession, folder: str, ids_per_part: list[int]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; ids stay in the worker that decodes them."""
    before = np.append(0, np.cumsum(ids_per_part)).tolist()

    def digest(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                part = int(name.as_py().rsplit("part-", 1)[1][:8])
                doc_ids, lengths, ids, in_part = read(content.as_buffer().to_pybytes())
                last = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((last - lengths).tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(last - lengths + in_part + before[part]), pa.array(lengths),
                                                  pa.array(crc, pa.int64())], ["_id", "start", "n_tokens", "ids_crc32"])

    files = written(spark, folder, ids_per_part)
    return files.mapInArrow(digest, "_id long, start long, n_tokens long, ids_crc32 long").select(out_id(), "start", "n_tokens", "ids_crc32")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    from .frames import documents

    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "token-files")
    return token_file_digest(spark, folder, write_token_files(docs, folder))
