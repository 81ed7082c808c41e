"""Token ids as flat files with 64-bit offsets, to be memory-mapped."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import in_batches, parallelism, texts
from storyloom.llm.tokens import encoder
from storyloom.session import shared_folder

#: Tokens of a file that are looked at together when it is read back, and documents of a batch.
READ_DOCS = 4096

INDEX = "part int, file string, n_docs long, n_null_ids long, n_tokens long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows by the folder's scheme: mounted folders, HDFS, object stores."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def token_type(vocabulary: int) -> np.dtype:
    """The smallest unsigned type, little-endian, that holds every id."""
    return np.min_scalar_type(vocabulary - 1).newbyteorder("<")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    vocabulary: int,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Write ``docs`` in ascending id order below ``folder`` and return the index that was written with them.

    A part has three flat files: ``.tokens`` (ids of all its documents, each with ``end_id`` behind),
    ``.offsets`` (unsigned 64-bit, one more than documents: where each starts in the part) and ``.ids``
    (signed 64-bit document ids; null ids, which come first, as 0). ``index.parquet`` has one row a part:
    its name, sizes, and ``base``, the tokens of all parts before it, from prefix sums over the parts.

    Every attempt of a task writes files of its own name and the index names those of the attempt that
    Spark has committed, so lost executors and repeated tasks leave only files that nothing refers to.

    Nulls: a null text is an empty one; null ids come first and stay null. Repeated rows are written as
    often as they occur; equal ids are ordered by a hash of the text. Long texts are written whole, one
    batch of documents is in memory at a time. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    dtype = token_type(vocabulary)
    ordered = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc_nulls_first(), F.col("_row").asc_nulls_first()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, path = _open(folder)
        store.create_dir(path)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        held = encoder(tokenizer_path, dtype.type)
        end = np.array([end_id], dtype).tobytes()
        n_docs = n_null = n_tokens = 0
        with (
            store.open_output_stream(f"{path}/{name}.tokens") as tokens,
            store.open_output_stream(f"{path}/{name}.offsets") as offsets,
            store.open_output_stream(f"{path}/{name}.ids") as ids,
        ):
            offsets.write(np.array([0], "<u8").tobytes())
            for batch in batches:
                found = held.encode([t or "" for t in batch.column("text").to_pylist()])
                sizes = np.array([len(x) // dtype.itemsize + 1 for x in found], np.int64)
                tokens.write(end.join([*found, b""]))
                offsets.write((n_tokens + np.cumsum(sizes)).astype("<u8").tobytes())
                ids.write(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs += batch.num_rows
                n_null += batch.column("doc_id").null_count
                n_tokens += int(sizes.sum())
        if n_docs:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_docs": n_docs, "n_null_ids": n_null, "n_tokens": n_tokens}],
                pa.schema([("part", pa.int32()), ("file", pa.string())] + [(c, pa.int64()) for c in ("n_docs", "n_null_ids", "n_tokens")]),
            )

    in_batches(ordered, work, INDEX).write.parquet(f"{folder}/parts.parquet")
    # One row a part: a few hundred bytes for each of the files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.parquet(f"{folder}/parts.parquet")
    index = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.write.parquet(f"{folder}/index.parquet")
    return spark.read.parquet(f"{folder}/index.parquet")


def _mapped(store: pafs.FileSystem, path: str, dtype: str | np.dtype) -> np.ndarray:
    """A flat file as an array: mapped where the store is a mounted folder, else read."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_documents(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    dtype = token_type(vocabulary)
    index = spark.read.parquet(f"{folder}/index.parquet").repartition(parallelism(spark), "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/{row['file']}"
                tokens = _mapped(store, f"{name}.tokens", dtype)
                offsets = _mapped(store, f"{name}.offsets", "<u8").astype(np.int64)
                ids = _mapped(store, f"{name}.ids", "<i8")
                for at in range(0, row["n_docs"], READ_DOCS):
                    stop = min(at + READ_DOCS, row["n_docs"])
                    crc = [
                        zlib.crc32(tokens[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()) for k in range(at, stop)
                    ]
                    nulls = np.arange(at, stop) < row["n_null_ids"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(ids[at:stop]), mask=nulls),
                            pa.array(row["base"] + offsets[at:stop]),
                            pa.array(np.diff(offsets[at : stop + 1])),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    columns = ["part", "file", "n_docs", "n_null_ids", "base"]
    return in_batches(index.select(*columns), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "token-files")
