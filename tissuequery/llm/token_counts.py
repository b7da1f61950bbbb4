"""Operator 6: token counts by separator scan over flat token files.

A flat token file is a run of little-endian token ids (16 bits, or 32 where the vocabulary needs them) in which a
document ends with a separator; there is no index. It is read in blocks of a fixed number of tokens, wherever they are
in the file. Each block is searched for separators at once (numpy); a prefix scan over the blocks of a file stitches what
lies across their borders: tokens before the block, separators before it, and the place of the last separator before it.
A document's tokens are those between two separators.

The query makes the files from the documents with a public tokenizer, one file a task, in the shared folder (any store
that pyarrow or Spark's folder names reach), and keeps the order in which it wrote them, to name the documents again. A
file counts only if its task's rows are there, so a task that runs twice does no harm.

Defined results: a null text is an empty text, of no tokens; special tokens' strings in a text are ordinary text, so no
document holds a separator; a null id stays null; tokens after a file's last separator are one more, unfinished document;
an empty file has no documents; rows that repeat or tie stay rows of their own, told apart by their places; a text of any
length may span any number of blocks; an empty table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bound_batches, by_value, new_folder, prefix_sums, read, remove, spool
from .bpe import default_file, encoder

by_value(__name__)

BLOCK_TOKENS = 1 << 18
SEPARATOR = "<|endoftext|>"
#: Blocks of so many bytes in all are one task's.
TASK_BYTES = 64 << 20


def token_type(ids: int) -> str:
    """The numpy type of a file's tokens, for a vocabulary of so many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's name, and the folder there."""
    return fs.FileSystem.from_uri(folder)


def flat_files(docs: DataFrame, id_col: str, text_col: str, folder: str, path: str | None = None) -> tuple[DataFrame, int, str]:
    """Writes the files. Rows (file, ordinal, id, null) of the order in which documents went in and a row (file, null,
    null, bytes) a file, spooled; the separator; the tokens' type."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(path or default_file(), encoding="utf-8") as f:
        content = f.read()
    model = encoder(content, False)
    separator, kind = model.special[SEPARATOR], token_type(max(model.names) + 1)
    shared = spark.sparkContext.broadcast(content)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        model, out, order, size = encoder(shared.value, False), None, 0, 0
        end = np.array([separator], kind).tobytes()
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    flat = []
                    for text in part.column("text").to_pylist():
                        ids = b"".join([c[0] for c in model.plain(text)])
                        flat += [np.frombuffer(ids, "<u4").astype(kind).tobytes(), end]
                    if out is None:
                        where, base = store(folder)
                        where.create_dir(base, recursive=True)
                        out = where.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}")
                    data = b"".join(flat)
                    out.write(data)
                    size += len(data)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(order, order + n), pa.int64()), part.column("id"), pa.nulls(n, pa.int64())], names=["file", "ordinal", "id", "bytes"])
                    order += n
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, part.schema.field("id").type), pa.array([size], pa.int64())], names=["file", "ordinal", "id", "bytes"])

    return spool(narrow.mapInArrow(run, f"file string, ordinal long, id {id_type}, bytes long"), "order"), separator, kind


def scan(files: DataFrame, separator: int, kind: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """files: file, bytes. Per document: file, ordinal, first_token, n_tokens, finished. No file is read whole, and every
    block once."""
    spark, width = files.sparkSession, np.dtype(kind).itemsize
    step = block * width
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))).alias("at"))
    blocks = blocks.repartition(max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // step))), "file", F.floor(F.col("at") * step / TASK_BYTES))

    def run(batches):
        name, source = None, None
        for batch in batches:
            for file, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "at"))):
                if file != name:
                    where, _ = store(file.rsplit("/", 1)[0])
                    name, source = file, where.open_input_file(f"{_}/{file.rsplit('/', 1)[1]}")
                flat = np.frombuffer(source.read_at(min(step, size - at * step), at * step), kind)
                ends = np.flatnonzero(flat == separator)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "at", "tokens", "ends"])

    found = spool(blocks.mapInArrow(run, "file string, at long, tokens long, ends array<long>"), "ends")
    sums = prefix_sums(found.select("file", "at", "tokens", F.size("ends").cast("long").alias("docs")), ["file"], "at", ["tokens", "docs"])
    sums = spool(sums.select("file", "at", "tokens_before", "docs_before"), "sums")
    placed = found.join(sums, ["file", "at"])
    placed = placed.withColumn("_last", F.when(F.size("ends") > 0, F.col("tokens_before") + F.element_at("ends", -1))).withColumn("_coarse", F.floor(F.col("at") / 1024))
    # the last separator before the block: a running maximum on two levels
    outer = placed.groupBy("file", "_coarse").agg(F.max("_last").alias("_m"))
    outer = outer.select("file", "_coarse", F.max("_m").over(Window.partitionBy("file").orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)).alias("_outer"))
    inner = F.max("_last").over(Window.partitionBy("file", "_coarse").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_inner", inner).join(outer, ["file", "_coarse"])
    before = F.coalesce(F.greatest("_inner", "_outer"), F.lit(-1))
    ends = F.transform("ends", lambda e: e + F.col("tokens_before"))
    # a row a separator, holding its own two places only
    starts = F.concat(F.array(before), F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    each = placed.where(F.size("ends") > 0).select("file", "docs_before", F.posexplode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("_i", "_d"))
    done = each.select("file", (F.col("docs_before") + F.col("_i")).alias("ordinal"), (F.col("_d.s") + 1).alias("first_token"), (F.col("_d.e") - F.col("_d.s") - 1).alias("n_tokens"), F.lit(True).alias("finished"))
    tail = found.withColumn("_n", F.size("ends").cast("long")).join(sums, ["file", "at"])
    tail = tail.groupBy("file").agg(F.sum("tokens").alias("_all"), F.sum("_n").alias("ordinal"), (F.coalesce(F.max(F.when(F.col("_n") > 0, F.col("tokens_before") + F.element_at("ends", -1))), F.lit(-1)) + 1).alias("first_token"))
    tail = tail.where("_all > first_token").select("file", "ordinal", "first_token", (F.col("_all") - F.col("first_token")).alias("n_tokens"), F.lit(False).alias("finished"))
    return done.union(tail)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folder: str | None = None) -> DataFrame:
    """Per row of docs: its id, n_tokens, and where it stands (file, ordinal, first_token). The files stay in the folder
    asked for; without one they are deleted when they have been scanned."""
    spark = docs.sparkSession
    own = new_folder(spark, "tokens") if folder is None else folder
    order, separator, kind = flat_files(docs, id_col, text_col, own, path)
    counted = scan(order.where("bytes IS NOT NULL").select("file", "bytes"), separator, kind)
    out = order.where("bytes IS NULL").select("file", "ordinal", "id").join(counted, ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens", "file", "ordinal", "first_token")
    if folder is None:
        remove(spark, own)
    return out


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(read(spark, sf_dir, "documents"))
    return out.withColumn("file", F.element_at(F.split("file", "/"), -1))
