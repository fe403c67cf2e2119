"""Token counts of documents from flat, unindexed token files by a scan for end-of-document identifiers.

Writing. Texts become little-endian 16-bit token ids, one document after the other, each followed by the end-of-document
id; nothing says where a document starts. Spark's text writer puts the files out (the end-of-document id is its row
separator), so output commits per task. A second flat file beside each token file holds the document ids in the same
order, eleven bytes each (null flag, eight bytes of id, separator); it holds no offsets. Texts are never shuffled.

Files are cut at about ``file_bytes``, between documents, so that a task never holds more of one than that (or one document).

Scanning. A task reads a token file in blocks of fixed length and finds separators with one vectorised comparison per
block. A document may start in one block and end in another: a prefix scan over the blocks of a file (a window over
counts, one row per block) gives each block the ordinal of its first document and the tokens carried in.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; null ids come back as null; a document's
own text can't make the end-of-document id, as special tokens are not parsed; an empty table gives no files and no rows. The vocabulary file
is a parameter; one that holds the end-of-document id or ids beyond 16 bits is refused.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, pieces, table, work_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: The splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 16
FILE = 16 << 20

_loaded: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a ranks file, read once per Python worker."""
    if vocabulary not in _loaded:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values(), default=0) > 0xFFFF or END in ranks.values():
            raise ValueError(f"{vocabulary} has ids beyond 16 bits, or the end-of-document id {END}")
        _loaded[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE) -> None:
    """Writes ``path/kind=tokens/cut=k`` and ``path/kind=ids/cut=k``; files of the same name and cut belong together."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pos, cut, held = encoder(vocabulary), 0, 0, 0
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                n = part.num_rows
                flat = [np.asarray(tokens.encode_ordinary(x or ""), "<u2").tobytes() for x in part.column("text").to_pylist()]
                ids = [struct.pack("<?q", x is None, x or 0) for x in part.column("doc_id").to_pylist()]
                at = pa.array(np.arange(pos, pos + n))
                pos += n
                cuts = []
                for x in flat:
                    cut, held = (cut + 1, len(x)) if held and held + len(x) > file_bytes else (cut, held + len(x))
                    cuts.append(cut)
                for kind, data in (("ids", ids), ("tokens", flat)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(cuts, pa.int32()), at, pa.array(data, pa.binary())], ["kind", "cut", "pos", "data"])

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(lean(encode), "kind string, cut int, pos long, data binary").sortWithinPartitions("kind", "cut", "pos")
        .select("kind", "cut", F.col("data").cast("string").alias("value"))
        .write.partitionBy("kind", "cut").option("encoding", "ISO-8859-1").option("lineSep", struct.pack("<H", END).decode("latin-1")).text(path)
    )


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (file, content) of a kind's files, each named by its cut and its task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    at = F.split("path", "/")
    return files.where((F.element_at(at, -3) == f"kind={kind}") & (F.col("length") > 0)).select(F.concat_ws("/", F.element_at(at, -2), F.element_at(at, -1)).alias("file"), "content")


def block_scan(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """A row per block: tokens, separators, tokens before the first and after the last one, and lengths between them."""
    names = ["file", "block", "n_tokens", "n_ends", "lead", "tail", "inner"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(cell.as_buffer(), "<u2") if len(cell.as_buffer()) else np.empty(0, "<u2")
                for first in range(0, len(ids), block * 64):
                    rows = []
                    for b in range(first, min(len(ids), first + block * 64), block):
                        x = ids[b : b + block]
                        at = np.flatnonzero(x == end)
                        rows.append((name, b // block, len(x), len(at), at[0] if len(at) else len(x), len(x) - 1 - at[-1] if len(at) else len(x), (np.diff(at) - 1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "file string, block long, n_tokens long, n_ends long, lead long, tail long, inner array<int>"
    return _files(spark, path, "tokens").mapInArrow(lean(scan), schema)


def stitch(blocks: DataFrame) -> DataFrame:
    """Rows (file, ordinal, n_tokens): lengths of all documents, those across block boundaries included."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.sum("n_ends").over(before), F.lit(0))
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    last_end = F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.col("n_tokens") - F.col("tail"))).over(before)
    b = blocks.withColumn("first", ends).withColumn("at", start).withColumn("carry", F.col("at") - F.coalesce(last_end, F.lit(0))).where("n_ends > 0")
    lengths = F.concat(F.array((F.col("carry") + F.col("lead"))), F.col("inner").cast("array<bigint>"))
    return b.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(cell.as_buffer(), np.uint8).reshape(-1, 11)
                ids = np.ascontiguousarray(x[:, 1:9]).view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.array(ids, mask=x[:, 0] != 0)], ["file", "ordinal", "doc_id"])

    return _files(spark, path, "ids").mapInArrow(lean(parse), "file string, ordinal long, doc_id long")


def token_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens) of the token files under ``path``."""
    return document_ids(spark, path).join(stitch(block_scan(spark, path)), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(docs, path)
    return token_counts(spark, path)
