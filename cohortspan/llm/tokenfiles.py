"""Token ids as flat binary files, written in document order and read back.

Documents are dealt out by ranges of doc_id, and each range becomes two files in
the shared folder: ``<name>.ids``, the ids one after the other as little-endian
unsigned integers (16 bits where the vocabulary fits, else 32), and
``<name>.index``, first the n + 1 offsets of its n documents as unsigned 64-bit
integers, counted in ids from the file's start, then the n doc_ids as signed
64-bit integers. A manifest has one row per range: file name, number of
documents, of leading documents without a doc_id, and of ids. Where a range
starts among all ids follows from the prefix sums of the manifest alone.

A task writes under a name of its own and names it in the manifest, which Spark
commits for one attempt per task: what lost or repeated attempts leave behind is
never read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.texts import kept_in_worker, slices
from cohortspan.staging import stage, stage_path

CUTS_KEPT = 600_000  # encoded cuts remembered in a worker
CUT = "\x00"
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTER_MARK = rf"([{LETTERS}])([!-/:-@\[-`{{-~])"
# one piece each; an apostrophe may start a piece with letters
PLAIN = re.compile(rf" ?(?:[{LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)|\n")
MANIFEST = "part int, file string, docs long, unnamed long, ids long, width int"


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    Texts are cut where the pre-tokenizer always starts a new piece: before a
    single blank, around a single line break, and between a letter and the mark
    after it. A cut of letters, of digits or of marks is one piece and goes
    straight to the library's model, all new ones in one call; any other cut goes
    through the whole library. So does a text with two white spaces side by side
    or with a special token, whole. Cuts are then put together by their numbers.
    """

    def __init__(self, path: str, dtype: np.dtype) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"{SPACE}{SPACE}", CUT, *special])
        self.pieces = Tokenizer(self.tokenizer.model)
        self.characters = dict(enumerate(byte_characters()))
        self.dtype = dtype
        self.known: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, cuts: list[str]) -> None:
        plain = [c for c in cuts if PLAIN.fullmatch(c)]
        mapped = [c.encode().decode("latin-1").translate(self.characters) for c in plain]
        found = self.pieces.encode(mapped, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, self.dtype).tobytes()
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(plain)), side="right")
        start = 0
        for cut, end in zip(plain, (ends * self.dtype.itemsize).tolist()):
            self.known[cut] = ids[start:end]
            start = end
        for cut in cuts:
            if cut not in self.known:
                self.known[cut] = self._library(cut)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` after each, and the number of ids of each text."""
        whole = pc.match_substring_regex(texts, self.whole)
        marked = pc.replace_substring(pc.if_else(whole, "", texts), " ", CUT + " ")
        marked = pc.replace_substring(marked, "\n", CUT + "\n" + CUT)
        cut = pc.split_pattern(pc.replace_substring_regex(marked, LETTER_MARK, "\\1" + CUT + "\\2"), CUT)
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if len(self.known) > CUTS_KEPT:
            self.known = dict(islice(self.known.items(), CUTS_KEPT // 2))  # what is frequent was met early
        self._learn([c for c in distinct if c not in self.known])
        # numbers beyond the distinct cuts: texts encoded whole, then the end
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        number[offsets[alone]] = len(distinct) + np.arange(len(alone))
        number = np.insert(number, offsets[1:], len(distinct) + len(alone))
        pool = [
            *map(self.known.__getitem__, distinct),
            *[self._library(texts[int(k)].as_py()) for k in alone],
            np.array([end_id], self.dtype).tobytes(),
        ]
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        place = np.repeat(starts[number] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        per_text = np.add.reduceat(each, offsets[:-1] + np.arange(len(texts)))
        return np.frombuffer(b"".join(pool), self.dtype)[place], per_text


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that print as Latin-1 characters stand for themselves, the others
    follow from code point 256 on.
    """
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(printed)]
    return [chr(b) if b in set(printed) else chr(256 + hidden.index(b)) for b in range(256)]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and store that Spark itself finds it in, whether it names them or not."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(store.makeQualified(path).toString())


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's view of a qualified folder; what Hadoop reads as ``s3a`` or ``s3n`` Arrow knows as ``s3``."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, vocabulary: int = 1 << 16
) -> tuple[DataFrame, str]:
    """Write the ids of all documents in doc_id order; the manifest and the folder.

    NULL text counts as empty. ``end_id`` is appended to every document. Rows of
    equal doc_id follow each other in the order of their texts; a missing doc_id
    comes first.
    """
    spark = docs.sparkSession
    folder = qualified(spark, stage_path(spark, "token-files"))
    width = 2 if vocabulary <= 1 << 16 else 4
    dtype = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        encoder = kept_in_worker(
            f"pieces {tokenizer_path} {width}", lambda: PieceEncoder(tokenizer_path, dtype)
        )
        name, sizes, ids, part, unnamed = uuid.uuid4().hex, [], [], None, 0
        with store.open_output_stream(f"{base}/{name}.ids") as out:
            for batch in slices(batches, most_bytes=8 << 20):
                part = batch.column("part")[0].as_py() if part is None else part
                unnamed += batch.column("doc_id").null_count
                ids.append(batch.column("doc_id").fill_null(0).to_numpy())
                found, per_text = encoder.encode(batch.column("text").fill_null(""), end_id)
                sizes.append(per_text)
                out.write(found.tobytes())
        if not sizes:
            store.delete_file(f"{base}/{name}.ids")
            return
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<u8")
        with store.open_output_stream(f"{base}/{name}.index") as out:
            out.write(offsets.tobytes())
            out.write(np.concatenate(ids).astype("<i8").tobytes())
        row = {
            "part": [part], "file": [name], "docs": [len(offsets) - 1], "unnamed": [unnamed],
            "ids": [int(offsets[-1])], "width": [width],
        }
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

    ranged = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .withColumn("part", F.spark_partition_id())
    )
    return stage(ranged.mapInArrow(run, MANIFEST), "manifest"), folder


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document its place among all ids, from the files alone.

    Returns doc_id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32`` over its ids as 32-bit integers. A file is memory-mapped where
    the shared folder is mounted, and else read by its documents' byte ranges.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = qualified(manifest.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(store, f"{home}/{row['file']}", row)

    # dealt out by file, or all files would be read by the window's one task
    dealt = stage(based, "bases").repartition(files, "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_file(store: fs.FileSystem, path: str, row: dict) -> Iterator[pa.RecordBatch]:
    n, dtype = row["docs"], np.dtype(f"<u{row['width']}")
    with store.open_input_file(f"{path}.index") as file:
        index = file.read()
    offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64)
    doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
    if isinstance(store, fs.LocalFileSystem):
        ids = np.memmap(f"{path}.ids", dtype, "r") if row["ids"] else np.zeros(0, dtype)
        read = lambda a, b: ids[a:b]
    else:
        file = store.open_input_file(f"{path}.ids")
        read = lambda a, b: np.frombuffer(file.read_at((b - a) * dtype.itemsize, a * dtype.itemsize), dtype)
    for start in range(0, n, 4096):
        stop = min(n, start + 4096)
        sums = [
            zlib.crc32(read(a, b).astype("<u4").tobytes())
            for a, b in zip(offsets[start:stop].tolist(), offsets[start + 1:stop + 1].tolist())
        ]
        missing = np.arange(start, stop) < row["unnamed"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids[start:stop], pa.int64(), mask=missing),
                pa.array(offsets[start:stop] + row["base"]),
                pa.array(np.diff(offsets[start:stop + 1])),
                pa.array(sums, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
