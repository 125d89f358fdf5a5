"""Shared by the corpus operators: tables in the shared folder, and words and hashes of whole Arrow batches of texts.

Texts are handled as the UTF-8 bytes of an Arrow column. A word's hash takes eight bytes at a time, each time through a
step that isn't linear; a run of words hashes as a tree of its halves. Both have two forms, with constants of their own.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the array code takes at once; a longer document is taken alone.
SLICE_BYTES = 1 << 18


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on one machine, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    """The application's own folder goes when the driver ends, if the session still lives then."""
    if folder in _cleaned:
        return
    _cleaned.add(folder)

    def remove() -> None:
        jsc = spark.sparkContext._jsc
        if jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(lambda: _quietly(remove))


def _quietly(f) -> None:
    try:
        f()
    except Exception:  # noqa: BLE001  the gateway may be gone when the interpreter ends
        pass


#: Rows of ids and numbers that one file of a written table may well hold.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor loses none of it.

    With about how many short rows df has, the last step runs in as many tasks as they need, and leaves as many files.
    """
    if rows is not None:
        df = df.coalesce(2 + rows // FILE_ROWS)
    spark = df.sparkSession
    folder = shared_dir(spark)
    _forget(spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that written() returned and that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that one which df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, summed on the executors."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def in_chunks(docs: DataFrame, chunk_bytes: int, text: str = "text", total: int | None = None) -> DataFrame:
    """docs with a column chunk, dealt out by it: chunks hold chunk_bytes of text each on average, by a hash of the rows.

    Rows without text count as empty ones. The number of chunks follows the input, so each stays as large as now. total:
    the bytes of all texts, where they have been summed.
    """
    n = max(1, -(-(text_bytes(docs, text) if total is None else total) // chunk_bytes))
    chunk = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(n)).cast("int")
    return docs.withColumn("chunk", chunk).repartition(n, "chunk")


# ---------------------------------------------------------------- Arrow columns as arrays


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow column of strings or binaries, and where each value begins (one more than there are values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most that many bytes together, or of one value."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- hashes

#: Odd factors, two sets of three: of a word's first bytes, of its further ones, and of the runs' left halves.
_FACTORS = [[int(x) * 2 + 1 for x in row] for row in np.random.default_rng(20240607).integers(1 << 61, 1 << 63, (2, 3))]
#: Longer words hash by a digest.
_LONG = 64
#: Blank and the control characters from tab to carriage return; anything else belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; by a sort, which is much faster here than the library's hash table."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows of two columns, in order."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[new]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64 bits reversibly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Scrambles 64 bits reversibly, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, form: int = 0) -> np.ndarray:
    """Hashes of the words data[start:end], wherever they stand."""
    first, further, _ = (np.uint64(f) for f in _FACTORS[form])
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", wide.data, strides=(1,))
    size = end - start
    unused = lambda n: np.uint64(8) * (np.uint64(8) - np.minimum(n, 8).astype(np.uint64))
    out = _scrambled((eight[start] << unused(size)) * first + size.astype(np.uint64) * further)
    live, at = np.flatnonzero(size > 8), 8
    while len(live) and at < _LONG:
        rest = size[live] - at
        out[live] = _scrambled(out[live] * first + _scrambled((eight[start[live] + at] << unused(rest)) * further))
        live, at = live[rest > 8], at + 8
    for i in live.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([form])).digest(), "little")
    return out


class Words:
    """The words of some texts: where each begins and ends, its text's number, and its hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.texts = len(at) - 1
        if lower:
            data = _LOWER[data]
        self.data, self.at = data, at
        blank = SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = blank
        edge[at] = True
        self.start = np.flatnonzero(~blank & edge[:-1])
        edge[:-1] = blank
        edge[at] = True
        self.end = np.flatnonzero(~blank & edge[1:]) + 1
        #: The first word of each text, and the number of all at the end.
        self.first = np.searchsorted(self.start, at)
        self._hash: dict[int, np.ndarray] = {}

    def hashes(self, form: int = 0) -> np.ndarray:
        if form not in self._hash:
            self._hash[form] = word_hashes(self.data, self.start, self.end, form)
        return self._hash[form]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def starts(self, size: int) -> np.ndarray:
        """First words of all runs of that many words within a text."""
        n = np.maximum(self.counts() - (size - 1), 0)
        return np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())

    def runs(self, size: int, form: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """starts(), and the runs' hashes."""
        start = self.starts(size)
        if not len(start):
            return start, np.empty(0, np.uint64)
        return start, _run_hashes(self.hashes(form), size, form)[start]

    def wholes(self, texts: np.ndarray, form: int = 0) -> np.ndarray:
        """Hashes of all words of each of some texts, which have one at least."""
        out, counts, first = np.empty(len(texts), np.uint64), self.counts()[texts], self.first[:-1][texts]
        for n in np.unique(counts).tolist():
            at = np.flatnonzero(counts == n)
            value = self.hashes(form)[first[at]]
            for k in range(1, n):
                value = _pair(value, self.hashes(form)[first[at] + k], form)
            out[at] = mix(value + np.uint64(n))
        return out


def _pair(left: np.ndarray, right: np.ndarray, form: int) -> np.ndarray:
    return _scrambled(left * np.uint64(_FACTORS[form][2]) + right)


def _run_hashes(words: np.ndarray, size: int, form: int) -> np.ndarray:
    """The hash of the run of size words from each word on: of its parts of 1, 2, 4 and so on words, as size has them."""
    part, done, out = words, 0, None
    for bit in range(size.bit_length()):
        if bit:
            half = 1 << bit - 1
            part = _pair(part[:-half], part[half:], form)
        if size >> bit & 1:
            here = part[done : done + len(words) - size + 1]
            out = here if out is None else _pair(out[: len(here)], here, form)
            done += 1 << bit
    return out


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of that many words, or of all its words if it has fewer; and where each
    text's begin, which are sorted."""
    start, hashes = words.runs(size)
    counts = words.counts()
    short = np.flatnonzero((counts < size) & (counts > 0))
    n = np.maximum(counts - (size - 1), 0)
    n[short] = 1
    at = np.concatenate(([0], np.cumsum(n)))
    every = np.empty(at[-1], np.uint64)
    alone = np.zeros(at[-1], bool)
    alone[at[short]] = True
    every[alone], every[~alone] = words.wholes(short), hashes
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            every[a:b].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[at[:-1][n > 0]] = True
    return every[new], np.concatenate(([0], np.cumsum(new)))[at]
