"""Shared helpers: reading tables, durable intermediate tables and vectorised shingle hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Texts are hashed in runs of about this many bytes, so that memory doesn't depend on the batch.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset and all executors are in this machine's
    one process (tests), a folder of our own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            found = own.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hduframe-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``docs`` with a column that tells its rows apart, the same each time they are read: file and row where they are a scan of
    Parquet files, else a number that is written with them first."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    if plan.nodeName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # no rows' places in this format
            place = docs.metadataColumn("_metadata")
            return docs.select("*", F.struct(F.xxhash64(place["file_path"]).alias("f"), place["row_index"].alias("r")).alias(name))
    return durable(docs.select("*", F.struct(F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("r")).alias(name)), "numbered")


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``durable`` wrote, later reads of which fail, and let Spark drop shuffle files that nothing needs."""
    spark = None
    for df in tables:
        for name in df.inputFiles()[:1] if df is not None else []:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.toString().split("/")[-1].count("-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if spark is not None:
        give_back()
        spark.sparkContext._jvm.System.gc()  # the cleaner goes by what the driver's garbage collector finds


def held_out(mod: int, rest: int = 0):
    """True where crc32 of the id as text leaves ``rest``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


_HELD: dict = {"stage": None}


def give_back() -> None:
    """Memory that is free goes back to the system: what a model was fitted on would else count until the driver ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def _leave_stages_behind() -> None:
    """A Python worker serves tasks of many stages. At a stage's first task, what ``of_worker`` made for an earlier one goes, and
    memory that is free goes back to the system."""
    context = TaskContext.get()
    stage = context.stageId() if context is not None else None
    if _HELD["stage"] != stage:
        _HELD.clear()
        _HELD["stage"] = stage
        give_back()


def of_worker(key, make):
    """``make()``, once for each key, Python worker and stage."""
    _leave_stages_behind()
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def batches(table_iter: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    _leave_stages_behind()
    for batch in table_iter:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(table_iter: Iterator[pa.RecordBatch], most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and, where a row alone isn't larger, ``most`` bytes of texts."""
    _leave_stages_behind()
    for batch in table_iter:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = min(max(stop, at + 1), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = splitmix(_LOWER.astype(np.uint64) + np.uint64(1))
_VALUE[_SPACE] = 0
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_BASE, _UNBASE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def _byte_runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _cut_at_space(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes, cut where a word ends; a word is never cut."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in _SPACES)
        if cut < 0:
            cut = min((k for k in (text.find(c, at + most) for c in _SPACES) if k >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def part_runs(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes], bool, bool]]:
    """Runs of about ``most`` bytes at most: the texts' numbers, the texts, whether the first goes on from the run before, and
    whether the last one goes on in the next. Only texts longer than that are cut, between words."""
    rows, parts, size, goes_on = [], [], 0, False
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield rows, parts, goes_on, False
            rows, parts, size, goes_on = [], [], 0, False
        pieces = [text] if len(text) <= most else list(_cut_at_space(text, most))
        for n, piece in enumerate(pieces):
            rows.append(k)
            parts.append(piece)
            size += len(piece)
            if n + 1 < len(pieces):
                yield rows, parts, goes_on, True
                rows, parts, size, goes_on = [], [], 0, True
    if rows:
        yield rows, parts, goes_on, False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of A-Z-lowered texts, one after the other, and where each text's words begin (one entry more)."""
    return word_spans(texts)[:2]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``; and the lowered bytes of all texts, and where in them each word starts and stops.

    A word's hash is a polynomial over its bytes, taken from differences of prefix sums over the whole run.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), data, none, none
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    solid = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[:-1] = first[1:] | ~solid[1:]
    last[-1] = True
    starts, stops = np.flatnonzero(first & solid), np.flatnonzero(last & solid) + 1
    words = splitmix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(starts, ends), _LOWER[data], starts, stops


def shingles(texts: list[bytes], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles: runs of ``words`` words, or all of a shorter text as one."""
    for low, high in _byte_runs(texts):
        hashes, at = word_hashes(texts[low:high])
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * _BASE + hashes[k : k + len(rolled)]
        rolled = splitmix(rolled)
        for k in range(high - low):
            begin, end = at[k], at[k + 1]
            if end - begin >= words:
                yield np.unique(rolled[begin : end - words + 1])
            elif end > begin:
                whole = np.uint64(end - begin)
                for x in hashes[begin:end]:
                    whole = np.uint64((int(whole) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield splitmix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


class _Kept(dict):
    """Results by key; asked for a key that isn't there, it notes the key and gives None."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: list = []

    def __missing__(self, key):
        self.asked.append(key)


class Memo:
    """Results by key for repeated words: a dictionary of about ``most`` bytes; beyond that, new keys are computed again each
    batch. Keys are bytes, results bytes or numbers."""

    #: Bytes that an entry takes besides what its key and result hold.
    ENTRY = 200

    def __init__(self, most: int) -> None:
        self.room, self.kept = most, _Kept()

    def each(self, lists: list[list], compute) -> list[list]:
        """The lists with each key replaced by its result. ``compute(list)`` is asked for keys that aren't kept, once each, and
        doesn't give None; what it gives is kept as long as there is room."""
        get, asked = self.kept.__getitem__, self.kept.asked
        asked.clear()
        found, incomplete = [], []
        for k, keys in enumerate(lists):
            before = len(asked)
            found.append(list(map(get, keys)))
            if len(asked) > before:
                incomplete.append(k)
        if not asked:
            return found
        missing = list(dict.fromkeys(asked))
        new = dict(zip(missing, compute(missing), strict=True))
        for k in incomplete:
            found[k] = [new[key] if value is None else value for key, value in zip(lists[k], found[k], strict=True)]
        if self.room > 0:
            for key, value in new.items():
                self.room -= self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
                if self.room <= 0:
                    break
                self.kept[key] = value
        asked.clear()
        return found
