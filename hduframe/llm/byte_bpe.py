"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

The words of a batch that haven't been met yet become rows (word, place, token). A recursive query joins neighbouring tokens
with the merge table and contracts, in each word, the leftmost pair of least rank, until no pair is left. An ordered aggregation
joins the bytes of the token rows of each document back into its text.

A query's steps grow with its longest word, so words go into it in segments of a few bytes. Two neighbouring tokens are what
merging leaves of a longer text wherever merging leaves these two of their own bytes; so a boundary between segments stands if
the query, given the bytes of the two tokens beside it, gives just these two. Where it doesn't, the tokens around it are encoded
again together. Work thus grows in proportion to a word's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, bounded, of_worker, utf8
from .units import Cutter

#: Words, and about as many bytes, of one recursive query; bytes of a segment.
QUERY_WORDS, QUERY_BYTES, SEGMENT = 40_000, 400_000, 32
#: Rounds in which boundaries that don't stand are encoded again side by side; what is left then is gone through from the left.
ROUNDS, AROUND = 4, 4
#: Rows are linked: ``next`` is the id of the token that follows in the word. Of a word's rows, those of its last step are its tokens.
ENCODE = """
WITH RECURSIVE state(id, step, word, token, next) USING KEY (id) AS (
    SELECT id, 0, word, token, next FROM start
  UNION ALL
    SELECT state.id, state.step + 1, state.word,
           CASE WHEN state.id = hit.id THEN hit.merged ELSE state.token END,
           CASE WHEN state.id = hit.id THEN hit.after ELSE state.next END
    FROM state JOIN (
        SELECT word, unnest(min({rank: merges.merged, id: a.id, merged: merges.merged, swallowed: b.id, after: b.next}))
        FROM (SELECT id, word, token, next FROM state) AS a
        JOIN (SELECT id, token, next FROM state) AS b ON a.next = b.id
        JOIN merges ON merges.pair = a.token * 65536::BIGINT + b.token
        GROUP BY word
    ) AS hit ON hit.word = state.word
    WHERE state.id <> hit.swallowed
)
SELECT word, token FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) ORDER BY id
"""
#: A byte is written as the character of its number.
DECODE = "SELECT text, string_agg(piece, '' ORDER BY place) AS piece FROM coded JOIN vocabulary USING (token) GROUP BY text"


class DuckBPE:
    """Encoder and decoder for the ranks in a file of base64 tokens and numbers, words being the matches of ``pattern``."""

    def __init__(self, path: str, pattern: str, remember: int = 80_000_000) -> None:
        with open(path, "rb") as file:
            rank = {base64.b64decode(t): int(n) for t, n in (line.split() for line in file if line.strip())}
        self.bytes_of = {n: t for t, n in rank.items()}
        self.byte_rank = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(rank[t[:k]], rank[t[k:]], n) for t, n in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        first, second, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        if max(rank.values()) >= 1 << 16:
            raise ValueError("pairs of tokens are packed into 16 bits each")
        self.cutter = Cutter(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        self._table("merges", pa.table({"pair": first * 65536 + second, "merged": merged.astype(np.int32)}))
        self._table("vocabulary", pa.table({"token": pa.array(list(rank.values()), pa.int32()), "piece": [t.decode("latin-1") for t in rank]}))
        self.words, self.units = Memo(remember), Memo(remember)
        self._stands: dict[tuple[int, int], bool] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        cut = [[w[k : k + SEGMENT] for k in range(0, len(w), SEGMENT)] for w in words]
        parts = list(dict.fromkeys(s for segments in cut for s in segments))
        coded = dict(zip(parts, self._contract_all(parts), strict=True))
        lists = [[np.frombuffer(coded[s], "<u4").tolist() for s in segments] if len(segments) > 1 else None for segments in cut]
        self._join([x for x in lists if x is not None])
        return [(coded[segments[0]] if segments else b"") if found is None else np.array([t for s in found for t in s], "<u4").tobytes() for segments, found in zip(cut, lists, strict=True)]

    def _join(self, lists: list[list[list[int]]]) -> None:
        """Changes lists of segments' tokens such that every boundary between segments stands."""
        for n in range(ROUNDS):
            self._check({(x[k][-1], x[k + 1][0]) for x in lists for k in range(len(x) - 1)})
            around, regions = AROUND << n, []
            for x in lists:
                k = 0
                while k + 1 < len(x):
                    if not self._stands[x[k][-1], x[k + 1][0]]:
                        left, right = x[k], x[k + 1]
                        region = left[-around:] + right[:around]
                        regions.append(region)
                        x[k : k + 2] = [s for s in (left[: len(left) - around] if len(left) > around else [], region, right[around:]) if s]
                        k += (len(left) > around) + 1 + (len(right) > around)
                    else:
                        k += 1
            if not regions:
                return
            for region, ids in zip(regions, self._contract_all([self._bytes(r) for r in regions]), strict=True):
                region[:] = np.frombuffer(ids, "<u4").tolist()
        self._check({(x[k][-1], x[k + 1][0]) for x in lists for k in range(len(x) - 1)})
        for x in lists:
            x[:] = [self._from_left(x)]

    def _from_left(self, segments: list[list[int]]) -> list[int]:
        out, known = list(segments[0]), {}
        for segment in segments[1:]:
            self._check({(out[-1], segment[0])})
            around, ids = 0, segment
            while around < len(out) and not self._stands[out[len(out) - around - 1], ids[0]]:
                around = min(max(AROUND, 2 * around), len(out))
                data = self._bytes(out[-around:] + segment)
                if data not in known:
                    known[data] = np.frombuffer(self._contract_all([data])[0], "<u4").tolist()
                ids = known[data]
                if around < len(out):
                    self._check({(out[len(out) - around - 1], ids[0])})
            del out[len(out) - around :]
            out += ids
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _check(self, pairs: set[tuple[int, int]]) -> None:
        """Finds out which pairs of tokens stand."""
        if len(self._stands) > 200_000:
            self._stands.clear()
        missing = [p for p in pairs if p not in self._stands]
        for p, ids in zip(missing, self._contract_all([self._bytes(list(p)) for p in missing]), strict=True):
            self._stands[p] = ids == np.array(p, "<u4").tobytes()

    def _contract_all(self, words: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and stop - at < QUERY_WORDS and (stop == at or size + len(words[stop]) <= QUERY_BYTES):
                size += len(words[stop])
                stop += 1
            out += self._contract(words[at:stop])
            at = stop
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        number = np.arange(len(data), dtype=np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        following = number + np.int32(1)
        following[np.cumsum(sizes)[sizes > 0] - 1] = -1
        self.db.register("start", pa.table({"id": number, "word": word, "token": self.byte_rank[data], "next": following}))
        rows = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(rows["token"]).astype("<u4")
        ends = np.searchsorted(np.asarray(rows["word"]), np.arange(len(words)), side="right")
        raw, begin, out = ids.tobytes(), 0, []
        for end in ends.tolist():
            out.append(raw[4 * begin : 4 * end])
            begin = end
        return out

    def decode_many(self, coded: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids, by an ordered aggregation over token rows."""
        out: list[bytes] = []
        at = 0
        while at < len(coded):
            stop, size = at, 0
            while stop < len(coded) and (stop == at or size + len(coded[stop]) <= 8 * QUERY_BYTES):
                size += len(coded[stop])
                stop += 1
            some = coded[at:stop]
            sizes = np.array([len(c) // 4 for c in some])
            ids = np.frombuffer(b"".join(some), "<u4").astype(np.int32)
            place = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            self.db.register("coded", pa.table({"text": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "place": place, "token": ids}))
            found = dict(self.db.execute(DECODE).fetchall())
            self.db.unregister("coded")
            out += [found.get(k, "").encode("latin-1") for k in range(len(some))]
            at = stop
        return out

    def _code_units(self, units: list[bytes]) -> list[bytes]:
        return list(map(b"".join, self.words.each([self.cutter.pieces(u) for u in units], self.encode_words)))

    def encode_many(self, texts: Iterable[bytes]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        return list(map(b"".join, self.units.each([self.cutter.units(x) for x in texts], self._code_units)))


def _codec(path: str, pattern: str) -> DuckBPE:
    return of_worker(("byte_bpe", path, pattern), lambda: DuckBPE(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id and ids, an array of the text's tokens (empty for a null or empty text). A null id stays null,
    repeated rows give repeated results, an empty table an empty one; other columns, whatever their names, are ignored."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in bounded(rows):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode_many(utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per row of ``df``: id and text, from an array of tokens; null and empty arrays give the empty text, bytes that are
    no UTF-8 the replacement character. A null id stays null, repeated rows give repeated results, an empty table an empty one;
    other columns, whatever their names, are ignored."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches(rows, 512):
            coded = [np.asarray(x if x is not None else [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            texts = [x.decode("utf-8", "replace") for x in codec.decode_many(coded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(ids_column)).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes.

    A null or empty text has no tokens and the digests of no bytes; a null id stays null; repeated rows give repeated results;
    an empty table gives an empty result; other columns, whatever their names, are ignored. Texts are encoded whole.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in bounded(rows, 4 << 20):
            joined = codec.encode_many(utf8(batch.column(1)))
            decoded = codec.decode_many(joined)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in joined], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
