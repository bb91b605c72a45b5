"""Token counts by prefix dynamic programming.

For a piece of bytes b, let T[i] be the last token of the encoding of b[:i] and C[i] the number of its tokens. If t is the one
token that ends at i, begins at j and may follow T[j], then T[i] = t and C[i] = C[j] + 1. Two tokens may follow each other if
byte-pair merging of their joined bytes gives just these two; that is found from the merges alone by undoing merges on both
sides of the boundary. One pass thus gives the exact count of every prefix. ``Prefixes`` stores them for a whole text, so that
questions about truncation or budgets are looked up and nothing is encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded, of_worker, utf8
from .units import Cutter, byte_symbols

LIMIT = 1024


class PrefixCounter:
    """Exact counts for the byte-level BPE in a ``tokenizers`` JSON file, special strings inside texts included."""

    def __init__(self, path: str, pattern: str, remember: int = 110_000_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol = byte_symbols()
        as_bytes = lambda s: bytes(symbol[c] for c in s)
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.cutter = Cutter(pattern)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # Tokens are numbered by the order in which merging can make them: bytes first, then one number per merge.
        self.token = {bytes([b]): b for b in range(256)}
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = as_bytes(left), as_bytes(right)
            number = len(self.split)
            pair = (self.token[a], self.token[b])
            self.split.append(pair)
            self.merged.setdefault(pair, number)
            self.token.setdefault(a + b, number)
        self._follows: dict[int, bool] = {}
        # A token counts only if merging its own bytes gives it back.
        self.token = {t: n for t, n in self.token.items() if n < 256 or (self.merged[self.split[n]] == n and self._merges_to(t, n))}
        self.longest = max(map(len, self.token))
        self._lengths = {}
        for t in self.token:
            self._lengths[t[-1]] = max(self._lengths.get(t[-1], 0), len(t))
        self.piece_counts, self.unit_counts = Memo(remember), Memo(remember)

    def _merges_to(self, data: bytes, number: int) -> bool:
        parts = list(data)
        while len(parts) > 1:
            best = min((self.merged.get(p, 1 << 40) for p in zip(parts, parts[1:], strict=False)))
            if best == 1 << 40:
                return False
            left, right = self.split[best]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == left and parts[k + 1] == right:
                    out.append(best)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts == [number]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves the boundary between them: undo the later merge, side by side, and see
        whether any pair across the boundary would have merged before it was covered."""
        key = a << 20 | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 300_000:
                self._follows.clear()
            known = self._follows[key] = self._boundary_stays(a, b)
        return known

    def _boundary_stays(self, a: int, b: int) -> bool:
        before = 1 << 40  # merges across the boundary win only if they come before this
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:  # of equal merges the left one comes first, so the right one is undone first
                if a < 256:
                    return True
                before, a = a, self.split[a][1]
            else:
                if b < 256:
                    if a < 256:
                        return True
                    before, a = a, self.split[a][1]
                    continue
                before, b = b + 1, self.split[b][0]

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Count of tokens of every byte prefix of a piece of the pattern, the empty one first."""
        last, count = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        token, lengths = self.token, self._lengths
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - lengths[piece[i - 1]]), i):
                t = token.get(piece[j:i])
                if t is not None and (j == 0 or self.may_follow(last[j], t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    def _units(self, data: bytes) -> list[bytes]:
        parts = [data]
        for special in self.special:
            if special in data:
                parts = [x for p in parts for k, y in enumerate(p.split(special)) for x in ((special, y) if k else (y,))]
        return [u for p in parts for u in ([p] if p in self.special else self.cutter.units(p))]

    def _count_units(self, units: list[bytes]) -> list[int]:
        cut = [self.cutter.pieces(u) if u not in self.special else [] for u in units]
        counts = self.piece_counts.each(cut, lambda ps: [self.prefix_counts(p)[-1] for p in ps])
        return [sum(c) if u not in self.special else 1 for u, c in zip(units, counts, strict=True)]

    def counts(self, texts: Iterable[bytes]) -> list[int]:
        """Tokens of each text."""
        return list(map(sum, self.unit_counts.each([self._units(x) for x in texts], self._count_units)))

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)


_SPACE_RUN = regex.compile(r"\s+")


class Prefixes:
    """Counts of all prefixes of one text, found in one pass. ``count(n)``: tokens of its first n code points; ``fit(budget)``:
    the most code points that have at most that many tokens."""

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        self.counter = counter
        parts, special = [text], [x.decode() for x in counter.special]
        for one in special:
            parts = [y for p in parts for y in ([p] if p in special else regex.split(f"({regex.escape(one)})", p))]
        counts, total = [np.zeros(1, np.int64)], 0
        for k, part in enumerate(parts):
            if part in special and k % 2:
                continue  # its end was counted with the part before
            follows = parts[k + 1] if k + 1 < len(parts) else ""
            # a prefix that ends inside a special string has that string's beginning as ordinary text
            own = self._of_ordinary(part + follows[:-1])
            counts.append(total + own[1:])
            total += int(own[len(part)])
            if follows:
                total += 1
                counts.append(np.array([total]))
        self.counts = np.concatenate(counts)
        # the fewest tokens of a prefix from here on: it never falls
        self.least = np.minimum.accumulate(self.counts[::-1])[::-1]

    def _of_ordinary(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text without special strings. A prefix has the text's pieces and a beginning of the next one;
        but white space that it ends in is one piece, and a cut contraction may be several."""
        out, at = np.zeros(len(text) + 1, np.int64), 0
        for piece in map(bytes.decode, self.counter.cutter.pieces(text.encode())):
            ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
            before = out[at]
            out[at + 1 : at + len(piece) + 1] = before + np.array(self.counter.prefix_counts(piece.encode()))[ends[1:]]
            if piece[0] == "'":
                for n in range(2, len(piece)):
                    out[at + n] = before + sum(self.counter.prefix_counts(p)[-1] for p in self.counter.cutter.pieces(piece[:n].encode()))
            at += len(piece)
        for run in _SPACE_RUN.finditer(text):
            begin, end = run.span()
            ends = np.cumsum([0, *(len(c.encode()) for c in run[0])])
            out[begin + 1 : end + 1] = out[begin] + np.array(self.counter.prefix_counts(run[0].encode()))[ends[1:]]
        return out

    def count(self, n: int) -> int:
        return int(self.counts[min(max(n, 0), len(self.counts) - 1)])

    def fit(self, budget: int) -> int:
        return max(int(np.searchsorted(self.least, budget, side="right")) - 1, 0)


def truncate(df: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id and text, the longest beginning of the text that has at most ``limit`` tokens.

    Null and empty texts give the empty text; a null id stays null; repeated rows give repeated results; an empty table gives an
    empty result; all other columns, whatever their names, are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in bounded(rows):
            texts = [x.decode() for x in utf8(batch.column(1))]
            cut = [t if n <= limit else t[: counter.prefixes(t).fit(limit)] for t, n in zip(texts, counter.counts([t.encode() for t in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=[id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, text string")


def count_tokens(df: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated results; an empty table
    gives an empty result; all other columns, whatever their names, are ignored. Long texts are counted whole.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in bounded(rows, 4 << 20):
            texts = utf8(batch.column(1))
            counts = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(np.asarray(counts, np.int64) > limit, pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def _counter(path: str, pattern: str) -> PrefixCounter:
    """One for each Python worker and stage, as workers serve many tasks."""
    return of_worker(("prefixes", path, pattern), lambda: PrefixCounter(path, pattern))
