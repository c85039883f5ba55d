"""Byte-level BPE by a rank queue with a hierarchical bitmap.

The vocabulary is a rank file (base64 token, rank); its path and the splitting pattern are
parameters. A text is cut by the pattern into pre-tokens, each encoded on its own: a pre-token
that is a token stands for itself, all others start as single bytes in a linked list, and the
adjacent pair whose joined bytes have the lowest rank is merged, leftmost first, until no pair
has a rank.

All distinct pre-tokens of a run of texts share one linked list, with gaps in it that no pair crosses.
One bucket for each rank holds the list positions whose pair had that rank when they were put
in; a bitmap of 64-ary levels finds the first bucket that is not empty; entries whose pair has
changed since are stale and skipped. A very long pre-token costs O(n) queue entries, whatever
its length. Merging a bucket takes all its places at once where that cannot differ from one at
a time: in a run of overlapping places every second one; and only the leftmost place of each
pre-token where a pair with the merged token has a lower rank than the token.

The merged rank of two tokens is looked up in one sorted array of all pairs whose concatenation
is a token; it depends on the vocabulary only.

Edge cases: null and empty texts have no ids and decode to the empty string. Special tokens are
ordinary text. Repeated rows are encoded like any other; an empty table gives an empty result. Other columns
are passed through by `bpe_tokens` but for those named like its results, which are replaced; `bpe_digests`
reads the key and the text only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P

NONE = 1 << 30
PIECE_CHARS = 2_000_000
FLUSH_CHARS = 8_000_000


class RankBitmap:
    """A set of integers below 64**levels with find-first-set."""

    def __init__(self, size: int) -> None:
        self.levels = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            word, bit = x >> 6, 1 << (x & 63)
            had = level[word]
            level[word] = had | bit
            if had:
                return
            x = word

    def discard(self, x: int) -> None:
        for level in self.levels:
            word = x >> 6
            level[word] &= ~(1 << (x & 63))
            if level[word]:
                return
            x = word

    def first(self) -> int:
        """The least member, or -1."""
        if not self.levels[-1][0]:
            return -1
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            x = (x << 6) | ((word & -word).bit_length() - 1)
        return x


class BytePairCodec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        compiled = regex.compile(pattern)
        self.split, self.iterate = compiled.findall, compiled.finditer
        size = max(self.ranks.values()) + 1
        vocabulary = [b""] * size
        for token, rank in self.ranks.items():
            vocabulary[rank] = token
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.ptr = np.concatenate(([0], np.cumsum([len(x) for x in vocabulary])))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], NONE)
        part = np.concatenate([self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF])
        self.undercut = np.zeros(size, bool)  # tokens that are part of a token of lower rank
        self.undercut[part[part > np.tile(self.merged[:-1], 2)]] = True
        self.size = size

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge(self, raw: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens that lie at ptr in raw, end to end, and where each begins."""
        n = len(raw)
        ids = self.single[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ptr[1:] - 1] = -1
        before[ptr[:-1]] = -1
        own = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_rank(ids[inner], ids[inner + 1])
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(self.size)

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            keys = rank[at]
            cuts = P.run_starts(keys)
            for key, places in zip(keys[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if key in buckets:
                    buckets[key].append(places)
                else:
                    buckets[key] = [places]
                    queue.add(key)

        put(inner)
        while (key := queue.first()) >= 0:
            queue.discard(key)
            held = buckets.pop(key)
            at = np.concatenate(held) if len(held) > 1 else held[0]
            at = at[rank[at] == key]  # the others are stale
            if not len(at):
                continue
            if len(held) > 1:
                at = P.sorted_distinct(at)
            if len(at) > 1:
                if self.undercut[key]:
                    first = np.concatenate(([True], own[at[1:]] != own[at[:-1]]))
                    buckets[key] = [at[~first]]
                    if len(buckets[key][0]):
                        queue.add(key)
                    else:
                        del buckets[key]
                    at = at[first]
                else:
                    chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                    if chained.any():
                        begin = np.flatnonzero(~chained)
                        index = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
                        at = at[index % 2 == 0]
            gone = after[at]
            following = after[gone]
            ids[at] = key
            after[at] = following
            alive[gone] = False
            rank[gone] = NONE
            rank[at] = NONE
            joined = following >= 0
            before[following[joined]] = at[joined]
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate((at[joined], left))
            rank[changed] = self.pair_rank(ids[changed], ids[after[changed]])
            put(P.sorted_distinct(changed))
        return ids[alive], np.concatenate(([0], np.cumsum(alive)))[ptr]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pre-tokens, end to end, and where each begins."""
        raw = [x.encode() for x in pieces]
        whole = np.array([self.ranks.get(x, -1) for x in raw], np.int64)
        rest = np.flatnonzero(whole < 0)
        lengths = np.ones(len(raw), np.int64)
        if len(rest):
            ptr = np.concatenate(([0], np.cumsum([len(raw[k]) for k in rest])))
            some, cuts = self.merge(np.frombuffer(b"".join([raw[k] for k in rest]), np.uint8), ptr)
            lengths[rest] = np.diff(cuts)
        out_ptr = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty(out_ptr[-1], np.int64)
        known = np.flatnonzero(whole >= 0)
        out[out_ptr[known]] = whole[known]
        if len(rest):
            out[P.gather_ranges(out_ptr[rest], lengths[rest])] = some
        return out, out_ptr

    def _pieces(self, text: str | None) -> Iterator[str]:
        """The pre-tokens of a text; those of a long one are never held all at once."""
        if not text:
            return iter(())
        return (m.group() for m in self.iterate(text)) if len(text) > PIECE_CHARS else iter(self.split(text))

    def encode_texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) for runs of texts: text k of a run has the ids bounds[k]:bounds[k+1]. The distinct
        pre-tokens of about FLUSH_CHARS characters of text are encoded at a time."""
        index: dict[str, int] = {}
        runs, found, size, total = [], [], 0, 0
        for k, text in enumerate(texts):
            found.append(np.fromiter((index.setdefault(x, len(index)) for x in self._pieces(text)), np.int32))
            size += len(text or "")
            last = k == len(texts) - 1
            if size >= PIECE_CHARS or last:
                runs.append(found)
                found, size, total = [], 0, total + size
            if total >= FLUSH_CHARS or last:
                yield from self._encoded(index, runs)
                index, runs, total = {}, [], 0

    def _encoded(self, index: dict[str, int], runs: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, ptr = self.encode_pieces(list(index))
        for found in runs:
            at = np.concatenate(found)
            lengths = ptr[at + 1] - ptr[at]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            yield ids[P.gather_ranges(ptr[at], lengths)].astype("<u4"), ends[np.cumsum([0, *map(len, found)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, end to end, and the bounds of each text in them."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= self.size or (self.ptr[ids + 1] == self.ptr[ids]).any()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.ptr[ids + 1] - self.ptr[ids]
        return self.bytes[P.gather_ranges(self.ptr[ids], lengths)], np.concatenate(([0], np.cumsum(lengths)))[bounds]


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each vocabulary and worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(path, pattern)
    return _codecs[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the token ids of the text column."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        parts = []
        for ids, bounds in codec(path, pattern).encode_texts(column.to_pylist()):
            parts.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
        P.give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(to, encode(text))


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids stand for; a null list decodes to no bytes."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        column = column.fill_null([])
        raw, bounds = codec(path, pattern).decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy())))))
        view = memoryview(raw.tobytes())
        return pa.array([bytes(view[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())

    return encoded.withColumn(to, decode(ids))


def _digest_batch(own: BytePairCodec, texts: list[str | None]) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """For runs of texts: their ids, and n_tokens, ids_sha256 and decoded_sha256, where the decoded bytes
    are made from the ids alone."""
    import hashlib

    for ids, bounds in own.encode_texts(texts):
        raw, ends = own.decode(ids, bounds)
        a, b = memoryview(ids.tobytes()), memoryview(raw.tobytes())
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
        yield (
            lists,
            [
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.array([hashlib.sha256(a[4 * x : 4 * y]).hexdigest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(b[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
            ],
        )


def bpe_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: each run of texts is encoded, its ids decoded
    again, and only the digests leave the worker."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in P.column_batches(batches):
            at = 0
            for _, digests in _digest_batch(own, batch.column(1).to_pylist()):
                n = len(digests[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *digests], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += n

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the text replaced by its ids, n_tokens and the digests of ids and decoded bytes."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encode(column: pa.Array) -> pa.Array:
        parts = [pa.StructArray.from_arrays([ids, *digests], fields=list(kind)) for ids, digests in _digest_batch(codec(path, pattern), column.to_pylist())]
        P.give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    made = [f.name for f in kind]
    rest = [c for c in docs.columns if c != text and c not in made]
    return docs.select(*rest, encode(F.col(text)).alias("bpe_tokens")).select(*rest, *[f"bpe_tokens.{c}" for c in made])
