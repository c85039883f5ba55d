"""Exact substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document. A word is removed when a window that
covers it has a word sequence that also starts earlier: in a document with a smaller doc_id,
or earlier in the same document. Windows are judged on the input.

Method. Any run of `window` words holds a whole aligned block of B = (window + 1) // 2 words,
one of the non-overlapping blocks that start at multiples of B. Every document is both
reference and probe:

1. Each task hashes the rolling B-word windows of its documents. Hashes that repeat inside the
   task are hits at once, and only one representative goes on, so a passage that a third of
   all rows share costs one entry a task, not one an occurrence. The entries (32 bits of the
   hash, a flag for an aligned block, a position coded as a gap) are packed into one row for
   each bucket of the hash space.
2. A bucket sorts its entries: a hash that has two entries or more, one of them an aligned
   reference block, is a hit at all of them. The positions return to their documents.
3. Hits are extended: only windows of `window` words that contain a hit can be repeats. They
   are dealt to buckets by one hash and compared there by all 64 bits of a second, independent one (no
   words are compared: of a million windows in a bucket, about one in 10**13 meets a wrong one); the
   first start of each sequence stays, all other starts are repeats, and overlapping repeats join up to
   the maximal exact repeats (`spans`).

No pair of documents is ever formed, so groups of copies cost what their text costs. Work is
in proportion to the text; buckets are as many as the text needs, so that each holds about
BUCKET_WORDS entries at any size.

Edge cases: null and empty texts have no words and lose none. Documents shorter than a window
lose none. Rows with the same doc_id and text count as one document and get the same result;
rows with the same doc_id and other text are ordered by a hash of the text. A null doc_id sorts
before all others. A very long text is read whole, by one task. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textscan as S

WINDOW = 20
FLUSH_WORDS = 1_500_000
PIECE_BYTES = 1 << 20
BUCKET_WORDS = 1_000_000
LEAST = -(1 << 63)

_PROBES = "bucket int, flush long, kind int, a binary, b binary, c binary"
_HITS = "doc_id long, th long, hits binary"
_WINDOWS = "bucket int, doc binary, hashes binary, places binary, local binary"
_LATER = "home int, doc binary, places binary"
_REPEATS = "doc_id long, th long, repeats binary"
HOME_BYTES = 64 << 20


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal slices of the hash space, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Flush:
    """Word hashes of many documents, gathered until they are worth packing."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.ths: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, ths: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> None:
        for to, x in ((self.ids, ids), (self.ths, ths), (self.counts, counts), (self.hashes, hashes)):
            to.append(x)
        self.size += len(hashes)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out = tuple(np.concatenate(x) for x in (self.ids, self.ths, self.counts, self.hashes))
        self.__init__()
        return out  # type: ignore[return-value]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of documents with their words' hashes: (batch rows, ids, text hashes, scan, hashes)."""
    for batch in P.column_batches(batches):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        ths = batch.column("th").to_numpy(zero_copy_only=False)
        data, offsets = S.text_buffers(batch.column("text"))
        for a, z in S.pieces(offsets, PIECE_BYTES):
            found = S.scan(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            yield batch, a, z, ids[a:z], ths[a:z], found, found.word_hashes()


def _probe(block: int, buckets: int):
    """Step 1: rows for the buckets, and one directory row for each flush (bucket -1)."""
    schema = P.arrow_schema(_PROBES)

    def rows(flush: int, ids, ths, counts, words) -> pa.RecordBatch:
        ptr = np.concatenate(([0], np.cumsum(counts)))
        hashes, at = S.window_hashes(words, ptr, block)
        owner_start = np.repeat(ptr[:-1], np.maximum(counts - block + 1, 0))
        aligned = (at - owner_start) % block == 0
        order = np.argsort(hashes, kind="stable")
        hashes, at, aligned = hashes[order], at[order], aligned[order]
        runs = P.run_starts(hashes)
        lengths = np.diff(runs, append=len(hashes))
        repeated = np.repeat(lengths > 1, lengths)
        local = np.sort(at[repeated])
        flag = np.logical_or.reduceat(aligned, runs) if len(runs) else aligned
        rep, where = hashes[runs], at[runs]
        bucket = _bucket_of(rep, buckets)
        # blocks come first in a bucket, then by place
        order = np.argsort((bucket << 33) | (np.where(flag, 0, 1) << 32) | where)
        bucket, rep, where, flag = bucket[order], rep[order], where[order], flag[order]
        cuts = P.bucket_cuts(bucket, buckets)
        out: dict[str, list] = {k: [] for k in schema.names}

        def put(*x) -> None:
            for name, value in zip(schema.names, x, strict=True):
                out[name].append(value)

        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            mid = lo + int(flag[lo:hi].sum())
            prints = (rep[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
            put(int(b), flush, 0, prints, P.pack_ascending(where[lo:mid]), P.pack_ascending(where[mid:hi]))
        home = (flush ^ (flush >> 32)) % buckets  # this row only passes through its bucket
        put(home, flush, 1, np.stack([ids, ths]).astype("<i8").tobytes(), P.pack_counts(counts), P.pack_ascending(local))
        return P.frames(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        np.seterr(over="ignore")
        flush, gathered = TaskContext.get().partitionId() << 32, _Flush()
        for _, _, _, ids, ths, found, words in _documents(batches):
            gathered.add(ids, ths, np.diff(found.ptr), words)
            if gathered.size >= FLUSH_WORDS:
                yield rows(flush, *gathered.take())
                flush += 1
        if gathered.ids:
            yield rows(flush, *gathered.take())

    return run


def _classes(table: pa.Table) -> pa.Table:
    """Step 2: places of the hashes that meet an aligned block elsewhere, by flush."""
    passed = table.filter(pc.equal(table.column("kind"), 1))
    table = table.filter(pc.equal(table.column("kind"), 0))
    if not table.num_rows:
        return passed
    schema = P.arrow_schema(_PROBES)
    out: dict[str, list] = {k: [] for k in schema.names}
    flushes = table.column("flush").to_numpy()
    prints, flags, places, owner = [], [], [], []
    for k, (a, b, c) in enumerate(zip(*(table.column(x).to_pylist() for x in "abc"), strict=True)):
        blocks, probes = P.unpack_ascending(b), P.unpack_ascending(c)
        prints.append(np.frombuffer(a, "<u4"))
        places += [blocks, probes]
        flags.append(np.arange(len(prints[-1])) < len(blocks))
        owner.append(np.full(len(prints[-1]), k))
    keys, flag, place, own = (np.concatenate(x) for x in (prints, flags, places, owner))
    order = np.argsort(keys, kind="stable")
    runs = P.run_starts(keys[order])
    lengths = np.diff(runs, append=len(keys))
    hit = (lengths > 1) & np.logical_or.reduceat(flag[order], runs)
    chosen = order[np.repeat(hit, lengths)]
    chosen = chosen[np.lexsort((place[chosen], own[chosen]))]
    cuts = np.searchsorted(own[chosen], np.arange(len(flushes) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        at = P.pack_ascending(place[chosen[cuts[k] : cuts[k + 1]]])
        for name, value in zip(schema.names, (0, int(flushes[k]), 0, None, None, at), strict=True):
            out[name].append(value)
    return pa.concat_tables([pa.Table.from_batches([P.frames(schema, out)]), passed.cast(schema)])


def _return_hits(table: pa.Table) -> pa.Table:
    """Step 2, back again: the hits of one flush, dealt to its documents."""
    schema = P.arrow_schema(_HITS)
    kinds = table.column("kind").to_pylist()
    top = kinds.index(1)
    ids, ths = np.frombuffer(table.column("a")[top].as_py(), "<i8").reshape(2, -1)
    ptr = np.concatenate(([0], np.cumsum(P.unpack_counts(table.column("b")[top].as_py()))))
    hits = P.sorted_distinct(np.concatenate([P.unpack_ascending(x) for x in table.column("c").to_pylist()]))
    cuts = np.searchsorted(hits, ptr)
    out: dict[str, list] = {k: [] for k in schema.names}
    for k in np.flatnonzero(np.diff(cuts)):
        out["doc_id"].append(int(ids[k]))
        out["th"].append(int(ths[k]))
        out["hits"].append(P.pack_ascending(hits[cuts[k] : cuts[k + 1]] - ptr[k]))
    return pa.Table.from_batches([P.frames(schema, out)])


def _extend(window: int, block: int, buckets: int):
    """Step 3: windows that contain a hit; of those that repeat in the task only the first goes on."""
    schema = P.arrow_schema(_WINDOWS)

    def rows(ids, ths, numbers, hashes, seconds, starts) -> pa.RecordBatch:
        """numbers: of the document that each window is in. Documents are ordered by (id, text). seconds: the
        hashes that tell the bucket."""
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ths, ids))] = np.arange(len(ids))
        order = np.lexsort(((rank[numbers] << 32) | starts, hashes))
        hashes, seconds, numbers, starts = hashes[order], seconds[order], numbers[order], starts[order]
        runs = P.run_starts(hashes)
        first = np.zeros(len(hashes), bool)
        first[runs] = True
        # an equal row of the same document is no earlier start
        head = np.repeat(runs, np.diff(runs, append=len(hashes)))
        same = (ids[numbers] == ids[numbers[head]]) & (ths[numbers] == ths[numbers[head]]) & (starts == starts[head])
        later = ~first & ~same
        out: dict[str, list] = {k: [] for k in schema.names}

        def put(*x) -> None:
            for name, value in zip(schema.names, x, strict=True):
                out[name].append(value)

        def documents(numbers: np.ndarray) -> bytes:
            """The documents of ascending numbers, and how many entries each has."""
            runs = P.run_starts(numbers)
            head = np.stack([ids[numbers[runs]], ths[numbers[runs]], np.diff(runs, append=len(numbers))])
            return head.astype("<i8").tobytes()

        dup_no, dup_at = numbers[later], starts[later]
        order = np.argsort((dup_no << 32) | dup_at)
        if len(order):
            home = int(hashes[later][0] % np.uint64(buckets))  # this row only passes through its bucket
            put(home, documents(dup_no[order]), None, None, dup_at[order].astype("<u4").tobytes())
        hashes, numbers, starts = hashes[first], numbers[first], starts[first]
        bucket = _bucket_of(seconds[first], buckets)
        order = np.lexsort(((numbers << 32) | starts, bucket))
        bucket, hashes, numbers, starts = bucket[order], hashes[order], numbers[order], starts[order]
        cuts = P.bucket_cuts(bucket, buckets)
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            put(int(b), documents(numbers[part]), hashes[part].astype("<u8").tobytes(), starts[part].astype("<u4").tobytes(), None)
        return P.frames(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        ids_of, ths_of, numbers, hashes, seconds, starts, size, count = [], [], [], [], [], [], 0, 0
        for batch, a, z, ids, ths, found, words in _documents(batches):
            full, at = S.window_hashes(words, found.ptr, window)
            near = np.zeros(len(words) + 1, np.int64)
            marks = batch.column("hits").slice(a, z - a)
            for k in np.flatnonzero(~np.asarray(marks.is_null())):
                p = P.unpack_ascending(marks[int(k)].as_py()) + found.ptr[k]
                # a window holds the block at p if it starts in p - (window - block) .. p
                np.add.at(near, np.maximum(p - (window - block), found.ptr[k]), 1)
                near[p + 1] -= 1
            near = np.cumsum(near)
            keep = near[at] > 0
            owner = np.searchsorted(found.ptr, at[keep], side="right") - 1
            numbers.append(owner + count)
            hashes.append(full[keep])
            seconds.append(S.window_hashes(words, found.ptr, window, 1)[0][keep] if keep.any() else full[:0])
            starts.append(at[keep] - found.ptr[owner])
            ids_of.append(ids)
            ths_of.append(ths)
            count += len(ids)
            size += len(numbers[-1])
            if size >= FLUSH_WORDS:
                yield rows(*map(np.concatenate, (ids_of, ths_of, numbers, hashes, seconds, starts)))
                ids_of, ths_of, numbers, hashes, seconds, starts, size, count = [], [], [], [], [], [], 0, 0
        if size:
            yield rows(*map(np.concatenate, (ids_of, ths_of, numbers, hashes, seconds, starts)))

    return run


def _first_starts(homes: int):
    """Step 3: of the windows of one bucket, those that are not the first with their sequence, in
    one row for each home, a group of documents."""
    schema = P.arrow_schema(_LATER)

    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        ids, ths, hashes, starts, lost = [], [], [], [], []
        for doc, h, at, local in zip(*(table.column(x).to_pylist() for x in ("doc", "hashes", "places", "local")), strict=True):
            i, t, n = np.frombuffer(doc, "<i8").reshape(3, -1)
            passed = local is not None
            ids.append(np.repeat(i, n))
            ths.append(np.repeat(t, n))
            starts.append(np.frombuffer(local if passed else at, "<u4"))
            hashes.append(np.zeros(len(starts[-1]), np.uint64) if passed else np.frombuffer(h, "<u8"))
            lost.append(np.full(len(starts[-1]), passed))
        i, t, h, at, later = map(np.concatenate, (ids, ths, hashes, starts, lost))
        order = np.lexsort((at, t, i, h, later))
        i, t, h, at, later = i[order], t[order], h[order], at[order], later[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (later[1:] != later[:-1])))
        runs = np.flatnonzero(fresh)
        head = np.repeat(runs, np.diff(runs, append=len(h)))
        later |= (i != i[head]) | (t != t[head]) | (at != at[head])
        i, t, at = i[later], t[later], at[later].astype(np.int64)
        home = (S.mix(i.view(np.uint64) ^ t.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
        order = np.lexsort((at, t, i, home))
        i, t, at, home = i[order], t[order], at[order], home[order]
        out: dict[str, list] = {k: [] for k in schema.names}
        for part in np.split(np.arange(len(i)), P.run_starts(home)[1:]) if len(i) else []:
            docs = np.flatnonzero(np.concatenate(([True], (i[part][1:] != i[part][:-1]) | (t[part][1:] != t[part][:-1]))))
            out["home"].append(int(home[part[0]]))
            out["doc"].append(np.stack([i[part][docs], t[part][docs], np.diff(docs, append=len(part))]).astype("<i8").tobytes())
            out["places"].append(P.pack_counts(_gaps(at[part], docs)))
        return pa.Table.from_batches([P.frames(schema, out)])

    return run


def _gaps(places: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ascending places of each document as gaps; the first of each as it is."""
    gaps = np.diff(places, prepend=0)
    gaps[begin] = places[begin]
    return gaps


def _gather(table: pa.Table) -> pa.Table:
    """The repeated windows of each document of one home."""
    ids, ths, starts = [], [], []
    for doc, packed in zip(table.column("doc").to_pylist(), table.column("places").to_pylist(), strict=True):
        i, t, n = np.frombuffer(doc, "<i8").reshape(3, -1)
        sums = np.cumsum(P.unpack_counts(packed))
        begin = np.cumsum(n) - n
        starts.append(sums - np.repeat(np.concatenate(([0], sums[begin[1:] - 1])), n))
        ids.append(np.repeat(i, n))
        ths.append(np.repeat(t, n))
    i, t, at = map(np.concatenate, (ids, ths, starts))
    order = np.lexsort((at, t, i))
    i, t, at = i[order], t[order], at[order]
    cuts = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]))))
    parts = [P.pack_ascending(P.sorted_distinct(x)) for x in np.split(at, cuts[1:])]
    return pa.Table.from_batches([P.frames(P.arrow_schema(_REPEATS), {"doc_id": i[cuts].tolist(), "th": t[cuts].tolist(), "repeats": parts})])


def _finish(window: int, cut_text: bool):
    """Apply the repeats: counts, removed spans, and the digest of what is kept or the cut text."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])

    @F.arrow_udf("n_words long, n_removed long, spans array<array<int>>, kept string")
    def run(text: pa.Array, repeats: pa.Array) -> pa.Array:
        np.seterr(over="ignore")
        data, offsets = S.text_buffers(text)
        parts = []
        for a, z in S.pieces(offsets, PIECE_BYTES):
            base = offsets[a]
            found = S.scan(data[base : offsets[z]], offsets[a : z + 1] - base)
            gone = np.zeros(len(found.starts) + 1, np.int64)
            marks = repeats.slice(a, z - a)
            for k in np.flatnonzero(~np.asarray(marks.is_null())):
                p = P.unpack_ascending(marks[int(k)].as_py()) + found.ptr[k]
                gone[p] += 1
                gone[p + window] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[found.ptr[1:]] - sums[found.ptr[:-1]]
            kept = _cut(text.slice(a, z - a), found, gone, removed) if cut_text else pa.array(_digests(found, gone))
            fields = [pa.array(np.diff(found.ptr)), pa.array(removed), pa.array(_spans(gone, found.ptr), kind.field("spans").type), kept]
            parts.append(pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(fields, kind, strict=True)], fields=list(kind)))
        P.give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def _spans(gone: np.ndarray, ptr: np.ndarray) -> list[list[list[int]]]:
    """Removed runs of words of each document as [first, end) pairs."""
    out: list[list[list[int]]] = [[] for _ in range(len(ptr) - 1)]
    if gone.any():
        edge = np.zeros(len(gone) + 1, bool)
        edge[ptr] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
        end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        for k, b, e in zip(np.searchsorted(ptr, begin, side="right") - 1, begin, end, strict=True):
            out[k].append([int(b - ptr[k]), int(e - ptr[k])])
    return out


def _digests(found: S.Scan, gone: np.ndarray) -> list[str]:
    """sha256 of the kept words of each document, joined by one space."""
    kept = np.flatnonzero(~gone)
    starts, lengths = found.starts[kept], found.ends[kept] - found.starts[kept]
    # a word and a space after it; the space after a document's last word is left out below
    take = P.gather_ranges(starts, lengths + 1)
    padded = np.append(found.data, np.uint8(32))[take]
    padded[np.cumsum(lengths + 1) - 1] = 32
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))[np.searchsorted(kept, found.ptr)]
    raw = memoryview(padded.tobytes())
    return [hashlib.sha256(raw[a : max(a, z - 1)]).hexdigest() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def _cut(texts: pa.Array, found: S.Scan, gone: np.ndarray, removed: np.ndarray) -> pa.Array:
    """The texts without the removed words and the space after each; texts that lose none are as before."""
    out = texts.to_pylist()
    raw = found.data.tobytes()
    for k in np.flatnonzero(removed):
        lo, hi = found.ptr[k], found.ptr[k + 1]
        ends = np.append(found.starts[lo + 1 : hi], found.offsets[k + 1])
        lost = gone[lo:hi]
        begin, finish = found.starts[lo:hi][~lost], ends[~lost]
        out[k] = b"".join(raw[a:z] for a, z in zip(begin.tolist(), finish.tolist(), strict=True)).decode()
    return pa.array(out, pa.string())


def _repeats(base: DataFrame, window: int, size: int) -> DataFrame:
    """doc_id, th and the starts of the repeated windows of each document that has some."""
    block, buckets = (window + 1) // 2, max(32, -(-size // (6 * BUCKET_WORDS)))
    probes = base.mapInArrow(_probe(block, buckets), _PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_classes, _PROBES).groupBy("flush").applyInArrow(_return_hits, _HITS)
    hits = hits.groupBy("doc_id", "th").agg(F.max("hits").alias("hits"))  # equal rows: either set holds all true hits
    windows = base.join(hits, ["doc_id", "th"], "left").mapInArrow(_extend(window, block, buckets), _WINDOWS)
    later = windows.groupBy("bucket").applyInArrow(_first_starts(max(8, size // HOME_BYTES)), _LATER)
    return later.groupBy("home").applyInArrow(_gather, _REPEATS)


def _keyed(docs: DataFrame, text: str, key: str) -> list:
    """A null doc_id is the least; xxhash64 tells rows of one doc_id apart."""
    return [F.coalesce(docs[key].cast("long"), F.lit(LEAST)).alias("doc_id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")]


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (removed runs of words as [first, end))."""
    if window < 2:
        raise ValueError("a window has two words at least")
    base = docs.select(*_keyed(docs, text, key))
    repeats = _repeats(base, window, P.total_bytes(docs, text))
    done = base.join(repeats, ["doc_id", "th"], "left").select("doc_id", _finish(window, False)("text", "repeats").alias("done"))
    return done.select(F.expr(f"nullif(doc_id, {LEAST}L)").alias("doc_id"), "done.n_words", "done.n_removed", F.col("done.kept").alias("kept_sha256"), "done.spans")


def cut_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of docs, with the repeated words cut out of the text column.

    A removed word goes with the separators after it; a text that loses nothing is unchanged, a
    text that loses all its words keeps only what stood before the first.
    """
    base = docs.select(*_keyed(docs, text, key))
    repeats = _repeats(base, window, P.total_bytes(docs, text))
    whole = docs.select(*_keyed(docs, text, key), F.struct(*[docs[c] for c in docs.columns if c != text]).alias("rest"))
    done = whole.join(repeats, ["doc_id", "th"], "left").select("text", "rest", _finish(window, True)("text", "repeats").alias("done"))
    kept = F.when(F.col("text").isNull(), None).otherwise(F.col("done.kept"))
    return done.select(*[kept.alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
