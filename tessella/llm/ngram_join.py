"""Similarity self-join on word n-grams by chosen paths.

A text's set holds its distinct runs of `width` words (of all its words, if it has fewer). Two
sets are linked at Jaccard similarity `threshold` or more; linked sets and copies form classes.

1. Texts with the same set are one node; copies are never compared, they only carry the class.
2. Chosen paths. In each run a set samples the FAN tokens with the least hash under the run's
   seed; each is a path of length one, and the sets that chose a path are its bucket. A shared
   token is chosen by both unless all the least ones of the union are unshared, so a run
   misses a pair at the threshold with probability of at most (1 - threshold) ** FAN a level.
   The runs are as many as the target `recall` needs under that bound.
   Linked sets have similar sizes, so a path goes with a size class: SIZE_STEPS steps of the factor
   1 / threshold wide; a set within one step of the next class chooses its paths there too.
3. A bucket of more than SMALL sets is split: its sets choose FAN further tokens each, by hashes
   seeded with the path. A bucket is dense if one token would take more than half of its sets
   along, which about PROBE of its sets tell: splitting near copies only multiplies their work. Dense
   buckets and those of the last level are compared whatever their size.
4. A small bucket is compared by brute force: exact intersections by a product of incidence
   matrices over the tokens that two sets or more have. A pair that shares several small buckets is
   counted in the one with the least path only; buckets with the same members are one.
5. Near copies share many dense buckets. Each set has one home, the largest of its dense buckets, and is
   dealt to chunks of about CHUNK sets and CHUNK_TOKENS tokens of its home. Two homes meet if some dense
   bucket has sets of both; their chunks are compared pair by pair, so two sets are compared once, however
   many dense buckets they share, and no task holds an unbounded group. Pairs that share a dense
   bucket are counted there and in no small one.

A comparison returns one row a set (its links, and an edge to the least set it is joined with), not
its pairs; the classes are the connected components of these edges.

Result: one row for each row of the input with set_id (least doc_id with the same set), class_id
(least doc_id of the class), n_copies (rows with the same set) and n_links (other sets linked to
this one).

Scale. Texts are read twice, the second time only those that share a path with another; tokens
are shipped once for each small bucket, and once for each chunk that their home's chunk meets. Exact
copies collapse before any comparison and hot paths are counted with partial sums. The links of a
group of n different near copies are n * (n - 1) / 2 by definition; they are counted in chunks, with a few
bits of work a pair.

Edge cases: texts without words are classes of their own without links or copies. Null doc_ids
count as the least number. Rows with the same doc_id are different documents if their texts
differ, and copies if not. A very long text is a set like any other; sets of more than CHUNK_TOKENS
tokens are compared in chunks of their own. An empty table gives an empty result. Other columns,
whatever their names, are not read. Tokens are told apart by 64-bit hashes in a text, and by
TOKEN_BYTES bytes of them between the sets of one comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textscan as S
from .components import components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 1 - 1e-6
FAN = 4
LEVELS = 3
SMALL = 200
PROBE = 64
CHUNK = 400
CHUNK_TOKENS = 400_000
SIZE_STEPS = 3
PIECE_BYTES = 1 << 20
COLUMNS = 8_192
FLUSH_ROWS = 50_000
BROADCAST_PATHS = 50_000
LEAST = -(1 << 63)
TOKEN_BYTES = 6


def runs_for(recall: float, threshold: float, fan: int = FAN, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most."""
    level = (1 - threshold) ** fan
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - level) ** levels))) if level else 1


class Sets:
    """The token sets of a run of texts: sorted distinct tokens, ptr[k] to ptr[k+1] for text k."""

    def __init__(self, found: S.Scan, width: int) -> None:
        hashes = found.word_hashes()
        n = len(found.ptr) - 1
        words = np.diff(found.ptr)
        grams, at = S.window_hashes(hashes, found.ptr, width)
        own = np.searchsorted(found.ptr, at, side="right") - 1
        short = np.flatnonzero((words > 0) & (words < width))
        whole = [S.window_hashes(hashes[found.ptr[k] : found.ptr[k + 1]], np.array([0, words[k]]), int(words[k]))[0] for k in short]
        grams = np.concatenate([grams, *whole])
        own = np.concatenate([own, short])
        # 40 bits of the hash under the number of the text (a piece has fewer than 2**24 of them) order the
        # tokens; where they cannot tell two tokens apart, the whole hashes do
        keys = (own.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))
        order = P.sorting_order(keys)
        keys, tokens = keys[order], grams[order]
        same = keys[1:] == keys[:-1]
        if (same & (tokens[1:] != tokens[:-1])).any():
            order = np.lexsort((tokens, keys))
            keys, tokens = keys[order], tokens[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = ~same | (tokens[1:] != tokens[:-1])
        self.tokens = tokens[fresh]
        self.ptr = np.searchsorted(keys[fresh] >> np.uint64(40), np.arange(n + 1, dtype=np.uint64))
        self.sizes = np.diff(self.ptr)

    def identity(self, seed: int) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[full] = np.add.reduceat(S.mix(self.tokens + np.uint64(seed << 40)), self.ptr[full])
        return out

    def chosen(self, seed: int) -> np.ndarray:
        """Paths of length one of this run, FAN columns; a set of fewer tokens repeats its last."""
        out = np.zeros((len(self.sizes), FAN), np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            hashes = S.mix(self.tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            own = np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes)
            ordered = P.sorting_order((own << np.uint64(40)) | (hashes >> np.uint64(24)))
            at = self.ptr[full, None] + np.minimum(np.arange(FAN), self.sizes[full, None] - 1)
            out[full] = S.mix(hashes[ordered[at]] ^ np.uint64((seed + 1) << 40))
        return out


def size_classes(size: int, threshold: float) -> list[int]:
    """The classes of a set of this size: any two sets whose sizes can reach the threshold share one."""
    step = -math.log(threshold) if threshold < 1 else 1.0
    at = math.log(size) / step
    own = math.floor(at / SIZE_STEPS)
    return [own, own + 1] if at + 1 + 1e-9 >= (own + 1) * SIZE_STEPS else [own]


def longer_paths(tokens: np.ndarray, path: int) -> np.ndarray:
    """The FAN paths that go on from `path` in the set of these tokens."""
    hashes = np.sort(S.mix(tokens ^ S.mix(np.array([path], np.uint64))))[:FAN]
    return S.mix(hashes ^ np.uint64(path))


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = S.text_buffers(batch.column("text"))
    for a, z in S.pieces(offsets, PIECE_BYTES):
        yield a, z, Sets(S.scan(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]), width)


_SETS = "doc_id long, th long, sid long, check long, size long, paths binary"


def _describe(width: int, runs: int, threshold: float):
    schema = P.arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in P.column_batches(batches):
            for a, z, sets in _pieces(batch, width):
                paths = np.concatenate([sets.chosen(k) for k in range(runs)], axis=1).view(np.int64)
                packed = [_classed(p, int(n), threshold) for p, n in zip(paths, sets.sizes, strict=True)]
                columns = [batch.column("doc_id").slice(a, z - a), batch.column("th").slice(a, z - a), pa.array(sets.identity(1).view(np.int64)), pa.array(sets.identity(2).view(np.int64)), pa.array(sets.sizes), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _classed(paths: np.ndarray, size: int, threshold: float) -> bytes:
    """The distinct paths of a set in each of its size classes."""
    if not size:
        return b""
    paths = P.sorted_distinct(paths).view(np.uint64)
    return _pack_longs(np.concatenate([S.mix(paths + np.uint64((c + 2) * 0x9E3779B97F4A7C15 % (1 << 64))) for c in size_classes(size, threshold)]).view(np.int64))


def _pack_longs(values: np.ndarray) -> bytes:
    return values.astype("<i8").tobytes()


def longs(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8")


_EXPLODED = "sid long, size int, path long"


def _explode_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in P.column_batches(batches):
        paths = [longs(x) for x in batch.column("paths").to_pylist()]
        count = [len(x) for x in paths]
        sid, size = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), count) for c in ("sid", "size"))
        if len(sid):
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(size, pa.int32()), pa.array(np.concatenate(paths))], schema=P.arrow_schema(_EXPLODED))


def _buckets(paths: DataFrame, *more: str) -> DataFrame:
    """Paths that two sets or more chose: sets (n), tokens (total) and a hash of the members."""
    members = F.bit_xor(F.xxhash64("sid")).alias("members")
    return paths.groupBy("path", *more).agg(F.count("*").alias("n"), F.sum("size").alias("total"), members).where("n > 1")


def _once(buckets: DataFrame) -> DataFrame:
    """Of the buckets with the same members the one with the least path."""
    return buckets.groupBy("members", "n", "total").agg(F.min("path").alias("path")).select("path", "n", "total")


def pack_tokens(tokens: np.ndarray) -> np.ndarray:
    """TOKEN_BYTES bytes of each token, in rows."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]


def unpack_tokens(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel()


_ACTIVE = "sid long, size int, tokens binary, open boolean"


def _tokens(width: int):
    """The tokens of each set, from its text; open: whether it is in a large bucket."""
    schema = P.arrow_schema(_ACTIVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in P.column_batches(batches):
            for a, z, sets in _pieces(batch, width):
                raw = pack_tokens(sets.tokens)
                tokens = [raw[i:j].tobytes() for i, j in zip(sets.ptr[:-1], sets.ptr[1:], strict=True)]
                sid, open_ = (batch.column(c).slice(a, z - a) for c in ("sid", "open"))
                yield pa.RecordBatch.from_arrays([sid, pa.array(sets.sizes, pa.int32()), pa.array(tokens, pa.binary()), open_], schema=schema)

    return run


_LONGER = "sid long, size int, path long, parent long"


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths one step longer than each set's large ones."""
    np.seterr(over="ignore")
    schema = P.arrow_schema(_LONGER)
    for batch in P.column_batches(batches):
        out: dict[str, list] = {k: [] for k in schema.names}
        for sid, size, tokens, large in zip(*(batch.column(c) for c in ("sid", "size", "tokens", "large")), strict=True):
            own, sid, size = unpack_tokens(tokens.as_py()), sid.as_py(), size.as_py()
            for parent in large.as_py():
                longer = longer_paths(own, parent % (1 << 64)).view(np.int64).tolist()
                for name, value in zip(schema.names, ([sid] * len(longer), [size] * len(longer), longer, [parent] * len(longer)), strict=True):
                    out[name] += value
            if len(out["sid"]) > FLUSH_ROWS:
                yield P.frames(schema, out)
                out = {k: [] for k in schema.names}
        yield P.frames(schema, out)


def _longer(active: DataFrame, open_: DataFrame) -> DataFrame:
    asked = open_.groupBy("sid").agg(F.collect_list("path").alias("large"))
    if open_.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS:
        asked = F.broadcast(asked)
    return active.where("open").join(asked, "sid").mapInArrow(_go_on, _LONGER)


def dense_paths(active: DataFrame, open_: DataFrame) -> DataFrame:
    """The paths of open_ (sid, path, n) whose bucket is dense: of the about PROBE sets of it that a hash
    picks, one further token takes more than half along."""
    pick = F.pmod(F.xxhash64(F.lit(23), "path", "sid"), F.lit(1 << 30)) < F.lit(PROBE << 30) / F.col("n")
    probes = P.durable(open_.where(pick).select("sid", "path"))
    taken = probes.groupBy("path").agg(F.count("*").alias("probes"))
    most = _longer(active, probes).groupBy("parent", "path").count().groupBy(F.col("parent").alias("path")).agg(F.max("count").alias("most"))
    return taken.join(most, "path").where(2 * F.col("most") > F.col("probes")).select("path")


_FOUND = "sid long, links long, root long"


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of these lists of distinct values have in common (under 2**48)."""
    n = len(lists)
    keys = np.concatenate(lists).astype(np.uint64) << np.uint64(16)
    keys |= np.repeat(np.arange(n, dtype=np.uint64), [len(x) for x in lists])
    keys.sort()
    own, keys = (keys & np.uint64(0xFFFF)).astype(np.int32), keys >> np.uint64(16)
    begin = P.run_starts(keys)
    df = np.diff(begin, append=len(keys))
    shared = np.flatnonzero(df > 1)
    out = np.zeros((n, n), np.float32)
    for k in range(0, len(shared), COLUMNS):
        part = shared[k : k + COLUMNS]
        incidence = np.zeros((n, len(part)), np.float32)
        incidence[own[P.gather_ranges(begin[part], df[part])], np.repeat(np.arange(len(part)), df[part])] = 1
        out += incidence @ incidence.T
    return out


def _share(lists: list[np.ndarray]) -> np.ndarray:
    """Which two of these lists of paths have one in common."""
    some = P.sorted_distinct(np.concatenate(lists))
    return _common([np.searchsorted(some, x) for x in lists]) > 0 if len(some) else np.zeros((len(lists), len(lists)), bool)


def compare(sids: np.ndarray, sets: list[np.ndarray], paths: list[np.ndarray], dense: list[np.ndarray], path: int | None, sides: np.ndarray, cross: bool, threshold: Fraction) -> list[tuple[int, int, int]]:
    """The links of these sets that are counted here: (sid, links, least sid it is joined with).

    cross: only pairs with different sides. path None: pairs that share a dense path; else those that share
    none, and no small path less than `path`.
    """
    sizes = np.array([len(x) for x in sets])
    num, den = threshold.numerator, threshold.denominator
    link = _common(sets).astype(np.float64) * (num + den) >= num * (sizes[:, None] + sizes[None, :]).astype(np.float64)
    np.fill_diagonal(link, False)
    if cross:
        link &= sides[:, None] != sides[None, :]
    if not link.any():
        return []
    met = _share(dense)
    link &= met if path is None else ~(met | _share([x[x < path] for x in paths]))
    links = link.sum(axis=1)
    n = len(sids)
    root = np.arange(n)
    while True:  # labels of least members, spread along links
        spread = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        spread = np.minimum(spread, spread[spread])
        if (spread == root).all():
            break
        root = spread
    return [(int(sids[k]), int(links[k]), int(sids[root[k]])) for k in np.flatnonzero(links)]


_UNITS = "dense boolean, path long, i int, other long, j int, side int, sid long, paths binary, homes binary, tokens binary"
_KEY = ("dense", "path", "i", "other", "j")


def _compare_unit(threshold: Fraction):
    schema = P.arrow_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")
        dense, path, i, other, j = (table.column(x)[0].as_py() for x in _KEY)
        sets = [unpack_tokens(x) for x in table.column("tokens").to_pylist()]
        paths, homes = ([longs(x) for x in table.column(c).to_pylist()] for c in ("paths", "homes"))
        found = compare(table.column("sid").to_numpy(), sets, paths, homes, None if dense else path, table.column("side").to_numpy(), (path, i) != (other, j), threshold)
        return pa.Table.from_batches([P.frames(schema, {name: [r[k] for r in found] for k, name in enumerate(schema.names)})])

    return run


def _chunk_of(sid: int, chunks: int) -> int:
    return int(S.mix(np.array([sid % (1 << 64)], np.uint64))[0] % np.uint64(chunks)) if chunks > 1 else 0


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each comparison that a set takes part in: small buckets (large ones of tokens in pairs of
    chunks), and the pairs of chunks of its home and the homes that meet it."""
    schema = P.arrow_schema(_UNITS)
    np.seterr(over="ignore")
    for batch in P.column_batches(batches):
        out: dict[str, list] = {k: [] for k in schema.names}
        held = 0
        for r in zip(*(batch.column(x) for x in ("sid", "tokens", "kept", "dense", "home", "met")), strict=True):
            sid, tokens, kept, dense, home, met = (x.as_py() for x in r)
            paths, homes = (_pack_longs(np.array(sorted(x), np.int64)) for x in ([x["path"] for x in kept or ()], dense or ()))
            places = []  # (dense, own bucket, own chunk, other bucket, its chunks)
            for x in kept or ():
                chunks = -(-x["total"] // CHUNK_TOKENS) if x["total"] > 2 * CHUNK_TOKENS else 1
                places.append((False, x["path"], _chunk_of(sid, chunks), x["path"], chunks))
            for x in met or ():
                places.append((True, home, _chunk_of(sid, x["own"]), x["other"], x["chunks"]))
            for kind, own, at, other, chunks in places:
                for j in range(chunks):
                    a, b = min((own, at), (other, j)), max((own, at), (other, j))
                    for name, value in zip(schema.names, (kind, *a, *b, int((own, at) != a), sid, paths, homes, tokens), strict=True):
                        out[name].append(value)
                    held += len(tokens)
                    if held > PIECE_BYTES:
                        yield P.frames(schema, out)
                        out, held = {k: [] for k in schema.names}, 0
        if out["sid"]:
            yield P.frames(schema, out)


def _meetings(dense: DataFrame) -> DataFrame:
    """sid, dense (its dense paths), home and met (homes to compare it with: other, chunks of it, chunks of the
    own home). dense: sid, path, n, size."""
    own = P.durable(dense.groupBy("sid").agg(F.max(F.struct("n", "path")).alias("largest"), F.collect_set("path").alias("dense"), F.first("size").alias("size")))
    own = own.select("sid", F.col("largest.path").alias("home"), "dense", "size")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.col("size").cast("long")) / CHUNK_TOKENS)).cast("int")
    homes = own.groupBy("home").agg(chunks.alias("chunks"))
    there = own.select("home", F.explode("dense").alias("path")).distinct()
    pairs = there.join(there.withColumnRenamed("home", "other"), "path").select("home", "other").distinct()
    pairs = pairs.join(homes.withColumnRenamed("chunks", "own"), "home").join(homes.withColumnRenamed("home", "other"), "other")
    met = pairs.groupBy("home").agg(F.collect_list(F.struct("other", "chunks", "own")).alias("met"))
    return own.join(met, "home").select("sid", "dense", "home", "met")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), set_id, class_id, n_copies and n_links of every row."""
    exact = Fraction(threshold).limit_denominator(10_000)
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    described = P.durable(base.mapInArrow(_describe(width, runs_for(recall, threshold), threshold), _SETS))
    first = F.min(F.struct("doc_id", "th")).alias("first")
    nodes = P.durable(described.where("size > 0").groupBy("sid", "check").agg(first, F.count("*").alias("n_copies"), F.first("paths").alias("paths"), F.first("size").cast("int").alias("size")))
    # paths of length one, and the sets that share one
    paths = nodes.select("sid", "size", "paths").mapInArrow(_explode_paths, _EXPLODED)
    buckets = _buckets(paths)
    chosen = _once(buckets.where(F.col("n") <= SMALL)).unionByName(buckets.where(F.col("n") > SMALL).drop("members"))
    live = P.durable(paths.join(chosen, "path").select("sid", "path", "n", "total", "size"))
    shared = live.groupBy("sid").agg(F.max(F.col("n") > SMALL).alias("open"))
    wanted = nodes.select("sid", "first.doc_id", "first.th").join(shared, "sid")
    # equal rows of one doc_id and text are one; the join has brought them together
    texts = base.join(wanted, ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("sid").alias("sid"), F.first("text").alias("text"), F.first("open").alias("open"))
    active = P.durable(texts.select("sid", "text", "open").mapInArrow(_tokens(width), _ACTIVE))
    del paths, buckets, chosen, shared, wanted, texts
    P.release(docs.sparkSession)
    small, open_, dense = live.where(F.col("n") <= SMALL), live.where(F.col("n") > SMALL), live.limit(0)
    for depth in range(2, LEVELS + 1):
        if open_.isEmpty():
            break
        marked = P.durable(open_.join(dense_paths(active, open_).withColumn("dense", F.lit(True)), "path", "left"))
        dense = dense.unionByName(marked.where("dense").drop("dense"))
        level = P.durable(_longer(active, marked.where("dense IS NULL")))
        buckets = _buckets(level, "parent").drop("parent")
        chosen = _once(buckets.where(F.col("n") <= SMALL)).unionByName(buckets.where(F.col("n") > SMALL).drop("members"))
        found = P.durable(level.drop("parent").join(chosen, "path").select("sid", "path", "n", "total", "size"))
        small, open_ = small.unionByName(found.where(F.col("n") <= SMALL)), found.where(F.col("n") > SMALL)
    dense = dense.unionByName(open_)  # the last level's large buckets
    lists = small.groupBy("sid").agg(F.collect_set(F.struct("path", "n", "total")).alias("kept"))
    compared = active.select("sid", "tokens").join(lists, "sid", "left").join(_meetings(dense), "sid", "left").where("kept IS NOT NULL OR home IS NOT NULL")
    found = P.durable(compared.mapInArrow(_units, _UNITS).groupBy(*_KEY).applyInArrow(_compare_unit(exact), _FOUND))
    del active, live, small, open_, dense, lists, compared
    P.release(docs.sparkSession)
    links = found.groupBy("sid").agg(F.sum("links").alias("n_links"))
    joined = components(found.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    marked = nodes.join(links, "sid", "left").join(joined.withColumnRenamed("node", "sid"), "sid", "left")
    marked = marked.select("sid", "check", "first", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "sid").alias("component"))
    marked = P.durable(marked)
    del nodes, found, links, joined
    P.release(docs.sparkSession)
    classes = marked.groupBy("component").agg(F.min("first").alias("head"))
    marked = marked.join(classes, "component").select("sid", "check", "first", "head", "n_copies", "n_links")
    out = described.join(marked, ["sid", "check"], "left")
    clean = lambda c: F.when(c != LEAST, c)
    mine = lambda c: F.coalesce(F.col(c), F.struct("doc_id", "th"))
    is_head = (mine("head")["doc_id"] == F.col("doc_id")) & (mine("head")["th"] == F.col("th"))
    return out.select(
        clean(F.col("doc_id")).alias("doc_id"),
        "th",
        clean(mine("first")["doc_id"]).alias("set_id"),
        clean(mine("head")["doc_id"]).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        is_head.alias("is_head"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row of each class of near copies, with all its columns: the row of the least doc_id."""
    heads = ngram_join(docs, key=key, text=text, **more).where("is_head").select(F.coalesce("doc_id", F.lit(LEAST)).alias("head_id"), F.col("th").alias("head_th")).distinct()
    keyed = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LEAST)).alias("head_id"), F.xxhash64(docs[text]).alias("head_th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = keyed.join(heads, ["head_id", "head_th"], "left_semi").groupBy("head_id", "head_th").agg(F.first("row").alias("row"))
    return kept.select("row.*")
