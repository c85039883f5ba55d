"""Log-probabilities of texts under a word n-gram model as a weighted backoff automaton.

Tokens are the words of a text with A-Z lower-cased, then one end token. The model smooths with
a Dirichlet prior: p(w) = (c(w) + 1) / (N + V + 1) and, for every longer context h with h' its
suffix, p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k). As an automaton: the contexts of training
texts are states; a seen n-gram hw is an arc with weight log10 p(w | h) from h to the longest suffix
of hw that is a state; a failure arc with weight log10(k / (c(h) + k)) leads from h to h'. A text is
scored by one pass from left to right: its state takes the arc of the next token if there is one,
else failure arcs until there is, and the weights on the way add up.

The counts cover all training texts and grow with them, so nothing is pruned and no table is
broadcast. The texts are dealt into batches of about BATCH_BYTES by a hash. A batch asks for its
own distinct n-grams: one packed row for each hash bucket, with the hashes and the counts that
the batch's training texts add. A bucket sums up the counts and answers each batch in the order
of its question, so an answer is one small number an n-gram. With the answers, a batch builds
the part of the automaton that some of its texts (of about TOGETHER tokens) can reach and traverses it,
these texts side by side, then that of the next. A word
that stands in every text costs one entry a batch. The text is shuffled once (both uses share the
exchange).

Texts of more than SEGMENT tokens are traversed in segments: a state hangs on the order - 1 tokens
before it alone, so a segment that first reads these from the empty context is in the state that
the whole text would be in.

The registered query takes order 3; other orders work too (`order`).

Edge cases: null and empty texts are the end token alone. Without training texts N = V = 0 and
every token has probability 1 in p(w). Repeated rows score alike; a null key is kept; very long texts
are one batch with others or alone, read whole. An empty table gives an empty result. Columns of docs
other than the key and the text are read by `learn` only, whatever their names. N-grams are told apart
by HASH_BITS bits of a hash within their bucket of about BUCKET_WORDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textscan as S

ORDER = 3
STRENGTH = 200.0
BATCH_BYTES = 16 << 20
BUCKET_WORDS = 1_000_000
FLUSH_WORDS = 2_000_000
PIECE_BYTES = 1 << 20
RUN, TOGETHER = 1 << 16, 1 << 19
HASH_BITS = 48
SEGMENT = 512
END, BEGIN = np.uint64(0x1D2B4E6F9A8C7031), np.uint64(0x7F3C9E51B2D4A687)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROWS = "bucket int, batch long, hashes binary, counts binary"


def token_hashes(column: pa.Array, begin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text (with a begin mark in front, if asked for) and their bounds."""
    data, offsets = S.text_buffers(column)
    parts, sizes = [], []
    for a, z in S.pieces(offsets, PIECE_BYTES):
        found = S.scan(LOWER[data[offsets[a] : offsets[z]]], offsets[a : z + 1] - offsets[a])
        n = np.diff(found.ptr)
        ptr = np.concatenate(([0], np.cumsum(n + 1 + begin)))
        out = np.empty(ptr[-1], np.uint64)
        if begin:
            out[ptr[:-1]] = BEGIN
        out[ptr[1:] - 1] = END
        out[P.gather_ranges(ptr[:-1] + begin, n)] = found.word_hashes()
        parts.append(out)
        sizes.append(n + 1 + begin)
    return (np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))) if parts else (np.zeros(0, np.uint64), np.zeros(1, np.int64))


class Buckets:
    """Equal slices of the hash space, 2**log2 of them; a key is a bucket and HASH_BITS bits within it."""

    def __init__(self, least: int) -> None:
        self.log2 = max(0, least - 1).bit_length()
        self.bits = min(HASH_BITS, 63 - self.log2)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.log2 - self.bits)

    def packed(self, keys: np.ndarray) -> Iterator[tuple[int, slice, bytes]]:
        """Each bucket that sorted keys fall into, where they lie and what is left of them, packed."""
        cuts = np.searchsorted(keys >> np.uint64(self.bits), np.arange((1 << self.log2) + 1, dtype=np.uint64))
        mask = np.uint64((1 << self.bits) - 1)
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            yield int(b), part, P.pack_sorted(keys[part] & mask, self.bits)


def corpus_size(texts: DataFrame, buckets: Buckets) -> tuple[int, int]:
    """Tokens (N) and distinct tokens (V) of the texts in the column `text`."""
    schema = P.arrow_schema("bucket int, n long, hashes binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held, size, tokens = [], 0, 0

        def rows() -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in schema.names}
            for k, (b, _, packed) in enumerate(buckets.packed(P.sorted_distinct(np.concatenate(held)))):
                for name, value in zip(schema.names, (b, 0 if k else tokens, packed), strict=True):
                    out[name].append(value)
            return P.frames(schema, out)

        for batch in P.column_batches(batches):
            hashes, _ = token_hashes(batch.column(0), False)
            held.append(P.sorted_distinct(buckets.keys(hashes)))
            size += len(held[-1])
            tokens += len(hashes)
            if size >= FLUSH_WORDS:
                yield rows()
                held, size, tokens = [], 0, 0
        if size:
            yield rows()

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.concatenate([P.unpack_sorted(x) for x in table.column("hashes").to_pylist()])
        return pa.table({"n": [sum(table.column("n").to_pylist())], "v": [len(P.sorted_distinct(keys))]})

    asked = texts.select("text").mapInArrow(ask, "bucket int, n long, hashes binary")
    r = asked.groupBy("bucket").applyInArrow(distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(r[0] or 0), int(r[1] or 0)


def gram_keys(tokens: np.ndarray, ptr: np.ndarray, n: int, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The key of each n-gram of the texts and the token it ends at; worked out for texts of about RUN tokens at a time."""
    if n == 1:
        return buckets.keys(tokens), np.arange(len(tokens), dtype=np.int32)
    size = int(np.maximum(np.diff(ptr) - n + 1, 0).sum())
    keys, ends, at = np.empty(size, np.uint64), np.empty(size, np.int32), 0
    for a, z in S.pieces(ptr, RUN):
        hashes, first = S.window_hashes(tokens[ptr[a] : ptr[z]], ptr[a : z + 1] - ptr[a], n)
        part = slice(at, at + len(hashes))
        keys[part], ends[part] = buckets.keys(hashes), first + (ptr[a] + n - 1)
        at = part.stop
    return keys, ends


def merging(levels: list[np.ndarray], buckets: Buckets) -> Iterator[tuple[slice, list[slice], np.ndarray]]:
    """How the sorted keys of all levels merge, about RUN at a time: where they come to lie, where they lie in each
    level, and the order that sorts them when these are put end to end. The same for the question and its answer."""
    bits, at = buckets.log2 + buckets.bits, 0
    log2 = min(bits, (sum(map(len, levels)) // RUN).bit_length())
    edges = np.arange(1, 1 << log2, dtype=np.uint64) << np.uint64(bits - log2)
    cuts = [np.concatenate(([0], np.searchsorted(k, edges), [len(k)])).tolist() for k in levels]
    for k in range(1 << log2):
        own = [slice(c[k], c[k + 1]) for c in cuts]
        by = P.sorting_order(np.concatenate([x[o] for x, o in zip(levels, own, strict=True)]), bits)
        yield slice(at, at + len(by)), own, by
        at += len(by)


def question(column: pa.Array, train: np.ndarray, order: int, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the n-grams of each level, sorted, and how often the training texts have each."""
    tokens, ptr = token_hashes(column, True)
    held = np.repeat(~train, np.diff(ptr))
    levels, counts = [], []
    for n in range(1, order + 1):
        marked, ends = gram_keys(tokens, ptr, n, buckets)
        marked <<= np.uint64(1)
        marked |= held[ends]
        del ends
        marked.sort()
        trained = marked.astype(np.uint8) & 1 == 0
        marked >>= np.uint64(1)
        begin = P.run_starts(marked)
        levels.append(marked[begin])
        counts.append(np.add.reduceat(trained, begin, dtype=np.uint32) if len(begin) else np.zeros(0, np.uint32))
        del marked, trained, begin
    del tokens, held
    keys, trained = (np.empty(sum(map(len, x)), x[0].dtype) for x in (levels, counts))
    for at, own, by in merging(levels, buckets):
        for out, x in ((keys, levels), (trained, counts)):
            out[at] = np.concatenate([y[o] for y, o in zip(x, own, strict=True)])[by]
    return keys, trained


class Grams:
    """The distinct n-grams of a run of texts, level by level: `at[n - 1]` has for each token the number of the
    n-gram that ends there (-1 where the text has fewer tokens)."""

    def __init__(self, column: pa.Array, order: int, buckets: Buckets) -> None:
        tokens, self.ptr = token_hashes(column, True)
        self.buckets, self.keys, self.at = buckets, [], []
        for n in range(1, order + 1):
            keys, ends = gram_keys(tokens, self.ptr, n, buckets)
            if n == order:
                del tokens
            by = P.sorting_order(keys, buckets.log2 + buckets.bits)
            keys = keys[by]
            ends = ends[by]
            del by
            begin = P.run_starts(keys)
            at = np.full(self.ptr[-1], -1, np.int32)
            at[ends] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(begin, append=len(keys)))
            self.keys.append(keys[begin])
            self.at.append(at)
            del keys, ends, begin

    def part(self, first: int, last: int, counts: list[np.ndarray]) -> tuple[Grams, list[np.ndarray]]:
        """The n-grams of the texts from first to before last, without their keys, and their counts."""
        out = Grams.__new__(Grams)
        out.ptr = self.ptr[first : last + 1] - self.ptr[first]
        out.buckets, out.keys, out.at, found = self.buckets, [], [], []
        for at, c in zip(self.at, counts, strict=True):
            at = at[self.ptr[first] : self.ptr[last]]
            there = np.zeros(len(c) + 1, bool)  # one more for the tokens without an n-gram
            there[at] = True
            there[-1] = False
            number = np.cumsum(there, dtype=np.int32)
            number -= 1
            number[-1] = -1
            out.at.append(number[at])
            found.append(c[there[:-1]])
        return out, found

    def dealt(self, answer: np.ndarray) -> list[np.ndarray]:
        """Counts in the order of the question, by level."""
        out = [np.empty(len(k), answer.dtype) for k in self.keys]
        for at, own, by in merging(self.keys, self.buckets):
            part = np.empty(len(by), answer.dtype)
            part[by] = answer[at]
            for x, o, y in zip(out, own, np.split(part, np.cumsum([o.stop - o.start for o in own])[:-1]), strict=True):
                x[o] = y
        return out


class BackoffAutomaton:
    """The part of the automaton that the texts of a batch can reach.

    State 0 is the empty context; each state has the tokens of its context (`depth`), the state that its
    failure arc leads to and that arc's weight (`failure`, `backoff`). Arcs have a weight and the state
    they lead to. `fits[n]` has for every token of the batch the arc with that token out of the
    context of the n tokens before it, -1 if there is none; so the arc of a state and the next token is
    found in one step. `starts` has the state behind each text's begin mark.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, strength: float) -> None:
        order = self.order = len(counts)
        self.unseen = -np.log10(total + distinct + 1.0)
        numbers, sizes = [], [1]  # the states: the empty context, then the contexts of one token, of two, ..
        for c in counts[: order - 1]:
            numbers.append(np.where(c > 0, sum(sizes) + np.cumsum(c > 0) - 1, -1).astype(np.int32))
            sizes.append(int((c > 0).sum()))
        self.depth = np.repeat(np.arange(order, dtype=np.int8), sizes)
        self.failure, self.backoff = np.zeros(len(self.depth), np.int32), np.zeros(len(self.depth))
        self.fits = np.empty((order, len(grams.at[0])), np.int32)
        weights, targets, arcs = [], [], 0
        p = (counts[0] + 1.0) / (total + distinct + 1)
        for n in range(1, order + 1):
            c, ends = counts[n - 1], np.flatnonzero(grams.at[n - 1] >= 0)
            last = np.empty(len(c), np.int32)  # a token that each n-gram ends at
            last[grams.at[n - 1][ends]] = ends
            seen = np.flatnonzero(c > 0)
            fails = np.zeros(len(seen), np.int32)
            if n > 1:
                context, suffix = grams.at[n - 2][last - 1], grams.at[n - 2][last]
                p = (c + strength * p[suffix]) / (counts[n - 2][context] + strength)
                fails = numbers[n - 2][suffix[seen]]
            if n < order:
                own = numbers[n - 1][seen]
                self.failure[own] = fails
                self.backoff[own] = np.log10(strength / (c[seen] + strength))
            arc = np.full(len(c) + 1, -1, np.int32)  # one more for the tokens without an n-gram
            arc[seen] = arcs + np.arange(len(seen))
            arcs += len(seen)
            self.fits[n - 1] = arc[grams.at[n - 1]]
            weights.append(np.log10(p[seen]))
            targets.append(own if n < order else fails)
        self.arc_weights, self.arc_targets = np.concatenate(weights), np.concatenate(targets)
        self.starts = np.maximum(numbers[0][grams.at[0][grams.ptr[:-1]]], 0) if order > 1 else np.zeros(len(grams.ptr) - 1, np.int32)

    def step(self, states: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that the tokens at these places lead to, and the weights of the arcs on the way."""
        to, weights = np.zeros(len(states), np.int32), np.zeros(len(states))
        open_, at = np.arange(len(states)), states
        while len(open_):
            arcs = self.fits[self.depth[at], tokens[open_]]
            taken = arcs >= 0
            done, arcs = open_[taken], arcs[taken]
            to[done] = self.arc_targets[arcs]
            weights[done] += self.arc_weights[arcs]
            open_, at = open_[~taken], at[~taken]
            weights[open_] += np.where(at == 0, self.unseen, self.backoff[at])  # no training text has the token
            inner = at > 0
            open_, at = open_[inner], self.failure[at[inner]]
        return to, weights

    def traverse(self, ptr: np.ndarray, segment: int | None = None) -> np.ndarray:
        """The weight of each token, 0 for the begin marks: one pass from left to right, with the state of
        every text (or segment of a long one) carried from token to token."""
        segment = max(segment or SEGMENT, self.order)
        sizes = np.diff(ptr) - 1
        parts = -(-sizes // segment)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        warm = np.where(number > 0, self.order - 1, 0)
        begin = ptr[text] + 1 + number * segment - warm
        length = np.minimum(segment, sizes[text] - number * segment) + warm
        states = np.where(number > 0, 0, self.starts[text])
        by = np.argsort(-length, kind="stable")
        begin, states, warm = begin[by], states[by], warm[by]
        left = np.searchsorted(-length[by], -np.arange(int(length.max(initial=0))))  # segments longer than t
        out = np.zeros(self.fits.shape[1])
        for t, n in enumerate(left.tolist()):
            at = begin[:n] + t
            states, weights = self.step(states[:n], at)
            if t < self.order - 1:
                read = warm[:n] <= t
                at, weights = at[read], weights[read]
            out[at] = weights
        return out


def _ask(order: int, buckets: Buckets):
    schema = P.arrow_schema(_ROWS)

    def run(table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        batch = table.column("batch")[0].as_py()
        keys, counts = question(table.column("text"), np.asarray(table.column("train")), order, buckets)
        out: dict[str, list] = {k: [] for k in schema.names}
        for b, part, packed in buckets.packed(keys):
            for name, value in zip(schema.names, (b, batch, packed, P.pack_counts(counts[part])), strict=True):
                out[name].append(value)
        del keys, counts
        made = pa.Table.from_batches([P.frames(schema, out)])
        out.clear()
        P.give_back()
        return made

    return run


def _answer(table: pa.Table) -> pa.Table:
    schema = P.arrow_schema(_ROWS)
    hashes = [P.unpack_sorted(x) for x in table.column("hashes").to_pylist()]
    counts = [P.unpack_counts(x) for x in table.column("counts").to_pylist()]
    keys, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(keys)
    begin = P.run_starts(keys[order])
    totals = np.add.reduceat(n[order], begin)
    dealt = np.empty(len(keys), np.int64)
    dealt[order] = np.repeat(totals, np.diff(begin, append=len(keys)))
    bounds = np.cumsum([0, *map(len, hashes)])
    out = {"bucket": table.column("bucket").to_pylist(), "batch": table.column("batch").to_pylist(), "hashes": [None] * len(hashes)}
    out["counts"] = [P.pack_counts(dealt[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.Table.from_batches([P.frames(schema, out)])


def _score(order: int, buckets: Buckets, total: int, distinct: int, strength: float, names: list[str]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        grams = Grams(texts.column("text"), order, buckets)
        packed = answers.column("counts").take(pc.sort_indices(answers.column("bucket"))).to_pylist()
        answer, at = np.empty(sum(map(len, grams.keys)), np.uint32), 0
        for part in map(P.unpack_counts, packed):
            answer[at : at + len(part)] = part
            at += len(part)
        assert at == len(answer), "an answer has a count for each n-gram asked"
        del packed
        counts = grams.dealt(answer)
        grams.keys.clear()
        del answer
        sizes = np.diff(grams.ptr) - 1
        known, base, score = np.empty(len(sizes), np.int64), np.empty(len(sizes)), np.empty(len(sizes))
        for first, last in S.pieces(grams.ptr, TOGETHER):
            some, own = grams.part(first, last, counts)
            begin, words = some.ptr[:-1], some.at[0]
            values = BackoffAutomaton(some, own, total, distinct, strength).traverse(some.ptr)
            for out, value in ((score, values), (base, np.log10((own[0] + 1.0) / (total + distinct + 1))[words]), (known, (own[0] > 0).astype(np.int64)[words])):
                value[begin] = 0  # the begin mark is no token
                out[first:last] = np.add.reduceat(value, begin)
            del some, own, words, values, value
        del grams, counts
        P.give_back()
        columns = [texts.column("key"), texts.column("train"), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names=names)

    return run


def score_texts(docs: DataFrame, learn: Column, order: int = ORDER, strength: float = STRENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score and score of every row; counts n-grams
    where `learn` holds."""
    size = P.total_bytes(docs, text)
    batches, buckets = max(8, -(-size // BATCH_BYTES)), Buckets(max(32, -(-size * order // (8 * BUCKET_WORDS))))
    train = F.coalesce(learn, F.lit(False))
    total, distinct = corpus_size(docs.where(train).select(F.col(text).alias("text")), Buckets(max(16, (1 << buckets.log2) // 4)))
    batch = F.pmod(F.xxhash64(F.lit(3), F.col(key), F.col(text)), F.lit(batches))
    dealt = docs.select(batch.alias("batch"), F.col(key).alias("key"), train.alias("train"), F.col(text).alias("text"))
    asked = dealt.groupBy("batch").applyInArrow(_ask(order, buckets), _ROWS)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ROWS)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{key}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(order, buckets, total, distinct, strength, names), schema)
