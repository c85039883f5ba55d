"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source is cut into blocks of `block_rows` documents. In the fluid mix that the schedule follows, a
source of weight w gets w / W of every slot, W being the weights of the sources that still have rows:
when a source runs out, its share goes to the others. Block j (from 0) of a source has its release time
where its fluid share of the source begins, rounded down to a slot, and its deadline where that share
ends, rounded up (floor(j * W / w) and ceil((j + 1) * W / w) until a source runs out). Earliest deadline
first among the released blocks fills every slot with one block and keeps each source within less than
one block of its fluid share at every prefix (the shares add up to one processor, for which this
schedule is optimal). Weights are taken exactly, as fractions; nothing is rounded but the times.
Rows are never dropped or repeated.

Scale. A row's rank in its source comes from a count for each (source, slice of a hash space),
a running sum over these counts, and a row_number inside one slice; a source that holds a third
of all rows is thus spread over all its slices. The schedule hangs on the counts by source alone, which
come to the driver, a number a source. It is worked out there, slot by slot, since the bound holds for
the sequence only; a block has as many rows as it takes for about MAX_BLOCKS blocks in all (one row in
each source for smaller tables), so the driver's time and memory do not grow with the rows. The slots
go out in rows of CHUNK_BLOCKS blocks of a source, broadcast up to BROADCAST_BLOCKS blocks and joined by
a shuffle beyond (many sources of few rows). Blocks are laid out by a hash of doc_id and text, so the
order within a source is a fixed shuffle.

Edge cases: a null source is a source of its own. A source without a weight gets none in the
mix and comes after all others (weight 0). Empty tables give an empty result. Repeated rows have
places of their own. Null doc_ids and texts are ranked like any other value, and very long texts count
as one row. Columns named weight, block, slot or row_in_block are replaced; all others pass through.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BLOCKS = 1_000_000
BROADCAST_BLOCKS = 4_000_000
CHUNK_BLOCKS = 1024
SLICE_ROWS = 20_000


def exact_weights(weights: dict) -> dict:
    """The positive weights as the least integers in exactly their ratios."""
    positive = {k: Fraction(w) for k, w in weights.items() if w > 0}
    scale = math.lcm(*[w.denominator for w in positive.values()])
    out = {k: int(w * scale) for k, w in positive.items()}
    shared = math.gcd(*out.values())
    return {k: n // shared for k, n in out.items()}


class FluidMix:
    """The fluid mix of sources with these numbers of blocks and integer weights."""

    def __init__(self, blocks: list[int], weights: list[int]) -> None:
        self.blocks, self.weights = blocks, weights
        # sources in the order in which they run out, with the blocks and weights of those before and after
        self.order = sorted(range(len(blocks)), key=lambda i: (Fraction(blocks[i], weights[i]), i))
        self.done, self.open = [0], [sum(weights)]
        for i in self.order:
            self.done.append(self.done[-1] + blocks[i])
            self.open.append(self.open[-1] - weights[i])

    def time(self, i: int, x: int) -> tuple[int, int]:
        """Where source i has got x blocks, as a numerator and a denominator in slots."""
        w, low, high = self.weights[i], 0, len(self.order)
        while low < high:
            middle = (low + high) // 2
            k = self.order[middle]
            if self.blocks[k] * w <= x * self.weights[k]:
                low = middle + 1
            else:
                high = middle
        return self.done[low] * w + x * self.open[low], w


def block_slots(blocks: dict, weights: dict) -> dict:
    """The slot of every block of each source, by earliest deadline first. Sources without a weight follow
    the others, one after the other."""
    names = [k for k in blocks if k in weights and blocks[k]]
    mix = FluidMix([blocks[k] for k in names], [weights[k] for k in names])
    taken: dict = {k: array("q") for k in blocks}
    waiting = [(0, i) for i in range(len(names))]  # (release, source); sorted, so a heap
    ready: list[tuple[int, int]] = []  # (deadline, source)
    ends: list[tuple[int, int]] = [(0, 1)] * len(names)  # where the last block of each ends
    total = sum(mix.blocks)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            end = ends[i] = mix.time(i, len(taken[names[i]]) + 1)
            heapq.heappush(ready, (-(-end[0] // end[1]), i))
        deadline, i = heapq.heappop(ready)
        assert slot < deadline
        own = taken[names[i]]
        own.append(slot)
        if len(own) < mix.blocks[i]:
            heapq.heappush(waiting, (ends[i][0] // ends[i][1], i))
    for k in blocks:
        if k not in weights:
            taken[k].extend(range(total, total + blocks[k]))
            total += blocks[k]
    return taken


def _rank_in_source(docs: DataFrame, source: str, order: Column, rows: int) -> DataFrame:
    """docs (columns row, src, key) with the rank of each row in its source, by the order column."""
    slices = max(1, -(-rows // SLICE_ROWS))
    keyed = docs.withColumn("h", order).withColumn("slice", F.floor(F.shiftrightunsigned("h", 33).cast("double") / float(1 << 31) * slices).cast("int"))
    counts = keyed.groupBy("src", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("src").alias("s"), F.col("slice").alias("sl"), before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("src", "slice").orderBy("h", "tie"))
    ranked = keyed.withColumn("within", within)
    return ranked.join(offsets, F.col("src").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl"))).withColumn("rank", F.col("offset") + F.col("within") - 1)


def _plan_table(docs: DataFrame, source: str, slots: dict, weights: dict) -> DataFrame:
    """The slots as a table of one row for each source and CHUNK_BLOCKS blocks."""
    rows = [(k, chunk, float(weights.get(k, 0)), at[chunk * CHUNK_BLOCKS : (chunk + 1) * CHUNK_BLOCKS].tolist()) for k, at in slots.items() for chunk in range(-(-len(at) // CHUNK_BLOCKS))]
    schema = T.StructType(
        [
            T.StructField("plan_source", docs.schema[source].dataType),
            T.StructField("plan_chunk", T.LongType()),
            T.StructField("plan_weight", T.DoubleType()),
            T.StructField("plan_slots", T.ArrayType(T.LongType())),
        ]
    )
    table = docs.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if sum(map(len, slots.values())) <= BROADCAST_BLOCKS else table


def mix_sources(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_rows: int | None = None, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with weight (the target weight), block (of its source), slot and row_in_block.

    weights: target weight of each source; None takes rows ** power of each source, the usual
    flattened mix. block_rows: None takes as many as leave about MAX_BLOCKS blocks. Read the result in the
    order (slot, row_in_block) for the mix.
    """
    sizes = {r[0]: r[1] for r in docs.groupBy(source).count().collect()}
    added = {"weight": "double", "block": "bigint", "slot": "bigint", "row_in_block": "int"}
    if not sizes:
        return docs.withColumns({k: F.lit(None).cast(t) for k, t in added.items()}).limit(0)
    rows = sum(sizes.values())
    block_rows = block_rows or -(-rows // MAX_BLOCKS)
    wanted = weights if weights is not None else {k: float(n) ** power for k, n in sizes.items()}
    known = {k: w for k, w in wanted.items() if k in sizes and w > 0}
    blocks = {k: -(-n // block_rows) for k, n in sorted(sizes.items(), key=lambda x: str(x[0]))}
    slots = block_slots(blocks, exact_weights(known))
    packed = docs.select(F.struct("*").alias("row"), F.col(source).alias("src"), F.xxhash64(F.col(key), F.col(text)).alias("tie"))
    ranked = _rank_in_source(packed, source, F.xxhash64(F.lit(7), F.hash(F.col("tie")), F.col("tie")), rows)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("bigint")).withColumn("chunk", F.expr(f"block div {CHUNK_BLOCKS}"))
    met = ranked.join(_plan_table(docs, source, slots, known), F.col("src").eqNullSafe(F.col("plan_source")) & (F.col("chunk") == F.col("plan_chunk")))
    slot = F.get("plan_slots", (F.col("block") % CHUNK_BLOCKS).cast("int"))
    made = {"weight": F.col("plan_weight"), "block": F.col("block"), "slot": slot, "row_in_block": (F.col("rank") % block_rows).cast("int")}
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in made]
    return met.select(*kept, *[c.alias(k) for k, c in made.items()])


def in_mix_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows laid out in the order of the mix, range-partitioned by slot."""
    return mixed.repartitionByRange("slot", "row_in_block").sortWithinPartitions("slot", "row_in_block").select(*columns)


def places_in_mix(laid: DataFrame, to: str = "slot") -> DataFrame:
    """laid, read from the files that the rows of in_mix_order were written to, with each row's place in
    the mix (from 0). Readers pack files by size, so the place is taken from the number of the part
    file and the position in it, not from the order of reading."""
    name, number = F.col("_metadata.file_name"), lambda mark: F.regexp_extract("mix_file", mark, 1).cast("bigint")
    files = laid.select(name.alias("mix_file")).groupBy("mix_file").count().withColumns({"part": number(r"^part-(\d+)"), "piece": number(r"-c(\d+)\.")})
    counts = sorted(files.collect(), key=lambda r: (r.part, r.piece))
    begin, total = [], 0
    for r in counts:
        begin.append((r.mix_file, total))
        total += r["count"]
    offsets = F.broadcast(laid.sparkSession.createDataFrame(begin, "mix_file string, mix_begin bigint"))
    placed = laid.select(*[c for c in laid.columns if c != to], name.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    return placed.join(offsets, "mix_file").withColumn(to, F.col("mix_begin") + F.col("mix_row")).drop("mix_file", "mix_row", "mix_begin")
