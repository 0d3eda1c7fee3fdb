"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt to cells of bounded size. On every island of a cell a population of packings evolves: a
crossover injects whole well-filled bins of one parent into the other, bins that share a document with them are dissolved,
and the documents displaced go by best fit, longest first, into the room that is left. After every epoch the best packing
of an island migrates to the next one. A cell whose packing reaches the lower bound is proven best and rests. Bins that stay
loose are dissolved and their pieces dealt to fewer cells, until one cell holds them all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut_lineage, drop_lineage
from codefacts.llm.tokens import default_path, encode

WINDOW = 4096
END = 1
#: Tokens and pieces of a cell, about.
CELL_TOKENS = 2_000_000
CELL_PIECES = 8_000
ISLANDS = 2
POPULATION = 6
EPOCHS = 3
GENERATIONS = 8
#: Bins below this share of a window are dissolved for the next level.
LOOSE = 0.995


def _pieces(path: str, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()], path)):
                    wide = np.append(ids, np.uint16(END)).astype("<u4")
                    out += [(i, s // window, s, len(own := wide[s : s + window]), zlib.crc32(own.tobytes())) for s in range(0, len(wide), window)]
                own, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def best_fit(sizes: list[int], room: list[int], window: int) -> list[int]:
    """The bin of each size, taken in turn: the fullest one it fits in, of equals the one filled last; else a new bin.

    ``room`` is what each open bin has left and grows by the new bins. Bins wait in one list per room, and the bits of
    one number tell which lists hold any, so a search takes no scan.
    """
    waiting: dict[int, list[int]] = {}
    held = 0
    for b, r in enumerate(room):
        if r:
            waiting.setdefault(r, []).append(b)
            held |= 1 << r
    out = []
    for size in sizes:
        rest = held >> size
        if rest:
            r = size + (rest & -rest).bit_length() - 1
            own = waiting[r]
            b = own.pop()
            if not own:
                held ^= 1 << r
            r -= size
        else:
            b, r = len(room), window - size
            room.append(r)
        room[b] = r
        if r:
            own = waiting.setdefault(r, [])
            if not own:
                held |= 1 << r
            own.append(b)
        out.append(b)
    return out


def fitness(bins: np.ndarray, sizes: np.ndarray, window: int) -> tuple[int, float]:
    """Packings compare by the number of bins, then by the sum of squares of what bins lack: few loose bins are best."""
    fill = np.bincount(bins, weights=sizes)
    return -len(fill), float(((window - fill) ** 2).sum())


def cross(mother: np.ndarray, father: np.ndarray, sizes: np.ndarray, window: int, rng: np.random.Generator) -> np.ndarray:
    """A packing with whole well-filled bins of ``father`` and those bins of ``mother`` that share nothing with them."""
    full = np.bincount(father, weights=sizes)
    well = np.flatnonzero(full >= np.quantile(full, 0.25))
    chosen = np.zeros(len(full), bool)
    chosen[rng.choice(well, max(1, int(len(well) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = chosen[father]
    fill = np.bincount(mother, weights=sizes)
    broken = np.zeros(len(fill), bool)
    broken[mother[injected]] = True
    loosest = np.argsort(fill)[: 1 + int(0.05 * len(fill))]  # mutation: the loosest bins go as well
    broken[loosest] = True
    stays = ~broken[mother] & ~injected
    out = np.empty(len(sizes), np.int64)
    _, out[injected] = np.unique(father[injected], return_inverse=True)
    n = int(chosen.sum())
    if stays.any():
        _, kept = np.unique(mother[stays], return_inverse=True)
        out[stays] = kept + n
    placed = injected | stays
    room = (window - np.bincount(out[placed], weights=sizes[placed])).astype(int).tolist()
    displaced = np.flatnonzero(~placed)
    displaced = displaced[np.argsort(-sizes[displaced], kind="stable")]
    out[displaced] = best_fit(sizes[displaced].tolist(), room, window)
    return out


def founders(sizes: np.ndarray, window: int, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Packings by best fit in random orders."""
    out = []
    for _ in range(count):
        order = rng.permutation(len(sizes))
        bins = np.empty(len(sizes), np.int64)
        bins[order] = best_fit(sizes[order].tolist(), [], window)
        out.append(bins)
    return out


def evolve(people: list[np.ndarray], sizes: np.ndarray, window: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after some generations, best first: each child replaces the worst packing if it is better.

    Stops early where the best packing has as few bins as the sizes allow.
    """
    least = -(-int(sizes.sum()) // window)
    ranked = sorted(((fitness(p, sizes, window), p) for p in people), key=lambda x: (-x[0][0], -x[0][1]))
    for _ in range(generations * len(ranked) if len(ranked) > 1 else 0):
        if -ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        mother, father = ranked[min(a, b)][1], ranked[max(a, b)][1]
        if rng.random() < 0.5:
            mother, father = father, mother
        child = cross(mother, father, sizes, window, rng)
        own = fitness(child, sizes, window)
        if own > ranked[-1][0]:
            ranked[-1] = (own, child)
            ranked.sort(key=lambda x: (-x[0][0], -x[0][1]))
    return [p for _, p in ranked]


def _epoch(window: int, number: int):
    """One epoch of all islands: founds a population where there is none, takes in the migrant, evolves."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                rng = np.random.default_rng([int(r.cell), int(r.island), number])
                if r.people is None:
                    people = founders(sizes, window, POPULATION, rng)
                else:
                    people = list(np.frombuffer(zlib.decompress(r.people), "<i4").reshape(-1, len(sizes)).astype(np.int64))
                    if r.migrant is not None:
                        people[-1] = np.frombuffer(zlib.decompress(r.migrant), "<i4").astype(np.int64)
                people = evolve(people, sizes, window, rng)
                bins, lack = fitness(people[0], sizes, window)
                pack = lambda x: zlib.compress(x.astype("<i4").tobytes(), 1)
                yield pd.DataFrame({
                    "cell": [r.cell], "island": [r.island], "sizes": [r.sizes], "people": [pack(np.stack(people))], "elite": [pack(people[0])], "bins": [-bins],
                    "lack": [lack], "least": [-(-int(sizes.sum()) // window)]})

    return rows


def _placed(window: int):
    """Bin, offset and fill of the bin of every piece in a cell."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                bins = np.frombuffer(zlib.decompress(r.elite), "<i4")
                fill = np.bincount(bins, weights=sizes).astype(np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                offset = np.empty(len(sizes), np.int64)
                offset[order] = before - np.repeat(before[np.flatnonzero(np.diff(bins[order], prepend=-1))], np.bincount(bins))
                yield pd.DataFrame({"cell": r.cell, "at": np.arange(len(sizes)), "bin": bins, "offset": offset, "fill": fill[bins]})

    return rows


_ISLAND = "cell long, island int, sizes array<int>, people binary, elite binary, bins long, lack double, least long"


def packed_cells(pieces: DataFrame, cells: int, window: int = WINDOW) -> DataFrame:
    """``key``, ``cell``, ``bin``, ``offset`` and ``fill`` of pieces (``key``, ``length``) dealt to ``cells`` cells by a hash.

    The packing of a cell is the best one of its islands after EPOCHS epochs with a migration after each.
    """
    dealt = pieces.groupBy(F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("length", "key"))).alias("own"))
    dealt = cut_lineage(dealt)
    tasks = max(1, cells * ISLANDS // 4)  # given as a number, else Spark would put all these small rows into one task
    islands = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("own.length").alias("sizes"))
    state = cut_lineage(islands.withColumn("people", F.lit(None).cast("binary")).withColumn("migrant", F.lit(None).cast("binary"))
                        .repartition(tasks, "cell", "island").mapInPandas(_epoch(window, 0), _ISLAND))
    for number in range(1, EPOCHS):
        solved = state.groupBy("cell").agg((F.min("bins") <= F.min("least")).alias("solved"))
        open_cells = solved.where(~F.col("solved")).count()
        if not open_cells:
            break
        tasks = max(1, open_cells * ISLANDS // 4)
        guests = state.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("migrant"))
        moved = state.join(solved, "cell").join(guests, ["cell", "island"])
        still = moved.where("solved").select(*state.columns)
        before = state
        state = cut_lineage(moved.where(~F.col("solved")).select("cell", "island", "sizes", "people", "migrant").repartition(tasks, "cell", "island")
                            .mapInPandas(_epoch(window, number), _ISLAND).unionByName(still))
        drop_lineage(before)
    best = state.groupBy("cell").agg(F.min(F.struct("bins", -F.col("lack"), "island", "sizes", "elite")).alias("b")).select("cell", "b.sizes", "b.elite")
    placed = best.mapInPandas(_placed(window), "cell long, at int, bin int, offset long, fill long")
    keys = dealt.select("cell", F.posexplode("own.key").alias("at", "key"))
    out = cut_lineage(keys.join(placed, ["cell", "at"]).select("key", "cell", "bin", "offset", "fill"))
    drop_lineage(state)
    drop_lineage(dealt)
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, cell_tokens: int = CELL_TOKENS, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``.

    Only documents longer than a window are cut. A null or empty text is its END id alone; a null doc_id stays null;
    repeated rows are packed each; other columns are ignored; the empty table gives no rows. Equal lengths are alike, ties go
    by the key of the piece. A very long text gives as many whole windows, which need no search, and one rest. Cells
    follow the size of the input, so no task holds more than a cell at any size.
    """
    pieces = cut_lineage(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_path(), window), "doc_id long, piece int, start long, length int, ids_crc32 long")
                         .withColumn("key", F.monotonically_increasing_id()))
    out = pieces.where(F.col("length") == window).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level = pieces.where(F.col("length") < window).select("key", "length"), 0
    while True:
        n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            break
        cells = max(1, math.ceil(tokens / cell_tokens), math.ceil(n / cell_pieces))
        placed = packed_cells(rest, cells, window)
        last = cells == 1 or level == 12
        tight = placed if last else placed.where(F.col("fill") >= LOOSE * window)
        number = F.lit(level).cast("long") * 2**56 + F.col("cell") * 2**20 + F.col("bin")
        out = out.unionByName(tight.select("key", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, level = placed.where(F.col("fill") < LOOSE * window).join(pieces.select("key", "length"), "key").select("key", "length"), level + 1
    return pieces.join(out, "key").select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
