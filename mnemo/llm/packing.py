"""Packing by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import sliced, written
from mnemo.llm.tokens import public_path, word_tokenizer

SMALLEST = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def lengths_of(n: int, window: int, smallest: int) -> list[int]:
    """Piece lengths of n tokens: full windows, then halves of it down to ``smallest``, then the rest."""
    out = [window] * (n // window)
    n %= window
    size = window // 2
    while smallest and size >= smallest:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return [*out, n] if n else out


def cut_pieces(docs: DataFrame, window: int, end_id: int, find: Callable[[], str], id_col: str, text_col: str, also: Sequence[str] = ()) -> DataFrame:
    """Tokenise whole texts once and cut each in two ways: ``cut`` 0 has full windows and one remainder,
    1 has the remainder in halves of the window down to SMALLEST, null is a piece of both. Columns
    named in ``also`` are repeated for each piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(find())
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cut")}
            pieces = []
            for doc_id, found in zip(batch.column(0).to_pylist(), tokenizer.ids_of(batch.column(1).to_pylist()), strict=True):
                made = len(out["doc_id"])
                ids = memoryview(found + end)
                n = len(ids) // 4
                both = n // window
                fine = lengths_of(n, window, SMALLEST)
                ways = [(None, 0, [window] * both)]
                if n % window:
                    same = len(fine) == both + 1
                    ways.append((None if same else 0, both * window, [n % window]))
                    if not same:
                        ways.append((1, both * window, fine[both:]))
                for cut, start, lengths in ways:
                    for length in lengths:
                        piece = ids[4 * start : 4 * (start + length)]
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(piece))
                        out["doc_tokens"].append(n)
                        out["cut"].append(cut)
                        start += length
                pieces.append(len(out["doc_id"]) - made)
            of = pa.array(np.repeat(np.arange(batch.num_rows), pieces))
            repeated = [batch.column(i).take(of) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in out.values()], *repeated], names=[*out, *also])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *also).mapInArrow(run, PIECES + ", cut long" + typed(docs, also))


def typed(docs: DataFrame, names: Sequence[str]) -> str:
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in names)


def nnls(columns: np.ndarray, rows: int, wanted: np.ndarray, weight: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """Lawson-Hanson non-negative least squares; ``columns`` holds each column's row indices (-1: none)."""
    a = np.zeros((rows, len(columns)))
    for k in range(columns.shape[1]):
        used = columns[:, k] >= 0
        np.add.at(a, (columns[used, k], np.flatnonzero(used)), 1.0)
    a *= weight[:, None]
    b = wanted * weight
    gram_rhs = a.T @ b
    x = np.zeros(len(columns))
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(gram_rhs).max(initial=0)))
    for _ in range(rounds):
        gradient = gram_rhs - a.T @ (a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if not gradient[best] > tolerance:
            break
        active.append(best)
        while active:
            sub = a[:, active]
            z = np.linalg.lstsq(sub, b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[active] = z
                break
            old = x[active]
            bad = z <= 0
            step = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            moved = old + step * (z - old)
            keep = moved > 1e-12
            if keep.all():
                keep[np.argmin(moved)] = False
            x[:] = 0
            active = [i for i, k in zip(active, keep, strict=True) if k]
            x[active] = moved[keep]
    return x


def combinations(bins: int) -> np.ndarray:
    """Every combination of up to three bins whose lengths add up to the window (``bins`` grains)."""
    out = [(bins, -1, -1)]
    out += [(i, bins - i, -1) for i in range(1, bins // 2 + 1)]
    out += [(i, j, bins - i - j) for i in range(1, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    found = np.array(out)
    return np.where(found > 0, found - 1, -1)


def plan_packs(histogram: np.ndarray, window: int, bins: int = 128) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeat count) for every sequence, from the counts of each piece length.

    Bounded work: the histogram has ``window`` entries whatever the corpus. Lengths are binned by
    rounding up; the rounded-down least-squares solution gives repeat counts of combinations, whose
    slots take the longest pieces of their bins first; what is left is placed best-fit decreasing,
    also into the small gaps that binning leaves.
    """
    left = histogram.astype(np.int64).copy()
    grain = -(-window // bins)
    bins = -(-window // grain)
    packs: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        packs.append(((window,), int(left[window])))
        left[window] = 0
    of_bin = (np.arange(window + 1) + grain - 1) // grain - 1
    counts = np.bincount(of_bin[1:], weights=left[1:], minlength=bins)
    open_packs: dict[int, list[list]] = defaultdict(list)

    def close(lengths: tuple[int, ...], n: int) -> None:
        gap = window - sum(lengths)
        if gap:
            open_packs[gap].append([lengths, n])
        else:
            packs.append((lengths, n))

    if counts.sum():
        columns = combinations(bins)
        usable = np.all((columns < 0) | (counts[np.maximum(columns, 0)] > 0), axis=1)
        columns = columns[usable]
        weight = np.where(counts > 0, 1.0 / np.sqrt(np.maximum(counts, 1)), 1.0)
        repeats = np.floor(nnls(columns, bins, counts, weight) + 1e-9).astype(np.int64) if len(columns) else np.empty(0, np.int64)
        pools = [[length for length in range(min(window, (b + 1) * grain), b * grain, -1)] for b in range(bins)]
        for column, n in zip(columns[np.argsort(-repeats, kind="stable")].tolist(), np.sort(repeats)[::-1].tolist(), strict=True):
            slots = [b for b in column if b >= 0]
            while n > 0:
                drawn, spare = [], left.copy() if len(set(slots)) < len(slots) else left
                for b in slots:
                    length = next((x for x in pools[b] if spare[x] > 0), None)
                    if length is None:
                        break
                    drawn.append(length)
                    if spare is not left:
                        spare[length] -= 1
                if len(drawn) < len(slots):
                    break
                uses = {x: drawn.count(x) for x in drawn}
                times = min(n, *(int(left[x]) // k for x, k in uses.items()))
                for x, k in uses.items():
                    left[x] -= times * k
                close(tuple(sorted(drawn, reverse=True)), times)
                n -= times

    for length in range(window, 0, -1):
        n = int(left[length])
        gap = length
        while n > 0 and gap <= window:
            waiting = open_packs.get(gap)
            if not waiting:
                gap += 1
                continue
            lengths, count = waiting.pop()
            fits = gap // length
            full = min(count, n // fits)
            if full:
                close((*lengths, *[length] * fits), full)
                n -= full * fits
                count -= full
            if count and n and n < fits:
                close((*lengths, *[length] * n), 1)
                n, count = 0, count - 1
            if count:
                waiting.append([lengths, count])
                if n == 0:
                    break
        if n:
            fits = window // length
            if n // fits:
                close((length,) * fits, n // fits)
            if n % fits:
                close((length,) * (n % fits), 1)
    for waiting in open_packs.values():
        packs += [(tuple(lengths), n) for lengths, n in waiting]
    return sorted(packs, key=lambda p: (-sum(p[0]), p[0]))


def place(packs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on a piece goes to which sequence and offset."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in packs:
        offset = 0
        for length in lengths:
            rows.append((length, rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    rows.sort()
    found = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), found.T, strict=True))


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, find: Callable[[], str] = public_path("word_bpe_49k.json"), bins: int = 128, least_gain: float = 0.02, id_col: str = "doc_id", text_col: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """Place every token of every document into sequences of at most ``window`` tokens.

    A document longer than the window is cut at multiples of it. Remainders stay whole, or are cut at
    halves of the window down to SMALLEST tokens if the histograms of both ways, counted over all
    documents, say that this saves ``least_gain`` of the sequences. Null text counts as empty: the closing id alone. An empty table gives an empty result; repeated rows and
    null identifiers are packed like others. Only the histogram of piece lengths (``window`` + 1
    counts) reaches the driver. Pieces are ranked within their length in two levels, so a length
    shared by a third of all pieces is spread over many tasks, and the plan maps ranks to places.
    Columns named in ``also`` are carried from a document to its pieces.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, window, end_id, find, id_col, text_col, also), "pack-pieces")
    histograms = np.zeros((2, window + 1), dtype=np.int64)
    for row in pieces.groupBy("length", "cut").count().collect():
        for cut in (0, 1) if row["cut"] is None else (row["cut"],):
            histograms[cut, row["length"]] += row["count"]
    plans = [plan_packs(h, window, bins) for h in histograms]
    # the two histograms tell which way packs into fewer sequences; whole remainders where they are alike
    way = int(sum(n for _, n in plans[1]) < (1 - least_gain) * sum(n for _, n in plans[0]))
    packs, histogram = plans[way], histograms[way]
    pieces = pieces.where(F.col("cut").isNull() | (F.col("cut") == way)).drop("cut")
    plan = spark.sparkContext.broadcast(place(packs))
    chunks = int(max(256, histogram.sum() // 20_000))
    pieces = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    totals = pieces.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "start", "ids_crc32", *also)
    ranked = pieces.join(bases, ["length", "_chunk"]).withColumn("_rank", F.col("_base") + F.row_number().over(inside) - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = 1 << 44
        keys = p["length"] * wide + p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = p["sequence"][at] + rank - p["rank"][at]
            columns, carried = [batch.column(i) for i in range(5)], [batch.column(i) for i in range(6, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(p["offset"][at]), *carried], names=[*batch.schema.names[:5], "sequence_id", "offset", *also])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank", *also).mapInArrow(assign, PIECES + ", sequence_id long, offset long" + typed(docs, also))
