"""Pattern packing of token sequences: patterns of a few documents fitted to the length histogram, best fit for the rest."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.bpe import WordTokenizer
from tallyfold.llm.common import doc_batches, running_start, small_batches, staged, text_of, worker_cached

CAPACITY = 2048
#: Texts are tokenized in parts of about this many characters; a part stands some ten times in a worker's memory.
PIECE_CHARS = 300_000
#: At most about this many patterns are enumerated, whatever the capacity.
MAX_PATTERNS = 400_000
#: The fit is rounded after each of these numbers of sweeps; the plan with the fewest sequences is taken.
SWEEPS = (1, 4, 12)


# ------------------------------------------------------------------------------------------------ pieces


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text: its ids and an end id, cut only if longer than
    ``capacity``.  All pieces of a document but the first are full.  Null counts as empty (the end id alone)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = worker_cached(tokenizer, lambda: WordTokenizer(tokenizer))
        for frame in doc_batches(frames, PIECE_CHARS):
            ids, sizes = words.encode(frame["text"].tolist())
            stops = np.cumsum(sizes)
            ids = np.insert(ids, stops, end_id).astype("<u4")
            sizes = sizes + 1
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = sizes - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (np.cumsum(sizes) - sizes)[row] + start
            cut = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist())]
            out = pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "start": start, "length": length})
            out["doc_id"] = frame["doc_id"].iloc[row].to_numpy()
            out["ids_crc32"] = np.array([zlib.crc32(c.tobytes()) for c in cut], np.int64)
            if with_ids:
                out["ids"] = [c.astype(np.int32) for c in cut]
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------------------------------- fit the patterns


def exact_patterns(lengths: np.ndarray, capacity: int, most: int = MAX_PATTERNS) -> np.ndarray:
    """Pairs and triples of present lengths (0: unused) that fill the capacity exactly, as rows in descending order."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    a = np.arange(1, capacity)
    pairs = np.stack([capacity - a, a, np.zeros_like(a)], 1)[: capacity // 2]
    step = max(1, int(np.ceil(capacity**2 / 12 / most)))
    triples = []
    for low in range(1, capacity // 3 + 1, step):
        mid = np.arange(low, (capacity - low) // 2 + 1)
        triples.append(np.stack([capacity - low - mid, mid, np.full_like(mid, low)], 1))
    rows = np.concatenate([pairs, *triples]) if triples else pairs
    present[0] = True
    return rows[present[rows].all(1)]


def fit_counts(patterns: np.ndarray, counts: np.ndarray, sweeps: tuple[int, ...] = SWEEPS) -> Iterator[np.ndarray]:
    """Non-negative least squares: repeat counts x >= 0 that bring the used lengths closest to the histogram.

    Coordinate descent from zero: one pattern after the other takes its best value given the rest, those with the
    longest piece first and pairs before triples, as they have the fewest other uses.  Gives x after each number of sweeps.
    """
    x = [0.0] * len(patterns)
    rest = counts.astype(float).tolist()
    order = np.lexsort((np.random.default_rng(7).random(len(patterns)), patterns[:, 2] > 0, -patterns[:, 0])).tolist()
    rows = patterns.tolist()
    for sweep in range(1, max(sweeps) + 1):
        active = []
        for p in order:
            i, j, k = rows[p]
            if k:
                twice = (i == j) + (j == k)
                norm = 3.0 if not twice else 5.0 if twice == 1 else 9.0
                step = (rest[i] + rest[j] + rest[k]) / norm
            else:
                norm = 2.0 if i != j else 4.0
                step = (rest[i] + rest[j]) / norm
            old = x[p]
            new = old + step
            if new < 0.0:
                new = 0.0
            if new:
                active.append(p)
            step = new - old
            if step:
                x[p] = new
                rest[i] -= step
                rest[j] -= step
                if k:
                    rest[k] -= step
        order = active
        if sweep in sweeps:
            yield np.array(x)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on a histogram: longest first, each into the fullest sequence that takes it; equal steps in one go."""
    open_at: dict[int, list] = {}
    keys: list[int] = []
    done: list[tuple[object, int]] = []

    def put(left: int, chain, n: int) -> None:
        if left == 0:
            done.append((chain, n))
            return
        if left not in open_at:
            open_at[left] = []
            insort(keys, left)
        open_at[left].append((chain, n))

    for size in range(capacity, 0, -1):
        todo = int(counts[size])
        while todo:
            at = bisect_left(keys, size)
            if at == len(keys):
                many = capacity // size
                if todo >= many:
                    put(capacity - many * size, (None, size, many), todo // many)
                if todo % many:
                    put(capacity - (todo % many) * size, (None, size, todo % many), 1)
                break
            left = keys[at]
            chain, n = open_at[left].pop()
            if not open_at[left]:
                del open_at[left]
                keys.pop(at)
            fits = left // size
            take = min(n, todo // fits)
            if take:
                put(left - fits * size, (chain, size, fits), take)
                todo -= take * fits
                if take < n:
                    put(left, chain, n - take)
            else:
                put(left - todo * size, (chain, size, todo), 1)
                todo = 0
                if n > 1:
                    put(left, chain, n - 1)
    for left in keys:
        done += open_at[left]

    def unrolled(chain) -> tuple[int, ...]:
        out = []
        while chain is not None:
            chain, size, many = chain
            out += [size] * many
        return tuple(reversed(out))

    return [(unrolled(chain), n) for chain, n in done]


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) so that every counted piece has a place; ``counts[n]`` pieces have length n."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    plan = []
    if counts[capacity]:
        plan.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(counts), capacity)
    if not len(patterns):
        return plan + best_fit_decreasing(counts, capacity)
    plans = [_rounded(patterns, x, counts, capacity) for x in fit_counts(patterns, counts)]
    return plan + min(plans, key=lambda made: sum(n for _, n in made))


def _rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the fitted patterns, and the residual pieces by best fit."""
    counts, plan = counts.copy(), []
    whole = np.floor(x + 1e-9).astype(np.int64)
    for p in np.argsort(-whole, kind="stable"):  # where the fit takes more than there is, larger repeats go first
        if whole[p] == 0:
            break
        sizes = [int(s) for s in patterns[p] if s]
        need = np.bincount(sizes)
        at = np.flatnonzero(need)
        n = int(min(whole[p], (counts[at] // need[at]).min()))
        if n > 0:
            counts[at] -= n * need[at]
            plan.append((tuple(sizes), n))
    return plan + best_fit_decreasing(counts, capacity)


# --------------------------------------------------------------------------------------- deal out the places


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset: sequences of at most ``capacity`` tokens,
    gapless from offset 0.

    The histogram has at most ``capacity`` rows, so the plan is made on the driver whatever the input.  Pieces of one
    length are ranked exactly, in a hash order, without bringing a length into one task; a piece's rank names its
    place.  ``pieces`` must be a stored table, as it is read twice.  Repeated rows get places of their own; an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").count().collect():
        counts[size] = n
    plan = plan_patterns(counts, capacity)
    lengths, begins, sequence, offsets, base = [], [], [], [], 0
    for sizes, n in plan:
        at = 0
        for s in sizes:
            lengths.append(s), begins.append(n), sequence.append(base), offsets.append(at)
            at += s
        base += n
    lengths = np.array(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    # places in one row: all of the shortest length, then the next
    stops = np.cumsum(np.array(begins, np.int64)[order])
    starts = stops - np.array(begins, np.int64)[order]
    first = np.cumsum(counts) - counts
    places = spark.sparkContext.broadcast((first, starts, np.array(sequence, np.int64)[order], np.array(offsets, np.int64)[order]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, starts, sequence, offsets = places.value
        for frame in frames:
            at = first[frame["length"].to_numpy(np.int64)] + frame["_rank"].to_numpy(np.int64)
            slot = np.searchsorted(starts, at, "right") - 1
            yield frame.drop(columns="_rank").assign(sequence_id=sequence[slot] + at - starts[slot], offset=offsets[slot])

    names = pieces.columns
    keyed = pieces.withColumn("_key", F.xxhash64("doc_id", "piece")).withColumn("_one", F.lit(1))
    buckets = max(16, int(counts.max()) // 50_000)
    ranked = running_start(keyed, ["length"], ["doc_id", "piece"], "_one", "_rank", buckets).select(*names, "_rank")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and pack them; see :func:`token_pieces` and :func:`pack`.  Other columns are ignored."""
    with small_batches(docs.sparkSession, "2m", 500):
        pieces = staged(token_pieces(docs, tokenizer, id_col, text_col, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity)
