"""Operator 7: packing by minimum bin slack over the corpus' piece lengths.

Only lengths matter for packing, and a piece has one of ``capacity`` lengths.
So the corpus is reduced to a histogram of at most ``capacity`` rows, the
bins are planned on that histogram, and the plan is dealt back to the pieces
by their rank within their length:

1. tokenise, cut, and write the pieces (id, piece, length, checksum, chunk);
2. count pieces by length: the only thing the driver sees;
3. per bin, a bitset subset-sum over the available lengths finds the fullest
   combination that holds the longest piece left; the combination is taken as
   often as its scarcest length allows, so the plan has as many entries as
   lengths run out, not as many as there are bins;
4. every piece's rank within its length (start of its chunk + rank in the
   chunk, so no length is ranked in one task) is looked up in the plan.

Cases: null text counts as empty (the end id alone); an empty table gives no
pieces; repeated rows are packed as often as they come; ids may be null.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.bpe import read_vocabulary, token_bytes
from nightjar.llm.common import emit, id_text, materialise

# The byte-level pre-token rule of the vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces ranked in one task; chunks of the pieces table are about this long.
CHUNK_PIECES = 50_000

_CODERS: dict[str, tiktoken.Encoding] = {}


def _coder(path: str) -> tiktoken.Encoding:
    """The vocabulary file's merges in the fast public encoder, per worker."""
    if path not in _CODERS:
        text, special = token_bytes(read_vocabulary(path))
        ranks = {t: i for i, t in enumerate(text) if t and i not in set(special.values())}
        _CODERS[path] = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _CODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids plus
    the end id; a longer document is cut so that only its first piece may be
    shorter than the capacity."""
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
             "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in types}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.encode_to_numpy(text or "", allowed_special="all").astype("<u4").tobytes() + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(cuts[k])
                    out["length"].append(cuts[k + 1] - cuts[k])
                    out["ids_crc32"].append(zlib.crc32(ids[4 * cuts[k]:4 * cuts[k + 1]]))
            yield emit(out, types)

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths with the largest sum <= room.

    ``reach[k]`` is a bitset of the sums that the first k items can make;
    walking back from the highest bit recovers one combination."""
    items, reach = [], [1]
    mask, bits = (1 << (room + 1)) - 1, 1
    for n in reversed(lengths):
        if n > room:
            continue
        # binary splitting keeps the items per length logarithmic
        many, step = min(left[n], room // n), 1
        while many > 0:
            take = min(step, many)
            items.append((n, take))
            bits = (bits | bits << (n * take)) & mask
            reach.append(bits)
            many -= take
            step *= 2
        if bits >> room & 1:
            break
    total, out = bits.bit_length() - 1, []
    for k in range(len(items), 0, -1):
        if reach[k - 1] >> total & 1:
            continue
        n, take = items[k - 1]
        out += [n] * take
        total -= n * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack: [(pieces per length, number of such bins)]."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        first = lengths[-1]
        left[first] -= 1
        rest = _fullest([n for n in lengths if left[n] > 0], left, capacity - first)
        left[first] += 1
        pattern: dict[int, int] = {}
        for n in [first, *rest]:
            pattern[n] = pattern.get(n, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        out.append((pattern, times))
    return out


def _slots(planned: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, pieces per bin, offset in the
    bin) in the order of rank."""
    out: dict[int, list] = {}
    rank = dict.fromkeys(range(1, capacity + 1), 0)
    first_bin = 0
    for pattern, times in planned:
        offset = 0
        for n in sorted(pattern, reverse=True):
            out.setdefault(n, []).append((rank[n], first_bin, pattern[n], offset))
            rank[n] += pattern[n] * times
            offset += n * pattern[n]
        first_bin += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    # a scan task numbers its rows from (its partition << 33), so the number
    # over CHUNK_PIECES names bounded chunks; it is written, hence stable
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id())
                      .withColumn("chunk", F.expr(f"row div {CHUNK_PIECES}")), "pieces")
    by_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, capacity), capacity))

    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row")) - 1)
              .join(starts, ["length", "chunk"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("before") + F.col("rank")).cast("long").alias("rank")))
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(),
             "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                rows, at = table[int(n)], np.flatnonzero(length == n)
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                place = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + place // row[:, 2]
                offset[at] = row[:, 3] + place % row[:, 2] * n
            yield emit({k: batch.column(k) for k in list(types)[:5]} | {"sequence_id": sequence, "offset": offset},
                       types)

    return ranked.mapInArrow(
        deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
