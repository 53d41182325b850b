"""Operator 2: pattern packing by non-negative least squares.

Only the histogram of piece lengths reaches the driver, at most one number per
length.  Lengths are put into bins; patterns of one to three bins that fill
a sequence are enumerated; non-negative least squares fits their repeat counts
to the histogram; counts are rounded to what the bins hold; pieces that are
left go best-fit, longest first, into the room that is left and into new
sequences, by groups of equal sequences rather than one at a time.  Pieces of
one length are interchangeable, so a piece finds its place from its rank
within its length, which is a sum of counts and a sort inside hashed parts.

Defined results: a null or empty text is one piece of one token (the
end mark); ties and repeated rows are pieces of their own; only longer documents
are cut, the first piece being the shorter; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

LENGTH = 2048
BINS = 256
END = 0
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def _tokenise(path: str, length: int, keep_ids: bool):
    schema = _PIECE if keep_ids else pa.schema(list(_PIECE)[:-1])

    def run(batches):
        from .tokens import encoder

        enc = encoder(path)
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                raw = np.append(enc.ids(text or ""), np.uint32(END)).astype("<u4").tobytes()
                for i, (s, n) in enumerate(cut(len(raw) // 4, length)):
                    part = raw[4 * s : 4 * (s + n)]
                    for k, v in zip(rows, (doc, i, s, n, zlib.crc32(part), part)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, the ids (little-endian unsigned 32-bit)."""
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_tokenise(path, length, keep_ids), kinds)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        free[j] = True
        while True:
            p = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            step = float(np.min(x[p][bad] / np.maximum(x[p][bad] - z[bad], 1e-300)))
            x[p] += step * (z - x[p])
            free[p[bad & (x[p] <= 1e-12 * max(1.0, x.max()))]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """One to three bins that sum to `bins`."""
    two = [(i, bins - i) for i in range(1, bins // 2 + 1)]
    three = [(i, j, bins - i - j) for i in range(1, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    return [(bins,), *two, *three]


Group = tuple[int, tuple[tuple[int, int], ...]]  # (sequences, ((length, pieces in each), ...))


def plan(hist: np.ndarray, length: int = LENGTH, bins: int = BINS) -> list[Group]:
    """Groups of equal sequences that hold all pieces; hist[n]: pieces of length n."""
    left = hist.astype(np.int64).copy()
    bins = max(1, min(bins, length))
    bin_of = -(-np.arange(length + 1) * bins // length)
    counts = np.bincount(bin_of, weights=left, minlength=bins + 1)[1:]
    rooms: dict[int, list[list]] = defaultdict(list)  # room -> [sequences, parts]
    if counts.sum():
        kinds = patterns(bins)
        a = np.zeros((bins, len(kinds)))
        for j, p in enumerate(kinds):
            for b in p:
                a[b - 1, j] += 1
        # long pieces are harder to place afterwards, so their misfit weighs more
        weight = np.linspace(0.2, 1.0, bins)
        x = nnls(a * weight[:, None], counts * weight)
        have = counts.astype(np.int64)
        for j in np.argsort(-x, kind="stable").tolist():
            need = a[:, j].astype(np.int64)
            some = need > 0
            times = int(min(round(x[j]), (have[some] // need[some]).min()))
            if times <= 0:
                continue
            have -= need * times
            # exact lengths of each part, longest first, as runs
            runs = []
            for b in kinds[j]:
                want, run = times, []
                for n in range(int(np.searchsorted(bin_of, b, "right")) - 1, 0, -1):
                    m = int(min(want, left[n]))
                    if m:
                        run.append((n, m))
                        left[n] -= m
                        want -= m
                    if not want:
                        break
                runs.append(run)
            at = [[0, r[0][1]] for r in runs]
            while times:
                m = min(k for _, k in at)
                lengths = sorted((r[i][0] for r, (i, _) in zip(runs, at)), reverse=True)
                parts: dict[int, int] = {}
                for n in lengths:
                    parts[n] = parts.get(n, 0) + 1
                rooms[length - sum(lengths)].append([m, tuple(parts.items())])
                times -= m
                for r, s in zip(runs, at):
                    s[1] -= m
                    if not s[1] and s[0] + 1 < len(r):
                        s[0] += 1
                        s[1] = r[s[0]][1]
    for n in range(length, 0, -1):
        want = int(left[n])
        while want:
            room = next((r for r in range(n, length + 1) if rooms.get(r)), None)
            if room is None:
                each = length // n
                for m, k in ((want // each, each), (1, want % each)):
                    if m and k:
                        rooms[length - n * k].append([m, ((n, k),)])
                break
            m, parts = rooms[room].pop()
            used = min(m, want)
            if used < m:
                rooms[room].append([m - used, parts])
            more = dict(parts)
            more[n] = more.get(n, 0) + 1
            rooms[room - n].append([used, tuple(more.items())])
            want -= used
    return [(m, parts) for room in sorted(rooms) for m, parts in rooms[room]]


class Places:
    """Where the r-th piece of each length goes; its size is bounded by the number of groups."""

    def __init__(self, groups: list[Group]):
        by: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        base = 0
        for m, parts in groups:
            offset = 0
            for n, k in parts:
                by[n].append((rank[n], base, k, offset))
                rank[n] += m * k
                offset += n * k
            base += m
        self.by = {n: np.array(x, np.int64) for n, x in by.items()}
        self.total = dict(rank)
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            i = np.flatnonzero(length == n)
            x = self.by[n]
            row = x[np.searchsorted(x[:, 0], rank[i], "right") - 1]
            j = rank[i] - row[:, 0]
            seq[i] = row[:, 1] + j // row[:, 2]
            off[i] = row[:, 3] + j % row[:, 2] * n
        return seq, off


def pack(items: DataFrame, length: int = LENGTH, bins: int = BINS) -> DataFrame:
    """`items` (doc_id, piece, length of 1..`length`, ...) with sequence_id and offset."""
    spark = items.sparkSession
    parts = partitions(spark) * 4
    items = items.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = materialise(items.groupBy("length", "_part").agg(F.count("*").alias("n")))
    hist = np.zeros(length + 1, np.int64)
    for n, k in counts.groupBy("length").agg(F.sum("n")).collect():  # one row a length at most
        hist[n] = k
    places = Places(plan(hist, length, bins))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ahead"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = items.join(ahead, ["length", "_part"]).withColumn("_rank", F.col("_ahead") + F.row_number().over(order) - 1).drop("_ahead", "_part")
    shared = spark.sparkContext.broadcast(places)
    columns = items.drop("_part").columns

    def place(batches):
        for b in batches:
            seq, off = shared.value.find(b["length"].to_numpy(), b["_rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in columns), pa.array(seq), pa.array(off)], names=[*columns, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    out = StructType([items.schema[c] for c in columns]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.select(*columns, "_rank").mapInArrow(place, out)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(materialise(pieces(docs, path)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
