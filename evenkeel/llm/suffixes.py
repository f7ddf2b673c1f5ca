"""Suffix-array dedup: removes every byte that a string of LENGTH (200) bytes covers which starts anywhere else too.

Not all suffixes are sorted. Each 200-byte window has an anchor: of the places in it where LEAD (32)
bytes fit, the leftmost one whose first eight bytes have the least hash. Equal windows have equal
anchors at equal offsets, so only suffixes at anchors (about one in 85) matter, and of those only
the ones whose first LEAD bytes some other anchor has too; they keep the bytes of their windows.

Anchors are found once and written as (hash of the lead, row, place, reach of their windows). Those
whose hash recurs are gathered by row; from there on, suffixes are only sliced out of the texts.
They are range-partitioned by their leading bytes with sampled splitters; a number of
the row comes second in the key, so that a lead that very many suffixes share spans partitions. Each
bucket sorts its suffixes, and the reversed texts before them, by three-way multikey quicksort over
8-byte symbols. With the common lengths of neighbours, windows at one offset
are equal exactly if the sorted neighbours between them agree far enough on both sides. A bucket's
first and last lead may go on in its neighbours: the distinct windows of those leads are compared
across buckets by their SHA-256, one row a bucket for each.

Documents without any such suffix are finished when that is known; only the texts of the others
are carried on. Spans are joined back by row and merged per document.

Defined cases: null and empty texts, and texts below 200 bytes, lose nothing; repeated rows are
different documents, so that they lose all that is long enough; strings overlap freely, also with
themselves; matches are of bytes and may start or end within a character; null ids are kept; very
long texts are searched in overlapping pieces of PIECE bytes; an empty table gives an empty result;
other columns are ignored, whatever their names; a table that cannot be read twice alike is written first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binaries, cut, lean, merge_runs, pick, settled

LENGTH, LEAD = 200, 32
PLACES = LENGTH - LEAD + 1
#: Bytes that are searched for anchors at a time (some 90 bytes of memory each); longer texts are taken in overlapping pieces.
PIECE = 1 << 19
#: Bytes of suffixes in a bucket, about.
BUCKET = 16 << 20
_POS = 24


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a little-endian number; data ends in eight spare bytes."""
    return np.ndarray(len(data) - 8, "<u8", data.tobytes(), 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _pieces(texts: list[bytes]):
    """Groups of (text number, offset, bytes) of at most about PIECE bytes; pieces of a text overlap by a window less one."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if group and size + len(part) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def anchors(texts: list[bytes]):
    """Yields (text number, anchor, first window, last window, hash of the lead) arrays; places are within the text."""
    for group in _pieces(texts):
        data = np.frombuffer(b"".join(p for _, _, p in group) + bytes(8), np.uint8)
        n = len(data) - 8
        eights = _eights(data)
        key = _mixed(eights) >> np.uint64(_POS) << np.uint64(_POS) | np.arange(n, dtype=np.uint64)
        rows = -(-n // PLACES) + 1
        grid = np.full(rows * PLACES, np.iinfo(np.uint64).max, np.uint64)
        grid[:n] = key
        grid = grid.reshape(rows, PLACES)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        windows = np.concatenate([np.arange(s, e - LENGTH + 1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = (np.minimum(ahead[windows], behind[windows + PLACES - 1]) & np.uint64((1 << _POS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        a = at[first]
        h = np.zeros(len(a), np.uint64)
        for k in range(0, LEAD, 8):
            h = _mixed(h ^ eights[a + k])
        own = np.searchsorted(ends, a, "right")
        shift = np.array([o for _, o, _ in group])[own] - starts[own]
        yield np.array([i for i, _, _ in group])[own], a + shift, windows[first] + shift, windows[last] + shift, h.view(np.int64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian 8-byte symbols by three-way multikey quicksort.

    A segment of rows that agree up to its depth is split by the median of three of its next symbols:
    smaller and larger ones stay at that depth, equal ones go on to the next symbol. All segments
    take a step at a time together; those of one row, or equal to the end, are done.
    """
    n, width = words.shape
    order, place = np.arange(n), np.arange(n)  # place: positions of open segments, in order
    start, depth = np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)  # where in place each segment begins
    while len(place):
        size = np.diff(np.append(start, len(place)))
        segment = np.repeat(np.arange(len(start)), size)
        rows = order[place]
        symbol = words[rows, depth[segment]]
        low, middle, high = symbol[start], symbol[start + size // 2], symbol[start + size - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[segment]
        group = segment * 3 + (symbol >= pivot) + (symbol > pivot)
        by = np.argsort(group, kind="stable")
        order[place], group = rows[by], group[by]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size, group = np.diff(np.append(begin, len(place))), group[begin]
        deeper = depth[group // 3] + (group % 3 == 1)
        going = (size > 1) & (deeper < width)
        place = place[np.repeat(going, size)]
        size, depth = size[going], deeper[going]
        start = np.cumsum(size) - size
    return order


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _sorted_runs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row in sorted order, common length of each sorted row with the one before; 0 for the first)."""
    order = multikey_order(matrix.view(">u8").astype(np.uint64))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    common = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 15):
        b = min(len(order), a + (1 << 15))
        differ = matrix[order[a:b]] != matrix[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return rank, common


def compare_bucket(suffix: list[bytes], before: list[bytes], row: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Windows of a bucket that occur twice in it, and those of its first and last lead.

    Suffix i begins at its anchor, `before` has the bytes ahead of it; its windows start low[i] to
    high[i] bytes ahead of the anchor. Returns (row, start, end) of spans, and of the open leads
    (digest, row, start) with row -1 for windows that the bucket has twice.
    """
    n = len(suffix)
    right = _matrix(suffix, LENGTH)
    left = _matrix([b[::-1] for b in before], -(-PLACES // 8) * 8)
    r_rank, r_common = _sorted_runs(right)
    l_rank, l_common = _sorted_runs(left)
    leads = np.cumsum(r_common < LEAD)[r_rank]
    opened = (leads == leads.min()) | (leads == leads.max()) if n else np.zeros(0, bool)
    spans, digests, rows, starts = [], [], [], []
    anchor = first + high
    for o in range(int(low.min()) if n else 0, int(high.max()) + 1 if n else 0):
        own = np.flatnonzero((low <= o) & (o <= high))
        if not len(own):
            continue
        key = np.cumsum(r_common < LENGTH - o)[r_rank[own]] * np.int64(n + 1) + np.cumsum(l_common < o)[l_rank[own]]
        by = np.argsort(key, kind="stable")
        k = key[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        twice = ~(new & np.append(new[1:], True))
        hit = own[by[twice]]
        spans.append((row[hit], anchor[hit] - o))
        first_of, many = own[by[new]], twice[new]
        wanted = opened[first_of]
        for i, m in zip(first_of[wanted].tolist(), many[wanted].tolist(), strict=True):
            digests.append(hashlib.sha256((before[i][len(before[i]) - o :] if o else b"") + suffix[i][: LENGTH - o]).digest())
            rows.append(-1 if m else int(row[i]))
            starts.append(int(anchor[i] - o))
    if not spans:
        return (np.zeros(0, np.int64),) * 3, ([], [], [])
    rows_, at = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.lexsort((at, rows_))
    rows_, at = rows_[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (rows_[1:] != rows_[:-1]) | (at[1:] > at[:-1] + LENGTH)
    last = np.append(new[1:], True)[: len(at)]
    return (rows_[new], at[new], at[last] + LENGTH), (digests, rows, starts)


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack([start, end], 1).reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, spans (array of start, end in bytes, merged), text (null where there are no spans), sha256 of the kept bytes."""
    spark = docs.sparkSession
    frame = settled(pick(docs, id=id_col, text=text_col)).withColumn("row", F.monotonically_increasing_id())
    id_kind = frame.schema["id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            rows = batch.column(1).to_numpy()
            for doc, at, first, last, h in anchors(binaries(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rows[doc]), pa.array(at.astype(np.int32)), pa.array((at - first).astype(np.int16)), pa.array((at - last).astype(np.int16))], ["h", "row", "at", "most", "least"])

    places = cut(frame.select("text", "row").mapInArrow(lean(find), "h long, row long, at int, most short, least short"), "places")
    # Written out, so that the join below has an exchange on both sides and a hot lead's places can be split.
    shared = cut(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "leads")
    flagged = places.join(shared, "h", "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "most", "least")).alias("ats")).withColumnRenamed("row", "row_")
    ats_kind = "array<struct<at:int,most:smallint,least:smallint>>"

    def finish(batches):
        for batch in batches:
            texts, ats = binaries(batch.column(1)), batch.column(3)
            has = ats.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array([None if x else hashlib.sha256(t).hexdigest() for t, x in zip(texts, has, strict=True)], pa.string()), pa.array([t if x else None for t, x in zip(texts, has, strict=True)], pa.binary()), ats],
                ["id", "row", "n_bytes", "sha256", "text", "ats"],
            )

    known = frame.join(flagged, F.col("row") == F.col("row_"), "left").select("id", "text", "row", "ats")
    state = cut(known.mapInArrow(lean(finish), f"id {id_kind}, row long, n_bytes long, sha256 string, text binary, ats {ats_kind}"), "texts")
    open_ = state.where("ats is not null")
    total = open_.agg(F.sum(F.size("ats")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 300 / BUCKET) + 1)

    def suffixes(batches):
        for batch in batches:
            texts, ats = binaries(batch.column(0)), batch.column(1)
            doc = np.repeat(np.arange(len(texts)), np.diff(ats.offsets.to_numpy()))
            at, most, least = (ats.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
            rows = batch.column(2).to_numpy()[doc]
            places = list(zip(doc.tolist(), at.tolist(), (at - most).tolist(), (at - least).tolist(), strict=True))
            for a in range(0, len(places), 5000):
                some, own = places[a : a + 5000], slice(a, a + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([texts[d][s : s + LEAD] for d, s, _, _ in some], pa.binary()), pa.array([texts[d][s + LEAD : e + LENGTH] for d, s, _, e in some], pa.binary()), pa.array([texts[d][f:s] for d, s, f, _ in some], pa.binary()), pa.array(rows[own]), pa.array((at - most)[own]), pa.array(least[own])],
                    ["lead", "more", "before", "row", "first", "low"],
                )

    listed = open_.select("text", "ats", "row").mapInArrow(lean(suffixes), "lead binary, more binary, before binary, row long, first long, low long")
    ranged = listed.repartitionByRange(parts, "lead", F.xxhash64("row", "first"))

    def buckets(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        lead, more, before = (t[c].to_pylist() for c in ("lead", "more", "before"))
        row, first, low = (t[c].to_numpy() for c in ("row", "first", "low"))
        high = first * 0 + np.array([len(b) for b in before], np.int64)
        (r, s, e), (digests, rows, starts) = compare_bucket([a + b for a, b in zip(lead, more, strict=True)], before, row, first, low, high)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.binary()), pa.array(r), pa.array(s), pa.array(e)], ["digest", "row", "start", "end"])
        if digests:
            at = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(rows, pa.int64()), pa.array(at), pa.array(at + LENGTH)], ["digest", "row", "start", "end"])

    found = cut(ranged.mapInArrow(lean(buckets), "digest binary, row long, start long, end long"), "spans")
    span = F.struct("row", "start", "end").alias("x")
    # A digest has one row from each bucket at most.
    across = found.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.collect_list(span).alias("all")).where("n > 1").select(F.explode("all").alias("x")).select("x.*").where("row >= 0")
    spans = found.where("digest is null").select("row", "start", "end").union(across).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("row", "row_")

    def settle(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out, shas = [], []
            for text, sha, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                pairs = np.array([(x["start"], x["end"]) for x in spans or ()], np.int64).reshape(-1, 2)
                s, e = merge_runs(pairs[:, 0], pairs[:, 1])
                out.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                shas.append(sha or hashlib.sha256(_kept(text, s, e)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind), batch.column(2), pa.array(shas, pa.string())], ["id", "n_bytes", "spans", "text", "kept_sha256"])

    last = state.join(spans, F.col("row") == F.col("row_"), "left").select("id", "n_bytes", "text", "sha256", "spans")
    return last.mapInArrow(lean(settle), f"id {id_kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, text binary, kept_sha256 string").withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_spans(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Merged spans of each text by a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - LENGTH + 1):
            w = t[p : p + LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        at = np.array([p for p in range(len(t) - LENGTH + 1) if seen[t[p : p + LENGTH]] > 1], np.int64)
        s, e = merge_runs(at, at + LENGTH)
        out.append(list(zip(s.tolist(), e.tolist(), strict=True)))
    return out
