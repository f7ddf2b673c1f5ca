"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two link at `DISTANCE` (2) or fewer differing bits. The bits lie on a
ring of five segments. If two fingerprints differ in at most 2 bits, some chain of segments on the
ring keeps its cumulative difference within the proportional budget 2 * length / 5 at every
length: 0 after one and two segments, 1 after three and four. So links are only looked for among
fingerprints that agree on two neighbouring segments, and a candidate must pass the longer chain
from there before its full Hamming distance is taken.

Equal fingerprints are one node. Where very many distinct fingerprints share two segments, pairs
are not formed: two fingerprints within 2 bits share a centre within 1 bit of both, and any two
that share a centre are within 2 bits, so each is linked to the least fingerprint of its centres.
Both ways give all links' components; no link is lost and none is capped.

Defined cases: null and empty texts have fingerprint zero, linked like any other; very long texts are split
in pieces of PIECE bytes and hashed in blocks of BLOCK shingles; repeated rows share a component, and ties of id go to the row that
the scan meets first; null ids take part but never name a component unless it has no other; an empty
table gives an empty result; other columns are ignored, whatever their names, and `drop_near` keeps them all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import binaries, cut, lean, match_rows, pick, settled
from .components import components

DISTANCE = 2
#: First bit and width of the ring's segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Distinct fingerprints on one pair of segments above which centres replace pairs.
CROWD = 128
#: Shingles that are hashed at a time.
BLOCK = 1 << 15
#: Bytes of a text that are split into words at a time; a longer word is kept whole.
PIECE = 1 << 18
GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingles(words: list[bytes], start: int, end: int, n: int = 3) -> list[bytes]:
    """The n-word shingles that begin at words start to end - 1."""
    return [b" ".join(words[i : i + n]) for i in range(start, end)]


def word_lists(text: bytes):
    """Words in lists, each from some PIECE bytes, cut at white space."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end].lower().split()  # on bytes: A-Z only, and the contract's white space
        start = end


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Of all n-word shingles, repeats included; of the whole sequence where it has fewer words."""
    ones, many, words = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(parts: list[bytes]) -> None:
        h = np.fromiter((digest(p, seed) for p in parts), np.uint64)
        ones[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for more in word_lists(text):
        words += more  # after the last n - 1 words of the list before, which begin no shingle of their own yet
        here = max(0, len(words) - n + 1)
        for i in range(0, here, BLOCK):
            add(shingles(words, i, min(here, i + BLOCK), n))
        many += here
        words = words[here:]
    if not many and words:
        add([b" ".join(words)])
        many = 1
    return int(np.packbits(2 * ones > many, bitorder="little").view("<u8")[0]) if many else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """One row a document: id, row (its number in the scan), fp (the 64 bits as a long)."""
    frame = settled(pick(docs, id=id_col, text=text_col)).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in binaries(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())], ["id", "row", "fp"])

    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, row long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _chain_links(seg: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pigeonring check of pairs that agree on segments seg and seg + 1, then the Hamming check."""
    diff, ring = a ^ b, [SEGMENTS[(seg + k) % 5] for k in range(5)]
    run = np.zeros(len(a), np.int64)
    ok = np.ones(len(a), bool)
    for length, (at, width) in enumerate(ring, 1):
        part = diff >> np.uint64(at) & np.uint64((1 << width) - 1)
        run += _bits(part)
        ok &= run <= DISTANCE * length // 5
        if length == 4:
            break
    return ok & (_bits(diff) <= DISTANCE)


def _pairs_in_groups(batches):
    """Links within groups of equal (seg, key); the rows come sorted by them, group sizes are bounded."""
    seg, fp, key = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64))
    kept = (seg, key, fp)

    def links(seg, key, fp):
        if len(fp) < 2:
            return None
        first = np.ones(len(fp), bool)
        first[1:] = (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(fp)))
        rank = np.arange(len(fp)) - np.repeat(start, size)
        out = []
        for gap in range(1, int(size.max())):
            i = np.flatnonzero(rank >= gap)
            for s in range(5):
                j = i[seg[i] == s]
                if len(j):
                    yes = _chain_links(s, fp[j], fp[j - gap])
                    out.append((fp[j][yes], fp[j - gap][yes]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.uint64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["x", "y"])

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        kept = tuple(np.concatenate([k, v.astype(np.int64).view(k.dtype)]) for k, v in zip(kept, new, strict=True))
        if len(kept[0]) < 2:
            continue
        same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut_at and (done := links(*(k[:cut_at] for k in kept))) is not None:
            yield done
        kept = tuple(k[cut_at:] for k in kept)
    if (done := links(*kept)) is not None:
        yield done


def fingerprint_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (x, y) between distinct fingerprints (column fp) whose components are those of all links."""
    unsigned = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    parts = [unsigned(*s) for s in SEGMENTS]
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("seg"), F.shiftleft(parts[i], 13).bitwiseOR(parts[(i + 1) % 5]).alias("key")) for i in range(5)])
    spread = nodes.select("fp", F.explode(keys).alias("k")).select("k.seg", "k.key", "fp")
    sizes = spread.groupBy("seg", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = spread.join(sizes, ["seg", "key"])
    pairs = shared.where(F.col("n") <= crowd).select("seg", "key", "fp")
    pairs = pairs.repartition("seg", "key").sortWithinPartitions("seg", "key").mapInArrow(_pairs_in_groups, "x long, y long")
    # Crowded keys: a centre is the fingerprint itself or one bit away from it, outside the agreed segments.
    bits = [[b for k in range(2, 5) for b in range(SEGMENTS[(i + k) % 5][0], sum(SEGMENTS[(i + k) % 5]))] for i in range(5)]
    masks = F.create_map(*[x for i, own in enumerate(bits) for x in (F.lit(i).cast("long"), F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in (0, *(1 << b for b in own))]))])
    around = shared.where(F.col("n") > crowd).select("fp", "seg", F.explode(F.transform(F.element_at(masks, F.col("seg")), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
    # One bit away in any other segment: the same centre whichever key it was reached by.
    nearest = around.groupBy("centre").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")).where("low <> high").select("centre", "low")
    stars = around.select("centre", "fp").distinct().join(nearest, "centre").where("fp <> low").select(F.col("fp").alias("x"), F.col("low").alias("y"))
    return pairs.union(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row a document: id, row, fp, component_id (least id of its component), stays (one row of each component)."""
    prints = cut(fingerprints(docs, id_col, text_col, n), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "row")
    nodes = cut(prints.groupBy("fp").agg(F.min(first).alias("least")), "nodes")
    roots = components(fingerprint_links(nodes, crowd).select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.select("fp", "root").join(placed.groupBy("root").agg(F.min("least").alias("lowest")), "root").select("fp", "lowest")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "row", "fp", F.col("lowest.id").alias("component_id"), (F.col("row") == F.col("lowest.row")).alias("stays"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id; all columns stay."""
    docs = settled(docs)
    return match_rows(docs, near_groups(docs, id_col, text_col).where("stays"), "left_semi")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_components(rows: list[tuple[int, int]]) -> dict[int, int]:
    """Component of each id from (id, fp) by comparing all pairs; for tests."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fps = np.array([f for _, f in rows], np.uint64)
    for k, (i, f) in enumerate(rows):
        for j in np.flatnonzero(np.bitwise_count(fps ^ np.uint64(f)) <= DISTANCE):
            a, b = find(i), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}
