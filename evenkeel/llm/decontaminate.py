"""Benchmark decontamination with one FM-index per training shard.

A shard is a batch of documents written as word numbers of the benchmark's vocabulary; every other
word is the same separator, and stretches too short to hold any window are left out (they cannot
match). The shard's suffix array gives its Burrows-Wheeler transform, kept as a wavelet matrix of
packed bits; all windows are searched backwards at once by ranks, those that no suffix begins with
being let go on the way, occurrences are located from sampled suffix positions by walking back, and
the word spans are merged per document.

The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text, packed as arrays: word
numbers, where distinct windows begin, and the items of each (some 10 bytes for each byte of text).
One block is one pass over the documents; of more blocks, each pass keeps only the documents that it
hits, in the shared folder, and its broadcast is let go before the next.

Defined cases: null and empty texts and items have no words, and such documents are not contaminated;
items of the same words all count; an item without an id marks words as hit and is not listed; repeated
rows are judged each for itself; very long texts are a shard of their own; an empty benchmark
contaminates nothing and an empty table gives an empty result; other columns are ignored, whatever
their names, and `drop_contaminated` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binaries, cut, lean, match_rows, merge_runs, pick, settled

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once; more text makes more passes.
BLOCK_BYTES = 8 << 20
#: Words of a shard, about.
SHARD = 1 << 20
#: Every so many positions of a shard's suffixes are kept for locating.
EVERY = 8
#: Windows that are searched at a time, and occurrences that are located at a time.
SWEEP = 1 << 17
#: A-Z to a-z; ASCII that is no letter or digit to space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first `depth` words or more, by prefix doubling; the end is least."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        rank, k = new, 2 * k
        if rank.max() == n or k >= n:
            return order


class Bits:
    """A row of bits in words of 64, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """How many of the first bits are set."""
        word = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """A sequence of numbers by their bits, highest first; each level holds the last one's zeros, then its ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros: list[int] = []
        self.bits: list[Bits] = []
        now = values
        for level in reversed(range(self.levels)):
            b = (now >> level & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(len(now) - int(b.sum()))
            now = np.concatenate([now[~b], now[b]])

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value stands before its position."""
        low, high = np.zeros_like(upto), upto
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            lo1, hi1 = bits.ones(low), bits.ones(high)
            one = (value >> (self.levels - 1 - level) & 1) == 1
            low, high = np.where(one, zeros + lo1, low - lo1), np.where(one, zeros + hi1, high - hi1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            bit, ones = bits.at(at), bits.ones(at)
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """Over a sequence of numbers from 1; 0 ends it. Suffixes are fully sorted: the end is unique."""

    def __init__(self, text: np.ndarray, every: int = EVERY):
        text = np.append(text, 0)
        order = suffix_array(text, len(text))
        self.last = WaveletMatrix(text[order - 1], int(text.max()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.last.levels))])
        sampled = order % every == 0
        self.sampled, self.upto, self.where = sampled, np.concatenate([[0], np.cumsum(sampled)]), order[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each pattern (rows); by one step back a column. Empty ranges go no further."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        left = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            known = column[left] < len(self.first) - 1  # other words are not in the text
            low[left[~known]] = high[left[~known]] = 0
            left = left[known]
            c = column[left].astype(np.int64)
            lo, hi = self.first[c] + self.last.rank(c, low[left]), self.first[c] + self.last.rank(c, high[left])
            low[left], high[left] = lo, np.maximum(lo, hi)
            left = left[hi > lo]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each suffix."""
        out, walked, left = np.empty(len(at), np.int64), 0, np.arange(len(at))
        while len(left):
            here = self.sampled[at]
            out[left[here]] = self.where[self.upto[at[here]]] + walked
            left, at, walked = left[~here], at[~here], walked + 1
            if len(left):
                c = self.last.access(at)
                at = self.first[c] + self.last.rank(c, at)
        return out % self.n


def phrase_classes(seq: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Numbers of the n words from each start: equal exactly where all words are (by doubling)."""
    k, rank = 1, seq.astype(np.int64)
    while 2 * k <= n:
        pair = rank[: len(rank) - k] * (int(rank.max(initial=0)) + 1) + rank[k:]
        rank, k = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * k
    return np.unique(rank[starts] * (int(rank.max(initial=0)) + 1) + rank[starts + n - k], return_inverse=True)[1]


class Phrases:
    """Windows of a block of items as arrays: word numbers, where distinct windows begin by length, items of each.

    Word 0 is any other word, 1 separates; the vocabulary begins at 2.
    """

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        parts, firsts, sizes, owners = [], [], [], []
        self.names = [None if item is None else str(item) for item, _ in items]
        at = 0
        for i, (_, text) in enumerate(items):
            ids = [self.words.setdefault(w, len(self.words) + 2) for w in words_of(text.encode())]
            if ids:
                parts.append(np.array(ids, np.int32))
                firsts.append(at)
                sizes.append(len(ids))
                owners.append(i)
                at += len(ids)
        self.seq = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first, size, owner = np.array(firsts, np.int64), np.array(sizes, np.int64), np.array(owners, np.int32)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # length, starts of distinct windows, where their items begin, items
        for n in np.unique(np.minimum(size, window)).tolist():
            own = np.flatnonzero(np.minimum(size, window) == n)
            many = size[own] - n + 1
            begin = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            kind = phrase_classes(self.seq, n, begin)
            pair = np.unique(kind * len(items) + np.repeat(owner[own], many))
            starts = np.zeros(int(kind.max()) + 1, np.int32)
            starts[kind] = begin
            self.groups.append((n, starts, np.searchsorted(pair // len(items), np.arange(len(starts) + 1)).astype(np.int32), (pair % len(items)).astype(np.int32)))
        self.shortest = min((n for n, *_ in self.groups), default=0)


def search_shard(phrases: Phrases, texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, set[str]]]:
    """(number of words, span starts, span ends, items) of each text; spans are merged, in words."""
    get, sizes, parts, place, doc = phrases.words.get, [], [], [], []
    for i, t in enumerate(texts):
        words = words_of(t)
        sizes.append(len(words))
        if len(words) < phrases.shortest or not phrases.shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids)
        if len(known) < phrases.shortest:
            continue
        first = np.concatenate([[True], np.diff(known) != 1])
        start = known[first]
        end = known[np.append(first[1:], True)] + 1
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            if e - s >= phrases.shortest:
                parts += [ids[s:e], [1]]
                place.append(np.append(np.arange(s, e), -1))
                doc.append(np.full(e - s + 1, i))
    none = np.zeros(0, np.int64)
    spans, items = {}, {}
    if parts:
        index = FMIndex(np.concatenate(parts).astype(np.int64))
        spans, items = _occurrences(phrases, index, np.concatenate(place), np.concatenate(doc))
    return [(size, *spans.get(i, (none, none)), items.get(i, set())) for i, size in enumerate(sizes)]


def _occurrences(phrases: Phrases, index: FMIndex, place: np.ndarray, doc: np.ndarray):
    """Merged spans and the items of each document of a shard."""
    far = int(place.max()) + WINDOW + 2 + max(n for n, *_ in phrases.groups)  # no word number of a document reaches it
    starts, ends, owned = [], [], []
    for n, windows, begin, item in phrases.groups:
        for a in range(0, len(windows), SWEEP):
            low, high = index.search(phrases.seq[windows[a : a + SWEEP, None] + np.arange(n)])
            found = np.flatnonzero(high > low)
            edge = np.concatenate([[0], np.cumsum(high[found] - low[found])])
            for b in range(0, int(edge[-1]), SWEEP):
                hit = np.arange(b, min(b + SWEEP, int(edge[-1])))
                k = np.searchsorted(edge, hit, "right") - 1
                at = index.locate(low[found[k]] + hit - edge[k])
                window = found[k] + a
                s, e = merge_runs(doc[at] * far + place[at], doc[at] * far + place[at] + n)
                starts.append(s)
                ends.append(e)
                pair = np.unique(doc[at] * len(windows) + window)  # each document and window once
                d, w = pair // len(windows), pair % len(windows)
                many = (begin[w + 1] - begin[w]).astype(np.int64)
                own = item[np.repeat(begin[w] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                owned.append(np.unique(np.repeat(d, many) * len(phrases.names) + own))
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    items: dict[int, set[str]] = {}
    if starts:
        s, e = merge_runs(np.concatenate(starts), np.concatenate(ends))
        d = s // far
        for i in np.unique(d).tolist():
            a, b = np.searchsorted(d, [i, i + 1])
            spans[i] = (s[a:b] - i * far, e[a:b] - i * far)
        pair = np.unique(np.concatenate(owned))
        for i, k in zip((pair // len(phrases.names)).tolist(), (pair % len(phrases.names)).tolist(), strict=True):
            name = phrases.names[k]
            if name is not None:
                items.setdefault(i, set()).add(name)
    return spans, items


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of at most block_bytes of text (one item at least), a partition of the table at a time."""
    block, size = [], 0
    for r in pick(benchmark, item=item_col, text=text_col).toLocalIterator():
        text = r["text"] or ""
        if block and size + len(text.encode()) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item"], text))
        size += len(text.encode())
    yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: id, row, n_words, spans (array of start, end in words, merged), items (sorted array of item ids as text)."""
    spark = docs.sparkSession
    frame = settled(pick(docs, id=id_col, text=text_col)).withColumn("row", F.monotonically_increasing_id())
    kind = frame.schema["id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def one_pass(block) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(Phrases(block, window))  # bounded by block_bytes

        def run(batches):
            for batch in batches:
                texts, out = binaries(batch.column(1)), []
                shard, size = [], 0
                for t in [*texts, None]:
                    if t is None or (shard and size + len(t) > SHARD * 6):
                        out += search_shard(shared.value, shard)
                        shard, size = [], 0
                    if t is not None:
                        shard.append(t)
                        size += len(t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in zip(o[1].tolist(), o[2].tolist(), strict=True)] for o in out], pa.list_(span)), pa.array([sorted(o[3]) for o in out], pa.list_(pa.string()))],
                    ["id", "row", "n_words", "spans", "items"],
                )

        return frame.mapInArrow(lean(run), f"id {kind}, row long, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"), shared

    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    found, shared = one_pass(next(blocks))
    rest = []
    for block in blocks:
        more, own = one_pass(block)
        rest.append(cut(more.where("size(spans) > 0"), "hits"))
        own.destroy()
    if not rest:
        return found.withColumnRenamed("id", id_col)
    rows = cut(found, "hits")
    shared.destroy()
    for more in rest:
        rows = rows.union(more)
    all_rows = rows.groupBy("row").agg(F.first("id").alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (m, s) ->
        if(size(m) > 0 and element_at(m, -1).end >= s.start,
           concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end)))),
           concat(m, array(s))))"""
    return all_rows.select(id_col, "row", "n_words", F.expr(merged).alias("spans"), "items")


def judged(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns stay."""
    docs = settled(docs)
    return match_rows(docs, judged(benchmark_hits(docs, benchmark, id_col, text_col)).where("contaminated"), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = judged(benchmark_hits(read("documents"), read("benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute_hits(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """(words, hit words, items) of one text by direct comparison; for tests."""
    words = words_of((text or "").encode())
    hit, which = [False] * len(words), []
    for item, t in items:
        own = words_of((t or "").encode())
        found = False
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit[j : j + len(w)] = [True] * len(w)
                    found = True
        if found and item is not None:
            which.append(str(item))
    return len(words), sum(hit), sorted(set(which))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + least(13, len(w))), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
