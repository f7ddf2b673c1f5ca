"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A part is up to PART_CHARS of a scan task's documents. Its pre-tokens are replaced by numbers into
its own list of distinct words (the positions: a document is the ordered list of its numbers). The
distinct words of all parts are shuffled by their hash into buckets; each distinct word of a bucket is
encoded once, and the ids go back to the parts that asked; there documents are reassembled by
position. What is shuffled is distinct words, their ids and numbered positions, all as compressed
columns (a row a word and position would be some five times the text), and no word or part is
repeated more often than there are parts, so that no word is hot. Partitions grow in number with
the text, so that their size stays the same.

Decoding joins ids with the token-byte table by their number, a batch at a time: all bytes are
taken at once, and a document's are one slice of them.

The scan is read twice (words, then positions). A table that may not give the same rows twice is
written first; a checksum of the word list travels with both readings, and a mismatch is an
error rather than a wrong result.

Defined cases: null and empty texts give no ids; repeated rows are encoded each for itself; null
ids are kept; very long texts are taken in slices of SWEEP characters, cut where a pre-token starts
whatever came before (one unbroken pre-token is held whole); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .bpe import read_ranks
from .common import by_size, lean, pick, settled, strings
from .pretoken import pretokens, slices

PART_CHARS = 8 << 20
SWEEP = 1 << 18
#: Characters of documents whose positions travel in one row.
ROW_CHARS = 1 << 20
#: Characters of documents whose words and positions meet in one partition.
PARTITION_CHARS = 2 * PART_CHARS
#: Buckets of words at most: each part sends a row to each bucket that it has words of. A bucket's distinct words are held together.
BUCKETS = 1 << 12
#: Ids that are decoded at a time.
DECODE = 1 << 18


@functools.lru_cache(2)
def word_encoder(path: str):
    """A function from one pre-token to its ids."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary


@functools.lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: the bytes of each id, by id."""
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        out[i] = b
    return pa.array(out, pa.large_binary())


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, low bytes first, so that equal places compress together."""
    return _pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Part:
    """Distinct words of a part in order of first sight; positions of its documents."""

    def __init__(self):
        self.words = _Numbers()
        self.chars = self.docs = 0

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' pre-tokens in order, and how many each text has."""
        found, lengths, cut, owner = [], np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            own = list(slices(t, SWEEP))
            cut += own
            owner += [i] * len(own)
        for a, b in by_size(cut, SWEEP):
            pieces, upto = pretokens(cut[a:b])
            found.append(np.fromiter(map(self.words.__getitem__, pieces), np.uint32, len(pieces)))
            np.add.at(lengths, owner[a:b], np.diff(upto))
        self.chars += sum(map(len, texts))
        self.docs += len(texts)
        return np.concatenate(found), lengths

    def in_buckets(self, buckets: int) -> tuple[np.ndarray, list[bytes]]:
        """Bucket of each word, and the words."""
        words = [w.encode() for w in self.words]
        return np.array([zlib.crc32(w) % buckets for w in words], np.uint32), words


def _parts(batches):
    """(number of the part, part, ids of documents, numbered slice) in the order of the scan; None as slice ends a part."""
    seq, part = 0, _Part()
    for batch in batches:
        texts, ids = strings(batch.column(1)), batch.column(0)
        for a, b in by_size(texts, ROW_CHARS):
            yield seq, part, ids.slice(a, b - a), *part.number(texts[a:b])
            if part.chars >= PART_CHARS:
                yield seq, part, None, None, None
                seq, part = seq + 1, _Part()
    if part.docs:  # of null or empty texts alone, too: their rows wait for the part's end
        yield seq, part, None, None, None


def _named(batches):
    """_parts, with the part's name in place of its number: the scan's task and the number."""
    task = []

    def seen():
        for batch in batches:
            if batch.num_rows:
                task[:] = [batch.column(2)[0].as_py()]
                yield batch

    for seq, *rest in _parts(seen()):
        yield f"{task[0]}.{seq}", *rest


_ROWS = "part string, kind int, at long, n long, data binary"


def encode_documents(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row a document: id, ids (array of token ids). rank_file: a file that every executor has."""
    spark = docs.sparkSession
    frame = settled(pick(docs, id=id_col, text=text_col)).withColumn("task", F.spark_partition_id())
    id_field = frame.schema["id"].dataType
    chars = frame.agg(F.sum(F.length("text"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PARTITION_CHARS))
    buckets = buckets or min(BUCKETS, width)

    def ask(batches):
        """Distinct words of each part, by bucket."""
        for name, part, ids, _, _ in _named(batches):
            if ids is None and part.words:
                bucket, words = part.in_buckets(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in range(buckets):
                    own = [words[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
                    if own:
                        body = np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own)
                        yield pa.RecordBatch.from_pydict({"part": [name], "kind": pa.array([k], pa.int32()), "at": [zlib.crc32(b"".join(words))], "n": [len(own)], "data": [_pack(body)]})

    def answer(batches):
        """Ids of each asked word, in the order asked; each distinct word of a bucket is encoded once. Rows come by bucket."""
        encode, known, bucket = word_encoder(rank_file), {}, None
        for batch in batches:
            for part, kind, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != bucket:
                    bucket, known = kind, {}
                body = zstandard.decompress(data)
                ends = np.cumsum(np.frombuffer(body, "<u4", n)).tolist()
                base, start, out = 4 * n, 0, []
                for e in ends:
                    w = body[base + start : base + e]
                    start = e
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = array("I", encode(w.decode())).tobytes()
                    out.append(ids)
                lengths = np.fromiter(map(len, out), np.uint32, n) // np.uint32(4)
                flat = np.frombuffer(b"".join(out), np.uint32)
                yield pa.RecordBatch.from_pydict({"part": [part], "kind": pa.array([kind], pa.int32()), "at": [at], "n": [n], "data": [_planes(np.concatenate([lengths, flat]))]})

    def place(batches):
        """Positions of documents, and at the end of each part the bucket of each of its words."""
        count = 0
        for name, part, ids, positions, lengths in _named(batches):
            if ids is None:
                bucket, words = part.in_buckets(buckets)
                yield pa.RecordBatch.from_pydict({"part": [name], "kind": pa.array([-1], pa.int32()), "at": [zlib.crc32(b"".join(words))], "n": [len(words)], "data": [_planes(bucket)]})
                continue
            count += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
            head = sink.getvalue().to_pybytes()
            data = len(head).to_bytes(8, "little") + head + _planes(np.concatenate([lengths.astype(np.uint32), positions]))
            yield pa.RecordBatch.from_pydict({"part": [name], "kind": pa.array([buckets], pa.int32()), "at": [count], "n": [len(ids)], "data": [data]})

    def reassemble(batches):
        """Rows of a part in the order: bucket of its words, ids by bucket, documents."""
        part = bucket = check = None
        lengths, flats, offset, size, flat = [], [], None, None, None
        for batch in batches:
            for name, kind, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != part:
                    part, bucket, check, offset = name, None, None, None
                    lengths, flats = [], []
                if kind == -1:
                    bucket, check = _numbers(data), at
                elif kind < buckets:
                    if at != check:
                        raise RuntimeError("the scan gave other rows when it was read again; write the table first")
                    body = _numbers(data)
                    lengths.append(body[:n])
                    flats.append(body[n:])
                else:
                    if offset is None:
                        size = np.concatenate(lengths or [np.zeros(0, np.uint32)]).astype(np.int64)
                        flat = np.concatenate(flats or [np.zeros(0, np.uint32)])
                        if bucket is None or len(size) != len(bucket):
                            raise RuntimeError("the scan gave other rows when it was read again; write the table first")
                        by_bucket = np.argsort(bucket, kind="stable")
                        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
                        offset, own = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
                        offset[by_bucket], own[by_bucket] = first, size
                        size = own
                    head = int.from_bytes(data[:8], "little")
                    ids = pa.ipc.open_stream(data[8 : 8 + head]).read_all().combine_chunks().column(0)
                    body = _numbers(data[8 + head :])
                    counts, positions = body[:n].astype(np.int64), body[n:]
                    many = size[positions]
                    ends = np.cumsum(many)
                    total = int(ends[-1]) if len(ends) else 0
                    at_id = np.repeat(offset[positions] - (ends - many), many) + np.arange(total)
                    doc_ends = np.concatenate([[0], ends])[np.cumsum(counts)] if n else np.zeros(0, np.int64)
                    offsets = np.concatenate([[0], doc_ends]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at_id].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, values], ["id", "ids"])

    asked = frame.mapInArrow(lean(ask), _ROWS).repartition(width, "kind").sortWithinPartitions("kind")
    answers = asked.mapInArrow(lean(answer), _ROWS)
    rows = answers.union(frame.mapInArrow(lean(place), _ROWS))
    together = rows.repartition(width, "part").sortWithinPartitions("part", "kind", "at")
    out = together.mapInArrow(lean(reassemble), f"id {id_field.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a document: id, ids, bytes (joined from the token-byte table). Null ids decode like none; an id outside the table is an error."""
    frame = pick(encoded, id=id_col, ids=ids_col)

    def decode(batches):
        table = token_bytes(rank_file)
        for batch in batches:
            n = batch.num_rows
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64) if n else np.zeros(1, np.int64)
            at = 0
            while at < n:  # so many ids at a time, one document at least
                to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + DECODE, "right")) - 1))
                some = batch.slice(at, to - at)
                pieces = table.take(some.column(1).flatten())
                if pieces.null_count:
                    raise ValueError("a token id is not in the token-byte table")
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))]).astype(np.int64)
                starts = ends[offsets[at : to + 1] - offsets[at]]
                joined = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(starts), pieces.buffers()[2]])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), joined.cast(pa.binary())], ["id", "ids", "bytes"])
                at = to

    return frame.mapInArrow(lean(decode), f"id {frame.schema['id'].dataType.simpleString()}, ids array<int>, bytes binary").withColumnRenamed("id", id_col)


def op6_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decode_ids(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path))


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
