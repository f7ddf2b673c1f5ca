"""Token-ID files: flat unsigned integers and 64-bit document offsets, memory-mapped.

Each task takes a range of document ids in ascending order and writes one pair of files:
    part-NNNNN.bin   token ids, 16 or 32 bits as the vocabulary needs, little-endian
    part-NNNNN.idx   int64: number of documents n, how many of them (the first ones) have a null id,
                     n document ids (0 for a null one), n + 1 offsets into the .bin
A prefix sum over the parts' totals (one small row a part) gives each part's base, so a document
starts at base + offset. Files are written under a temporary name and renamed, so that a task that
runs again after a lost executor replaces its file whole. Where the scan is not in the order of ids,
the table is dealt into ranges of about PART_CHARS of text.

The folder must be one that the driver and all executors reach as files (a shared mount), since
the files are memory-mapped; the driver looks for every file before it reads any back.

The tokenizers library is slow on long texts and the same words recur, so texts are cut at ASCII
white space, which this vocabulary drops, and each distinct word is encoded once a task: words of
plain letters, digits and marks are lower-cased and split here, and the library's model merges each
distinct pre-token; all others go through the whole library.

Defined cases: null and empty texts hold the end id only; repeated rows each have their place (ties
in scan order); null ids come first and are null again when read; very long texts are split into words
SWEEP bytes at a time; an empty table gives no files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_letters
from .common import binaries, by_size, lean, new_folder, pick, settled

ROWS = 1000
#: Characters of text in a part, where parts are dealt.
PART_CHARS = 256 << 20
#: Bytes of text whose new words are learned together.
SWEEP = 2 << 20


class WordEncoder:
    """Token ids of whole texts as the library gives them for a vocabulary that drops white space
    and marks word ends; `</w>` ends a word's last symbol."""

    #: Pre-tokens of lower-case text in the letters below (the vocabulary's own pattern, fixed).
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-z0-9ªµºÀ-ÖØ-öø-ɏ]+")
    #: Letters, digits and marks that need nothing but lower case: ASCII, and Latin letters that are their own composed form.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ž]+")

    def __init__(self, path: str, remember: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = len(spec["model"]["vocab"]) + len(spec["added_tokens"])
        self.letters = {b: c for c, b in byte_letters().items()}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.remember = remember

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token, merged by the library's model."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.library.model.tokenize(piece)]).tobytes()

    def learn(self, words: list[bytes]) -> None:
        if len(self.pieces) > self.remember:
            self.pieces.clear()
        hard, known = [], self.pieces
        for w in words:
            text = w.decode()
            if not self.PLAIN.fullmatch(text) or self.special.search(text):
                hard.append((w, text))
                continue
            parts = self.PIECES.findall(text.lower())
            for p in parts:
                if p not in known:
                    known[p] = self.piece(p)
            self.words[w] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        for (w, _), e in zip(hard, self.library.encode_batch([t for _, t in hard], add_special_tokens=False), strict=True):
            self.words[w] = array("I", e.ids).tobytes()

    def many(self, texts: list[bytes]):
        """Token ids of each text; new words of several texts are learned together."""
        for a, b in by_size(texts, SWEEP):
            cut = [list(split_at_space(t, SWEEP)) for t in texts[a:b]]
            if max(map(len, cut), default=1) == 1:
                yield from self.sweep([c[0] for c in cut])
            else:  # one very long text
                for c in cut:
                    yield np.concatenate([x for piece in c for x in self.sweep([piece])])

    def sweep(self, texts: list[bytes]) -> list[np.ndarray]:
        words = [t.split() for t in texts]
        if len(self.words) > self.remember:
            self.words.clear()
        new = set().union(*words).difference(self.words)
        if new:
            self.learn(list(new))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, w)), np.uint32) for w in words]

    def __call__(self, text: bytes) -> np.ndarray:
        return next(self.many([text]))


SPACE = re.compile(rb"[ \t-\r]")


def split_at_space(text: bytes, most: int):
    """The text in slices of `most` bytes or a little more, cut at ASCII white space; a word is never cut."""
    at = 0
    while len(text) - at > most and (space := SPACE.search(text, at + most)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


@functools.lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def local(folder: str) -> str:
    """The folder as files see it."""
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped, so they need a shared mount, not {folder}")
    return unquote(u.path) if u.scheme else folder


def in_order(frame: DataFrame) -> bool:
    """Whether the scan's tasks already hold ascending, disjoint ranges of ids (one row a task is looked at)."""
    from pyspark.sql import Window

    seen = frame.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("row"))

    def look(batches):
        low = high = task = None
        ok = True
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            task = b.column(1)[0].as_py()
            v = ids.to_numpy(zero_copy_only=False)
            ok = ok and not ids.null_count and bool((v[1:] >= v[:-1]).all()) and (high is None or v[0] >= high)
            if ids.null_count:
                break
            low, high = (v[0] if low is None else low), v[-1]
        if task is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([task], pa.int32()), "ok": [ok], "low": pa.array([low if ok else None], pa.int64()), "high": pa.array([high if ok else None], pa.int64())})

    parts = seen.mapInArrow(lean(look), "p int, ok boolean, low long, high long")
    after = F.lag("high").over(Window.orderBy("p"))
    rows = parts.select("ok", (F.coalesce(after, F.col("low")) <= F.col("low")).alias("rises"))
    return rows.where("not ok or not rises").limit(1).count() == 0


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes the files in ascending id order; returns a row a part: part, n_docs, n_tokens, base (tokens of all parts before)."""
    spark = docs.sparkSession
    frame = settled(pick(docs, id=id_col, text=text_col))
    if frame.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError("document ids must be integers")
    frame = frame.withColumn("id", F.col("id").cast("long"))
    path = local(folder)
    os.makedirs(path, exist_ok=True)
    if in_order(frame):
        ordered = frame
    else:
        chars = frame.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
        ordered = frame.repartitionByRange(parts, "id").sortWithinPartitions("id")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def write(batches):
        out, sizes, ids, part, n, nulls = None, [0], [], None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encode = encoder(tokenizer)
                kind = "<u2" if encode.size <= 1 << 16 else "<u4"
                part = batch.column(2)[0].as_py()
                name = f"{path}/part-{part:05d}"
                mark = f".{os.getpid()}.{os.urandom(4).hex()}"
                out = open(f"{name}.bin{mark}", "wb")
            ids.append(batch.column(0).fill_null(0).to_numpy())
            nulls += batch.column(0).null_count  # they sort first
            for found in encode.many(binaries(batch.column(1))):
                found = np.append(found, np.uint32(end_id)).astype(kind)
                out.write(found.tobytes())
                n += len(found)
                sizes.append(n)
        if out is not None:
            out.close()
            head = np.concatenate([np.array([len(sizes) - 1, nulls]), *ids, np.array(sizes)]).astype("<i8")
            with open(f"{name}.idx{mark}", "wb") as f:
                f.write(head.tobytes())
            os.replace(f"{name}.bin{mark}", f"{name}.bin")
            os.replace(f"{name}.idx{mark}", f"{name}.idx")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(sizes) - 1], "n_tokens": [n], "bits": pa.array([16 if kind == "<u2" else 32], pa.int32())})

    parts = sorted(ordered.mapInArrow(lean(write), "part int, n_docs long, n_tokens long, bits int").collect())  # a row a part
    base, table = 0, []
    for p in parts:
        table.append((p["part"], p["n_docs"], p["n_tokens"], p["bits"], base))
        base += p["n_tokens"]
    missing = [p["part"] for p in parts if not os.path.exists(f"{path}/part-{p['part']:05d}.idx")]
    if missing:
        raise RuntimeError(f"the driver does not see the executors' files of parts {missing[:5]}: {path} must be a folder that all share")
    with open(f"{path}/parts.json", "w") as f:
        json.dump([dict(zip(("part", "n_docs", "n_tokens", "bits", "base"), t, strict=True)) for t in table], f)
    return spark.createDataFrame(table, "part int, n_docs long, n_tokens long, bits int, base long")


class TokenFile:
    """One part, memory-mapped: ids of document i are tokens[offsets[i]:offsets[i + 1]]."""

    def __init__(self, folder: str, part: int, bits: int):
        name = f"{local(folder)}/part-{part:05d}"
        head = np.memmap(f"{name}.idx", "<i8", "r")
        n, self.nulls = int(head[0]), int(head[1])
        self.doc_ids, self.offsets = head[2 : n + 2], head[n + 2 :]
        self.tokens = np.memmap(f"{name}.bin", f"<u{bits // 8}", "r") if os.path.getsize(f"{name}.bin") else np.zeros(0, np.uint32)

    def __len__(self):
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""

    def read(batches):
        for batch in batches:
            for p in batch.to_pylist():
                file = TokenFile(folder, p["part"], p["bits"])
                for a in range(0, len(file), ROWS):
                    b = min(len(file), a + ROWS)
                    offsets = np.array(file.offsets[a : b + 1])
                    crc = [zlib.crc32(file[i].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(file.doc_ids[a:b]), mask=np.arange(a, b) < file.nulls), pa.array(p["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, parts.count())
    return parts.repartition(n).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str, folder: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = folder or new_folder(spark, "tokens")
    parts = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(parts, folder)
