import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from evenkeel.llm import bpe, codec, counts, pretoken, tokenfiles

from .conftest import by_id

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PATTERN = regex.compile(P.PATTERN)
ALPHABET = "abstmdrevlRS'' \n\t 12é！!., 　ß中"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def random_texts(n, most, alphabet=ALPHABET, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pretokens():
    texts = [*random_texts(1500, 40), *random_texts(20, 3000, seed=2), "ab\n\n\n" * 300, " " * 2000 + "x", "'" * 700 + "s", "it'r", "we'l", ""]
    words, upto = pretoken.pretokens(texts)
    assert [words[a:b] for a, b in zip(upto, upto[1:], strict=False)] == [PATTERN.findall(t) for t in texts]


@pytest.mark.parametrize("block", [1, 2, 7, 25, 64, 100_000])
def test_blocks_do_not_matter(block):
    for t in random_texts(20, 500, seed=block):
        kinds = pretoken.class_table()[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
        assert np.array_equal(pretoken.starts_of(kinds, block), pretoken.starts_of(kinds))


def test_classes_are_the_librarys():
    """Every letter and number that the library knows (sampled blocks of all code points)."""
    pre = library("byte_bpe_50k.json").pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}\n{chr(c)}" for c in points]
    words, upto = pretoken.pretokens(texts)
    for t, a, b in zip(texts, upto, upto[1:], strict=False):
        assert words[a:b] == [t[x:y] for _, (x, y) in pre.pre_tokenize_str(t)]


def test_counts(rows, docs, clashing, empty):
    lib = library("byte_bpe_50k.json")
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    path = P.path("byte_bpe_50k.json")
    for frame in (docs, clashing):
        assert by_id(counts.count_tokens(frame, path), "doc_id", "n_bytes", "n_tokens") == want
    assert counts.count_tokens(empty, path).collect() == []


def test_count_transducer():
    lib = library("byte_bpe_50k.json")
    texts = random_texts(300, 60, "abcdefghijklmnopqrstuvwxyzABC aeiou théñ0123")
    counter = counts.Counter(P.path("byte_bpe_50k.json"))
    assert counter(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    machine = counter.transducer
    tokens = list(machine.made)
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert machine.fits(a, b) == (bpe.merge(a + b, machine.ranks) == [a, b])
    machine.most = 10  # forgets all the time, counts the same
    assert [machine.count(w.encode()) for w in ["hello", " world", "unbelievable"]] == [len(bpe.merge(w.encode(), machine.ranks)) for w in ["hello", " world", "unbelievable"]]


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec(rows, docs, clashing, empty, reference_encoding, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    want = []
    for i, t in rows:
        ids = reference_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    want.sort(key=str)
    run = lambda f: by_id(codec.digests(codec.decode_ids(codec.encode_documents(f, path), path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert run(docs) == want
    assert run(clashing) == want
    assert run(empty) == []
    monkeypatch.setattr(codec, "PART_CHARS", 3000)
    monkeypatch.setattr(codec, "ROW_CHARS", 500)
    monkeypatch.setattr(codec, "DECODE", 50)
    assert run(docs) == want


def test_codec_of_empty_texts_alone(spark, reference_encoding, monkeypatch):
    """Tasks without a word, and a part that ends just before empty texts."""
    path = P.path("byte_bpe_50k.tiktoken")
    run = lambda rows: by_id(codec.decode_ids(codec.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path), path), "doc_id", "ids", "bytes")
    want = lambda rows: sorted(((i, reference_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    for rows in ([(1, "")], [(1, None)], [(i, [None, ""][i % 2]) for i in range(50)]):
        assert run(rows) == want(rows)
    monkeypatch.setattr(codec, "PART_CHARS", 300)
    monkeypatch.setattr(codec, "ROW_CHARS", 100)
    rows = [(0, None), (1, "sun and moon " * 30), (2, ""), (3, None), (4, "")]
    assert run(rows) == want(rows)


def test_slices_keep_pretokens():
    for t in [*random_texts(300, 300), "it'r we'll  x y\n z 's " * 50, "ab" * 500]:
        for most in (1, 7, 50):
            cut = list(pretoken.slices(t, most))
            assert "".join(cut) == t
            assert [w for c in cut for w in PATTERN.findall(c)] == PATTERN.findall(t)


def test_long_words_and_texts(spark, reference_encoding):
    """One unbroken word of 100,000 letters, and a text of 3 million characters."""
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(500_000))
    docs = spark.createDataFrame([(1, word), (2, text), (3, "a")], "doc_id long, text string").coalesce(1)
    path = P.path("byte_bpe_50k.tiktoken")
    want = [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, word), (2, text), (3, "a")) for ids in [reference_encoding.encode_ordinary(t)]]
    assert by_id(codec.digests(codec.decode_ids(codec.encode_documents(docs, path), path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    lib = library("byte_bpe_50k.json")
    assert by_id(counts.count_tokens(docs, P.path("byte_bpe_50k.json")), "doc_id", "n_tokens") == [(i, len(lib.encode(t, add_special_tokens=False).ids)) for i, t in ((1, word), (2, text), (3, "a"))]
    lib = library("word_bpe_49k.json")
    encoded = tokenfiles.WordEncoder(P.path("word_bpe_49k.json")).many([word.encode(), text.encode()])
    assert [x.tolist() for x in encoded] == [lib.encode(t, add_special_tokens=False).ids for t in (word, text)]


def test_decoding_unknown_ids(spark):
    frame = spark.createDataFrame([(1, [0, 60_000_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="out of bounds|not in the token-byte table"):
        codec.decode_ids(frame, P.path("byte_bpe_50k.tiktoken")).collect()


def test_word_encoder_is_the_library():
    enc = tokenfiles.WordEncoder(P.path("word_bpe_49k.json"))
    alphabet = "abcsStTrRvVeElLmMdD'' ,.!?_-0129²½ªº×÷ÀéÿŸžſİıßκΣ中́\x1c\x85\xa0\n\t<|>^`~@#"
    texts = [*random_texts(3000, 30, alphabet), "<|endoftext|>a <|startoftext|>", "x<|endoftext|>y", ""]
    want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.many([t.encode() for t in texts])] == want
    points = [f"a{chr(c)}b {chr(c)}" for c in range(0x21, 0x250)]
    assert [x.tolist() for x in enc.many([t.encode() for t in points])] == [e.ids for e in enc.library.encode_batch(points, add_special_tokens=False)]


@pytest.mark.parametrize("ordered", [True, False])
def test_token_files(spark, rows, docs, empty, tmp_path, ordered):
    lib = library("word_bpe_49k.json")
    path = P.path("word_bpe_49k.json")
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    frame = spark.createDataFrame(known, "doc_id long, text string").coalesce(1) if ordered else docs.where("doc_id is not null")
    assert tokenfiles.in_order(frame.selectExpr("doc_id as id", "text")) == ordered
    parts = tokenfiles.write_token_files(frame, path, str(tmp_path / "a"))
    got = sorted(tuple(r) for r in tokenfiles.read_token_files(parts, str(tmp_path / "a")).collect())
    start, want = 0, []
    for i, t in known:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same = lambda x: sorted((i, n, c) for i, _, n, c in x)  # noqa: E731  repeated ids may swap places
    assert same(got) == same(want)
    once = {i for i, _ in known if [k for k, _ in known].count(i) == 1}
    assert [x for x in got if x[0] in once] == [x for x in want if x[0] in once]
    first = parts.orderBy("base").first()
    assert tokenfiles.TokenFile(str(tmp_path / "a"), first["part"], first["bits"])[0].tolist() == lib.encode(known[0][1] or "", add_special_tokens=False).ids + [1]
    none = tokenfiles.write_token_files(empty, path, str(tmp_path / "b"))
    assert tokenfiles.read_token_files(none, str(tmp_path / "b")).collect() == []


def test_token_files_keep_null_ids(docs, rows, tmp_path):
    parts = tokenfiles.write_token_files(docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/c")
    got = tokenfiles.read_token_files(parts, f"file://{tmp_path}/c").collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 3 and [r["start"] for r in got if r["doc_id"] is None][0] == 0
    with pytest.raises(ValueError, match="shared mount"):
        tokenfiles.local("s3://bucket/x")


def test_no_vocabulary_in_the_repository():
    from pathlib import Path

    top = Path(codec.__file__).parents[2]
    assert not [p for p in top.rglob("*") if re.search(r"\.(tiktoken|model)$", p.name)]
