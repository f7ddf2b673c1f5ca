import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import components, exact, simhash, suffixes

from .conftest import by_id


def raw(text):
    return (text or "").encode()


# --- suffix dedup -------------------------------------------------------------------------------


def expected_spans(rows):
    texts = [raw(t) for _, t in rows]
    out = []
    for (i, _), t, spans in zip(rows, texts, suffixes.brute_spans(texts), strict=True):
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        out.append((i, len(t), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_spans(frame):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"]) for r in frame.collect()), key=str)


def test_suffix_dedup(spark, rows, docs, clashing, empty):
    want = expected_spans(rows)
    assert sum(len(s) for _, _, s, _ in want) > 5
    assert found_spans(suffixes.repeated_spans(docs)) == want
    assert found_spans(suffixes.repeated_spans(clashing)) == want
    assert suffixes.repeated_spans(empty).collect() == []


def test_suffix_dedup_across_buckets_and_pieces(spark, rows, docs, monkeypatch):
    """Tiny buckets and pieces: leads go on over many buckets, long texts over many pieces."""
    monkeypatch.setattr(suffixes, "BUCKET", 3000)
    monkeypatch.setattr(suffixes, "PIECE", 500)
    assert found_spans(suffixes.repeated_spans(docs)) == expected_spans(rows)


def test_multikey_order():
    import numpy as np

    words = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffixes.multikey_order(words)
    assert [tuple(x) for x in words[order].tolist()] == sorted(map(tuple, words.tolist()))


# --- exact dedup ----------------------------------------------------------------------------------


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((len(t or ""), i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        n, keep = min(groups[norm], key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out.append((i, keep, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "keep_id", "group_size", "text_sha256")


def test_exact(spark, rows, docs, clashing, empty):
    want = expected_groups(rows)
    got = exact.exact_groups(docs)
    assert by_id(got, *COLUMNS) == want
    assert by_id(exact.exact_groups(clashing), *COLUMNS) == want
    assert exact.exact_groups(empty).collect() == []
    kept = [r for r in got.collect() if r["kept"]]
    assert len(kept) == len({w[3] for w in want})  # one row of each text
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact.drop_exact(docs).count() == len(kept)


@pytest.mark.parametrize("digest", [lambda c: F.length(c).cast("long"), lambda c: F.lit(7).cast("long")])
def test_exact_with_clashing_digests(docs, rows, digest):
    """A digest that many chunks share changes nothing: identifiers are verified."""
    assert by_id(exact.exact_groups(docs, digest=digest), *COLUMNS) == expected_groups(rows)


def test_exact_sql(spark, docs, rows):
    from evenkeel.llm.queries import oracle_sql

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows if r[0] is not None])
    want = sorted((r[0], r[1], r[2], r[4]) for r in con.sql(oracle_sql()["op3_exact_dedup"]).fetchall())
    got = by_id(exact.exact_groups(docs.where("doc_id is not null")), *COLUMNS)
    assert sorted(got) == want


def test_plan_is_native(docs):
    plan = exact.exact_groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- near dedup -------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_fingerprints_and_groups(rows, docs, clashing, empty):
    want = sorted(((i, brute_print(t)) for i, t in rows), key=str)
    for frame in (docs, clashing):
        got = simhash.near_groups(frame).collect()
        assert sorted(((r["doc_id"], r["fp"] % (1 << 64)) for r in got), key=str) == want
    known = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    brute = simhash.brute_components(sorted({(i, f) for i, f in want if i is not None}))
    assert known == brute
    assert simhash.near_groups(empty).collect() == []
    assert sum(r["stays"] for r in got) == simhash.drop_near(docs).count()


@pytest.mark.parametrize("crowd", [1, 3, 128])
def test_links_in_crowds(spark, crowd):
    """Chains of fingerprints one or two bits apart, with crowded and with sparse segments."""
    import random

    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                f ^= 1 << b
    nodes = sorted(prints)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in nodes]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), crowd)
    found = components.components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    root = {r["node"]: r["root"] for r in found.collect()}
    brute = simhash.brute_components(list(enumerate(nodes)))
    want, got = {}, {}
    for i, (f,) in enumerate(signed):
        want.setdefault(brute[i], set()).add(f)
        got.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_long_chains(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.range(50).selectExpr("1000 as a", "1001 + id as b"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and all(got[i] == 1000 for i in range(1001, 1051))
