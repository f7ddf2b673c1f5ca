"""The registered queries themselves: against SQL where there is one, else against brute-force versions, over one awkward folder."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from evenkeel.llm import bpe, secrets, simhash, suffixes

from .test_dedup import brute_print, expected_spans


def run(spark, folder, name):
    found = next(f for n, f in entry.queries().items() if n.split("_")[0] == name or n == name)
    return {r["doc_id"]: r for r in found(spark, folder).collect()}


@pytest.fixture(scope="module")
def texts(rows):
    """One row an id: the others are only in the operators' own tests, as results are looked up by id here."""
    return {i: t for i, t in rows if i is not None}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('whole')}"
    langs = ["en", "de", None]
    docs = [(i, t, langs[i % 3], "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    some = next(t for t in texts.values() if t and len(t.split()) > 60)
    spark.createDataFrame([("a", " ".join(some.split()[5:40])), ("b", None), (None, "sun")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_operator_has_its_query():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op3", "op7"])
@pytest.mark.parametrize("where", ["folder", "small"])
def test_sql(spark, name, where, request):
    path = request.getfixturevalue(where)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.register(t, spark.read.parquet(f"{path}/{t}.parquet").toArrow())
    sql = con.sql(next(s for n, s in entry.oracle_sql().items() if n.startswith(f"{name}_")))
    want = {r[sql.columns.index("doc_id")]: dict(zip(sql.columns, r, strict=True)) for r in sql.fetchall()}
    got = run(spark, path, name)
    assert {i: r.asDict() for i, r in got.items()} == want


def test_op1(spark, folder, texts):
    want = {i: (n, sum(e - s for s, e in spans), len(spans), sha) for i, n, spans, sha in expected_spans(list(texts.items()))}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in run(spark, folder, "op1").items()} == want


def test_op2(spark, folder, texts):
    got = run(spark, folder, "op2")
    assert {i: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for i, r in got.items()} == {i: secrets.brute_base(t) for i, t in texts.items()}
    for i, r in got.items():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in secrets.KINDS)
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"] and all(int(s) < int(e) <= len(texts[i]) for _, s, e in spans)


def test_op4(spark, folder, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in run(spark, folder, "op4").items()} == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in texts.items()}
    assert any(x > 1024 for x in n.values())


def test_op5(spark, folder, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    groups = simhash.brute_components(sorted(prints.items()))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in run(spark, folder, "op5").items()} == {i: (f"{f:016x}", groups[i]) for i, f in prints.items()}


def test_op6(spark, folder, texts):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = lib.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in run(spark, folder, "op6").items()} == want


def test_op8(spark, folder, texts):
    from tokenizers import Tokenizer

    lib, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, {}
    for i in sorted(texts):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {i: (r["start"], r["n_tokens"], r["ids_crc32"]) for i, r in run(spark, folder, "op8").items()} == want


def held(i, parts, left):
    return zlib.crc32(str(i).encode()) % parts == left


def test_op9_and_op10_forms(spark, folder, texts):
    got = run(spark, folder, "op9")
    assert all(r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for i, r in got.items())
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {i for i, t in texts.items() if not re.search(r"[^\W\d_]", t or "")}
    got = run(spark, folder, "op10")
    assert got.keys() == texts.keys() and all(r["held_out"] == held(i, 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def test_op9_and_op10_on_held_out_rows(spark):
    """Accuracy on rows that nothing was learned from."""
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect() if r["lang"] is not None}
    got = [(truth[i], r["lang_pred"]) for i, r in run(spark, path, "op9").items() if r["held_out"] and i in truth]
    assert len(got) > 100 and sum(a == b for a, b in got) >= 0.98 * len(got)
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [(truth[i], r["predicted"]) for i, r in run(spark, path, "op10").items() if r["held_out"] and truth.get(i) is not None]
    assert len(got) > 50 and sum(a == b for a, b in got) >= 0.95 * len(got)


def test_brute_spans_are_maximal():
    assert suffixes.brute_spans([b"ab" * 200]) == [[(0, 400)]]
