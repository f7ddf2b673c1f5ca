import random
import re

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, language, quality, secrets

from .conftest import by_id


# --- secrets ----------------------------------------------------------------------------------------


def test_base_spans(rows):
    rng = random.Random(9)
    bits = ["token", "PassWord", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef" * 2, "ABCDEFGHIJKLMNOPQRST", "x", "é", "K", "ſecret", "secret", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for _, t in rows]
    for t in texts:
        base = secrets.base_spans(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in base)
        import hashlib

        kinds = [k for _, _, k, _, _ in base]
        assert (*(kinds.count(k) for k in secrets.KINDS), hashlib.sha256(joined.encode()).hexdigest()) == secrets.brute_base(t)


def test_scan(rows, docs, clashing, empty):
    model = secrets.fit_secret_model(docs)
    want = sorted(((i, secrets.brute_base(t)) for i, t in rows), key=str)
    for frame in (docs, clashing):
        got = []
        for r in secrets.scan_secrets(frame, model).collect():
            base = [s for s in r["spans"] if s["kind"] != secrets.LEARNED]
            got.append((r["doc_id"], tuple(sum(s["kind"] == k for s in base) for k in secrets.KINDS)))
            assert [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])
        assert sorted(got, key=str) == sorted(((i, b[:3]) for i, b in want), key=str)
    assert secrets.scan_secrets(empty, secrets.fit_secret_model(empty)).collect() == []


def test_short_credentials_are_learned(spark):
    """Of 6 to 15 characters, and outside an assignment, among many ordinary words."""
    rng = random.Random(3)
    parts = "con sid er able ac know ledge ment tion ing pre sent re main der form al ity".split()
    prose = lambda n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(n))
    credential = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    rows = [(i, f"{prose(20)} password={credential(10 + i % 4)} {prose(20)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(10)} Bearer {credential(12)} {prose(10)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, found = dict(rows), []
    for r in secrets.scan_secrets(docs, secrets.fit_secret_model(docs)).collect():
        found += [(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"] if s["kind"] == secrets.LEARNED]
    wanted = {(i, t.split("Bearer ")[1].split()[0]) for i, t in rows if i >= 1000}
    others = {t for _, t in set(found) - wanted}
    assert len(wanted & set(found)) >= 15 and not others


def test_grammar_tells_formats_apart():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    words = ["".join(rng.choice(["ing", "tion", "the", "an", "or"]) for _ in range(6)) for _ in range(300)]
    a, b = secrets.infer(hexes[:200]), secrets.infer(words[:200])
    assert all(a.bits(x) < b.bits(x) for x in hexes[200:]) and all(b.bits(x) < a.bits(x) for x in words[200:])
    assert len(a.moves) == 41 and 2 < len(b.moves) < 200  # a fixed length is kept, and states of one depth are merged
    loops = secrets.infer(["ab" * (1 + int(rng.expovariate(0.1))) for _ in range(2000)])  # any length goes on or ends alike
    assert len(loops.moves) < 12 and loops.bits("ab" * 12) < 1 < loops.bits("ba" * 12)
    model = secrets.learn({"hex": hexes, "": words})
    assert model.is_secret("0a1b2c3d4e5f607182930a1b2c3d4e5f60718293") and not model.is_secret("theingtionanortheing") and not model.is_secret("THEINGTIONANORTHEING")
    assert model.score(hexes[0], "hex")[0] > 1 > model.score(words[0], "hex")[0]
    assert secrets.learn({}).score("abcdefgh") == (None, False)


def test_credentials_left_out_are_found():
    """Of three formats at once, held-out credentials are found and held-out ordinary tokens are not."""
    rng = random.Random(2)
    any_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    credential = lambda: rng.choice([lambda: "sk-" + of(any_, 20), lambda: of(any_ + "+/", 32), lambda: "ghp_" + of(any_, 16)])()
    syllables = "con sid er able ac know ledge ment tion ing pre sent re main der form al ity".split()
    word = lambda: rng.choice([str, str, str.capitalize, str.upper])("".join(rng.choices(syllables, k=rng.randint(2, 5))))
    model = secrets.learn({"assign": [credential() for _ in range(400)], "": [w for _ in range(2000) if len(w := word()) >= 6]})
    assert len(model.formats["assign"].moves) > 20
    assert sum(model.is_secret(credential()) for _ in range(500)) >= 450
    assert sum(model.is_secret(word()) for _ in range(2000)) <= 5


# --- decontamination -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def contaminated(spark, rows, tmp_path_factory):
    rng = random.Random(4)
    passages = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n)) for n in (30, 13, 14, 5, 1, 20)]
    items = [(1, passages[0]), (2, passages[1]), (10, passages[2]), (3, passages[3]), (4, "zulu"), (5, None), (6, ""), (7, "..."), (8, passages[0])]
    extra = [(200, "x " + passages[0].upper() + " y"), (201, passages[1] + "." + passages[2]), (202, "a-" + passages[3].replace(" ", ", ") + "!"), (203, "zulu " * 3 + "q " * 100), (204, " ".join(passages[0].split()[:12])), (205, passages[5]), (206, None)]
    path = f"file://{tmp_path_factory.mktemp('bench')}/documents"
    spark.createDataFrame([*rows, *extra], "doc_id long, text string").repartition(3).write.parquet(path)
    return [*rows, *extra], items, spark.read.parquet(path), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 50])
def test_hits(contaminated, block_bytes):
    """Against direct comparison, in one pass and in several over blocks of the benchmark."""
    table, items, docs, bench = contaminated
    want = sorted(((i, *decontaminate.brute_hits(t, items)) for i, t in table), key=str)
    hits = decontaminate.judged(decontaminate.benchmark_hits(docs, bench, block_bytes=block_bytes)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in hits), key=str) == want
    for r in hits:
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
    assert sum(n > 0 for _, _, n, _ in want) >= 4
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not r["contaminated"] for r in hits)


def test_hits_of_nothing(empty, docs, spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.judged(decontaminate.benchmark_hits(docs, none)).collect())
    assert decontaminate.benchmark_hits(empty, none).collect() == []


def test_fm_index():
    import numpy as np

    text = np.random.default_rng(2).integers(1, 5, 400)
    index = decontaminate.FMIndex(text)
    for n in (1, 3, 6):
        patterns = np.array([text[i : i + n] for i in range(0, 400 - n, 7)] + [[4] * n])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(400 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    low, high = index.search(np.array([[1, 5000], [5000, 1], [7, 7]]))  # words that the text does not have
    assert (low == high).all()


# --- language ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tongues(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {"en": "the quick brown fox jumps over lazy dog and then sleeps with thought".split(), "de": "der schnelle braune fuchs springt über den faulen hund und schläft dann".split(), "es": "el rápido zorro marrón salta sobre perro perezoso y luego duerme niño".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(4, 60))), k) for i in range(240) for k in [list(words)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!!", "es"), (903, "the dog", None), (None, "über den hund", "de"), (904, "中文字符測試中文字符測試中文字符", None)]
    path = f"file://{tmp_path_factory.mktemp('lang')}/documents"
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_language(tongues, empty):
    from evenkeel.llm.common import fold

    rows, docs = tongues
    model = language.fit_language_model(docs, fold(F.col("id"), 4) != 2)
    assert model.languages == ["de", "en", "es"]
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    known = [(i, k) for i, _, k in rows if i is not None and i < 900]
    assert sum(got[i]["lang_pred"] == k for i, k in known) >= 0.98 * len(known)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and got[904]["rejected"] and not any(got[i]["rejected"] for i, _ in known)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.drop_rejected(docs, model).count() == sum(not r["rejected"] for r in language.identify(docs, model).collect())
    nothing = language.fit_language_model(empty.withColumn("lang", F.lit("en")))
    assert all(r["lang_pred"] == "und" for r in language.identify(docs, nothing).collect())
    assert language.identify(empty, model).collect() == []


def test_language_does_not_look_at_labels(tongues):
    """Lookup of held-out or other columns would change the answer; it does not."""
    _, docs = tongues
    model = language.fit_language_model(docs)
    plain = by_id(language.identify(docs, model), "doc_id", "lang_pred", "score")
    assert plain == by_id(language.identify(docs.withColumn("lang", F.lit("zz")).withColumn("score", F.lit(1)), model), "doc_id", "lang_pred", "score")


def test_probabilities_sum_to_one():
    counts = {"a": {"   x": 3, "  xy": 2, " xyx": 2, "  xx": 1, "xyxy": 1}, "b": {"   y": 1}}
    model = language.kneser_ney(counts)
    letters = sorted({c for t in counts.values() for g in t for c in g[-1]})
    for context in ("   ", "  x", "xyx", "qqq"):
        total = 0.0
        for c in [*letters, "中"]:
            codes = language.np.frombuffer((context + c).encode("utf-32-le"), language.np.uint32)
            h = language.hashes(codes)
            cost, left = language.np.zeros(2), True
            for order in range(language.ORDER, 0, -1):
                at, found = model.find(model.keys[order - 1], h[order - 1][-1:])
                if order < language.ORDER and len(model.contexts[order - 1]):
                    i, seen = model.find(model.contexts[order - 1], h[order - 1][-2:-1])
                    if seen[0]:
                        cost = cost + model.backoff[order - 1][i[0]]
                if found[0]:
                    cost, left = cost + model.bits[order - 1][at[0]], False
                    break
            if left:
                cost = cost + model.unseen
            total = total + 2.0**-cost
        assert language.np.allclose(total, 1, atol=0.02), (context, total)


# --- quality -----------------------------------------------------------------------------------------------


def test_quality(spark, tmp_path):
    rng = random.Random(8)
    good = lambda: ". ".join(" ".join(rng.choice("river stone cloud light wind rain tree".split()) + rng.choice(["", "s", "ing"]) for _ in range(9)) for _ in range(6))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "***", "NOW!!", "CLICK|"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(300)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    from evenkeel.llm.common import fold

    model = quality.fit_quality_model(docs, labels, fold(F.col("id"), 3) != 1)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 3) for i in range(300)) >= 295
    assert all(0 <= s <= 1 for s in got.values()) and 1000 in got and got[1000] == got[1001]
    assert 0 < len(model.rules) < 200  # sparse
    none = quality.fit_quality_model(docs, labels.where("false"))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), model).collect() == []


def test_rules_compile_to_columns(spark):
    model = quality.RuleModel(-1.0, [(2.0, ((0, True, 1.0), (3, False, 0.5)))], [(0.5, 1, 0.0, 4.0)])
    frame = spark.createDataFrame([tuple([2.0, 9.0, 0.0, 0.2] + [0.0] * 12), tuple([0.5, 1.0, 0.0, 0.2] + [0.0] * 12)], ", ".join(f"{s} double" for s in quality.STATISTICS))
    import math

    got = [r[0] for r in frame.select(model.score()).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-(-1 + 2 + 2))), 1 / (1 + math.exp(-(-1 + 0.5)))])
    assert not re.search("Python|Arrow", frame.select(model.score())._jdf.queryExecution().toString())
