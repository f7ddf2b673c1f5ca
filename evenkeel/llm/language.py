"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased and every run of other characters than letters is one space. Each language has
a model of order 4: raw counts of 4-character strings, below that the number of distinct
characters seen before a string, one discount, interpolated down to a uniform distribution. All
languages share sorted arrays of string hashes, one array an order, with a row of log
probabilities per string; strings that a language has not seen get their interpolated probability
when the model is built, and strings that none has seen are scored by the context's back-off
weights and the next lower order. The language of the lowest bits a character wins.

Rejection is calibrated: one in FOLDS of the training rows is left out of the counts, and a text is
rejected where its bits a character, less SHORT / sqrt(characters) for short texts, are more than
`margin` above the most that such a row of the language takes.

Training: of the labelled rows given, for each language the row of least hash in each of `rows`
hash slots (whole texts): a documented bound on the sample of a classifier. The sample's texts stay
on the executors; the driver sees counts of 4-character strings and one number a language.

Defined cases: null texts and texts without a letter are `und`, score 0, rejected; very long texts are
scored in slices that carry the characters before them; ties go to the language that sorts first;
without any training row all texts are `und`; repeated rows get the same answer each; null ids are not
held out and not trained on; an empty table gives an empty result; other columns are ignored,
whatever their names, and `drop_rejected` keeps them all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import by_size, cut, fold, lean, pick, position, settled, strings

ORDER = 4
UNDETERMINED = "und"
#: Hash slots, and so training rows at most, of a language.
ROWS = 800
#: One in so many training rows calibrates the rejection.
FOLDS = 5
#: Bits a character that a text of one character may take beyond the usual; it falls with the square root of the length.
SHORT = 6.0
#: Characters that are scored at a time.
SWEEP = 1 << 18


@functools.cache
def folded() -> np.ndarray:
    """Each code point in lower case where that is one code point; 32 for all but letters."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def fold_text(text: str, blank: bool = False) -> np.ndarray:
    """Folded codes, runs of blanks as one; `blank`: the character before was one."""
    codes = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(codes):
        blanks = codes == 32
        keep = ~blanks
        keep[1:] |= blanks[1:] & ~blanks[:-1]
        keep[0] |= blanks[0] and not blank
        codes = codes[keep]
    return codes


PAD = np.full(ORDER - 1, 32, np.uint32)


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, folded codes after the ORDER - 1 codes before them); the first ones come after blanks that are no character of the text.

    Texts of more than SWEEP characters come in several pieces.
    """
    for i, t in enumerate(texts):
        before, blank = PAD, False
        for a in range(0, max(1, len(t)), SWEEP):
            codes = np.concatenate([before, fold_text(t[a : a + SWEEP], blank)])
            yield i, codes
            before = codes[-(ORDER - 1) :]
            blank = len(codes) > ORDER - 1 and codes[-1] == 32 or blank and len(codes) == ORDER - 1


def stream(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts in sweeps of about SWEEP characters: (codes, where each piece ends after a 0, text of each piece)."""
    parts, cuts, owner = [], [0], []
    for i, codes in pieces(texts):
        parts.append(codes)
        cuts.append(cuts[-1] + len(codes))
        owner.append(i)
        if cuts[-1] >= SWEEP:
            yield np.concatenate(parts), np.array(cuts), np.array(owner)
            parts, cuts, owner = [], [0], []
    if parts:
        yield np.concatenate(parts), np.array(cuts), np.array(owner)


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """64-bit hash of the last 1 .. ORDER characters at each place; the first places are of no use."""
    one = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one ^= one >> np.uint64(29)
    one *= np.uint64(0xBF58476D1CE4E5B9)
    out = [one]
    for _ in range(ORDER - 1):
        h = one.copy()
        h[1:] += out[-1][:-1] * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        out.append(h)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes
    bits: list[np.ndarray]  # by order: a row of bits by language for each hash
    contexts: list[np.ndarray]  # sorted hashes of contexts of 1 .. ORDER - 1 characters
    backoff: list[np.ndarray]
    unseen: np.ndarray  # bits of a character that no language has seen
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return at, keys[at] == h

    def bits_of(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each code after those before it, by language; the first ORDER - 1 are of no use."""
        by_order = hashes(codes)
        at, found = self.find(self.keys[-1], by_order[-1])
        cost = self.bits[-1][at]
        left = np.flatnonzero(~found)
        if len(left):
            cost[left] = 0
        for order in range(ORDER - 1, 0, -1):
            if not len(left):
                break
            before = np.maximum(left - 1, 0)
            at, seen = self.find(self.contexts[order - 1], by_order[order - 1][before])
            if len(self.contexts[order - 1]):
                cost[left[seen]] += self.backoff[order - 1][at[seen]]
            at, found = self.find(self.keys[order - 1], by_order[order - 1][left])
            if len(self.keys[order - 1]):
                cost[left[found]] += self.bits[order - 1][at[found]]
            left = left[~found]
        cost[left] += self.unseen
        return cost

    def cost(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a character by language, characters, whether there is a letter) of each text."""
        total = np.zeros((len(texts), len(self.languages)))
        n, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for codes, cuts, owner in stream(texts):
            starts = cuts[:-1] + ORDER - 1
            sums = np.concatenate([np.zeros((1, total.shape[1])), np.cumsum(self.bits_of(codes), axis=0, dtype=np.float64)])
            seen = np.concatenate([[0], np.cumsum(codes != 32)])
            np.add.at(total, owner, sums[cuts[1:]] - sums[starts])
            np.add.at(n, owner, cuts[1:] - starts)
            np.add.at(letters, owner, seen[cuts[1:]] - seen[starts])
        return total / np.maximum(n, 1)[:, None], n, letters > 0

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        out = []
        for a, b in by_size(texts, SWEEP):
            cost, n, letter = self.cost(texts[a:b])
            best = cost.argmin(axis=1)
            least = cost[np.arange(len(best)), best]
            odds = np.exp2(-(cost - least[:, None]) * np.minimum(n, 100)[:, None])
            score = 1 / odds.sum(axis=1)
            out_of = least - SHORT / np.sqrt(np.maximum(n, 1)) > self.limit[best]
            out += [(self.languages[k], float(s), bool(r)) if has else (UNDETERMINED, 0.0, True) for k, s, r, has in zip(best.tolist(), score, out_of, letter.tolist(), strict=True)]
        return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram of ORDER characters, n) over rows (lang, text)."""

    def count(batches):
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for codes, cuts, _ in stream(texts):
                    alphabet, symbol = np.unique(codes, return_inverse=True)
                    symbol = symbol.astype(np.uint64)  # less than 2**16 letters a sweep of text, as far as Unicode's scripts go
                    key = symbol[ORDER - 1 :].copy()
                    for k in range(1, ORDER):
                        key |= symbol[ORDER - 1 - k : len(symbol) - k] << np.uint64(16 * k)
                    scored = np.ones(len(codes), bool)
                    for c in cuts[:-1]:
                        scored[c : c + ORDER - 1] = False
                    grams, n = np.unique(key[scored[ORDER - 1 :]], return_counts=True)
                    for g, c in zip(grams.tolist(), n.tolist(), strict=True):
                        s = "".join(chr(alphabet[g >> 16 * k & 0xFFFF]) for k in reversed(range(ORDER)))
                        total[lang, s] = total.get((lang, s), 0) + c
        if total:
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "gram": [k[1] for k in total], "n": list(total.values())})

    return rows.select("lang", "text").mapInArrow(lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, dict[str, int]], discount: float = 0.75) -> LanguageModel:
    """Models of all languages from their 4-character counts."""
    languages = sorted(counts)
    seen: list[list[dict[str, int]]] = []  # by language, by order from 1
    for lang in languages:
        tables = [counts[lang]]
        for _ in range(ORDER - 1):
            lower: dict[str, int] = {}
            for g in tables[0]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            tables.insert(0, lower)
        seen.append(tables)
    alphabet = len(set().union(*(t[0] for t in seen))) + 1 if languages else 1
    union = [sorted(set().union(*(t[o] for t in seen))) if languages else [] for o in range(ORDER)]
    bits = [np.zeros((len(u), len(languages)), np.float32) for u in union]
    weights: list[list[dict[str, float]]] = []
    unseen = np.zeros(len(languages), np.float32)
    for k, tables in enumerate(seen):
        prob: dict[str, float] = {}
        own: list[dict[str, float]] = []
        rest = 1 / alphabet
        for o in range(ORDER):
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, n in tables[o].items():
                c = g[:-1]
                total[c] = total.get(c, 0) + n
                kinds[c] = kinds.get(c, 0) + 1
            weight = {c: discount * kinds[c] / total[c] for c in total}
            now, table = {}, tables[o]
            for i, g in enumerate(union[o]):
                c = g[:-1]
                low = prob[g[1:]] if o else rest
                p = weight[c] * low + max(table.get(g, 0) - discount, 0) / total[c] if c in total else low
                now[g] = p
                bits[o][i, k] = -np.log2(p)
            if o:
                own.append({c: -np.log2(w) for c, w in weight.items()})
            else:
                unseen[k] = -np.log2(weight.get("", 1.0) * rest)
            prob = now
        weights.append(own)
    contexts = [sorted(set().union(*(w[o] for w in weights))) if languages else [] for o in range(ORDER - 1)]
    backoff = [np.array([[w[o].get(c, 0.0) for w in weights] for c in contexts[o]], np.float32).reshape(len(contexts[o]), len(languages)) for o in range(ORDER - 1)]

    def ordered(grams: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not grams:
            return np.zeros(0, np.uint64), rows
        n = len(grams[0])
        h = hashes(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32))[n - 1][n - 1 :: n]
        order = np.argsort(h)
        return h[order], rows[order]

    keys, bits = zip(*map(ordered, union, bits), strict=True)
    context_keys, backoff = zip(*map(ordered, contexts, backoff), strict=True)
    return LanguageModel(languages, list(keys), list(bits), list(context_keys), list(backoff), unseen, np.full(len(languages), np.inf))


def training_rows(labelled: DataFrame, rows: int = ROWS) -> DataFrame:
    """(id, lang, text) of at most `rows` rows a language, chosen by a hash of the id over all of labelled (id, lang, text)."""
    h = F.xxhash64("id")
    chosen = labelled.select("id", "lang").groupBy("lang", F.pmod(h, F.lit(rows)).alias("slot")).agg(F.min(F.struct(h.alias("h"), F.col("id"))).alias("m"))
    chosen = chosen.select(F.col("lang").alias("lang_"), F.col("m.id").alias("id_"))
    if chosen.count() <= 100_000:  # rows * languages at most; else an ordinary join
        chosen = F.broadcast(chosen)
    return labelled.join(chosen, (F.col("id") == F.col("id_")) & (F.col("lang") == F.col("lang_"))).select("id", "lang", "text")


def fit_language_model(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, margin: float = 2.0) -> LanguageModel:
    """Model of the labelled rows of docs; `where`, over columns id, lang and text, says which may be learned from."""
    labelled = settled(pick(docs, id=id_col, lang=lang_col, text=text_col)).where("lang is not null and text is not null and id is not null")
    if where is not None:
        labelled = labelled.where(where)
    sample = cut(training_rows(labelled, rows), "sample")
    apart = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(FOLDS)) == 0
    counts: dict[str, dict[str, int]] = {}
    for r in gram_counts(sample.where(~apart)).collect():  # distinct strings of a bounded sample
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = kneser_ney(counts)
    if not model.languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = {x: i for i, x in enumerate(model.languages)}

    def excess(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            cost, n, letter = shared.value.cost(texts)
            usual = [float(c[own[k]] - SHORT / np.sqrt(m)) if has and k in own else None for k, c, m, has in zip(langs, cost, n, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(usual, pa.float64())], ["lang", "bits"])

    most = sample.where(apart).select("lang", "text").mapInArrow(lean(excess), "lang string, bits double").groupBy("lang").agg(F.max("bits").alias("bits"))
    usual = {r["lang"]: r["bits"] for r in most.collect() if r["bits"] is not None}  # a row a language
    shared.destroy()
    model.limit = np.array([usual.get(x, np.inf) + margin for x in model.languages])
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, row, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    frame = pick(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            found = shared.value.predict(strings(batch.column(1)))
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True))], ["id", "row", "lang_pred", "score", "rejected"])

    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, row long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that no language explains; all columns stay."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = position(names, text_col)

    def run(batches):
        for batch in batches:
            keep = [not r for _, _, r in shared.value.predict(strings(batch.column(at)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    ship(docs.sparkSession)
    return flat.mapInArrow(lean(run), flat.schema).toDF(*names)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs, fold(F.col("id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held, "lang_pred", "score")
