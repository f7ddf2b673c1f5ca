"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on bootstrap samples of labelled rows; every path from a root is a
conjunction of threshold tests. A logistic model with an L1 penalty weighs the rules (and the
clipped statistics themselves), which leaves few of them; those are compiled into one Spark column
expression over the statistics columns, so scoring is an ordinary projection.

Training: of the labelled rows given, the one of least hash in each of `rows` hash slots: a
documented bound on the sample of a classifier. Statistics cover whole texts.

Defined cases: null and empty texts have the statistics of no words and are scored like any other;
documents without a label are scored and not learned from; a document with several labels counts
for the one its hash slot picks; with no labels, or one class only, the score is that class's share
(0.5 without labels); null ids are not held out and not trained on; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import binaries, fold, lean, pick

STATISTICS = ("log_chars", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "shouts", "bars", "line_length", "repeated_lines", "distinct_words", "top_word", "distinct_pairs", "stop_marks", "short_words")
ROWS = 8000


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a text, all of them shares or averages over the whole text."""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, int(n.sum()))
    words = text.split()
    count = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, int(n[65:91].sum() + n[97:123].sum()))
    return [
        float(np.log1p(size)),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 12).sum()) / count,
        int(n[65:91].sum()) / letters,
        int(n[48:58].sum()) / size,
        int(n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()) / size,
        int(n[[35, 36, 37, 38, 42, 64, 94, 126]].sum()) / size,
        int(n[33] + n[63]) / size,
        int(n[124] + n[9]) / size,
        float(np.log1p(size / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)),
        len(tally) / count,
        max(tally.values(), default=0) / count,
        len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
        int(n[46] + n[44]) / count,
        float((lengths <= 3).sum()) / count,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and its statistics."""
    frame = pick(docs, id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in binaries(batch.column(1))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["id", *STATISTICS])

    return frame.mapInArrow(lean(run), f"id {frame.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


Test = tuple[int, bool, float]  # statistic, whether above, threshold


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator, path: tuple[Test, ...], out: set) -> None:
    """Adds the paths of one tree: the split of least squared error over a random third or more of the statistics."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = None
    for k in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
        order = np.argsort(x[:, k], kind="stable")
        v, s = x[order, k], np.cumsum(y[order])
        i = np.arange(least, len(y) - least + 1)
        i = i[v[i - 1] < v[np.minimum(i, len(v) - 1)]]
        if not len(i):
            continue
        left, right = s[i - 1], s[-1] - s[i - 1]
        gain = left**2 / i + right**2 / (len(y) - i)
        j = int(gain.argmax())
        if best is None or gain[j] > best[0]:
            best = (gain[j], int(k), float((v[i[j] - 1] + v[i[j]]) / 2))
    if best is None:
        return
    _, k, cut = best
    above = x[:, k] > cut
    for side in (False, True):
        now = (*path, (k, side, round(cut, 6)))
        out.add(now)
        rows = above == side
        _grow(x[rows], y[rows], depth - 1, least, rng, now, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal steps; columns of z are standardised by the caller."""
    n, m = z.shape
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        done = np.abs(new - w).max(initial=0) < 1e-6
        w, b, t = new, nb, s
        if done:
            break
    return w, float(b)


@dataclass
class RuleModel:
    base: float
    rules: list[tuple[float, tuple[Test, ...]]]  # weight, conjunction
    linear: list[tuple[float, int, float, float]]  # weight, statistic, low, high

    def score(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.base)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for k, above, cut in tests:
                holds = holds & ((F.col(STATISTICS[k]) > cut) if above else (F.col(STATISTICS[k]) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, k, low, high in self.linear:
            total = total + F.lit(weight) * F.greatest(F.lit(low), F.least(F.lit(high), F.col(STATISTICS[k])))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), [], [])
    rng = np.random.default_rng(seed)
    found: set[tuple[Test, ...]] = set()
    least = max(2, len(y) // 200)
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 2000))
        _grow(x[rows], y[rows], depth, least, rng, (), found)
    rules = sorted(found)
    columns, kept, seen = [], [], set()
    for rule in rules:
        holds = np.ones(len(y), bool)
        for k, above, cut in rule:
            holds &= (x[:, k] > cut) == above
        mark = holds.tobytes()
        if mark in seen or not 0 < holds.sum() < len(y):
            continue
        seen.add(mark)
        columns.append(holds.astype(float))
        kept.append(rule)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    z = np.column_stack([*columns, clipped])
    mean, sd = z.mean(axis=0), z.std(axis=0)
    sd[sd < 1e-9] = np.inf
    w, b = _lasso((z - mean) / sd, y, penalty)
    w = w / sd
    b -= float((w * mean).sum())
    n = len(kept)
    return RuleModel(b, [(float(a), r) for a, r in zip(w[:n], kept, strict=True) if a], [(float(a), k, float(low[k]), float(high[k])) for k, a in enumerate(w[n:]) if a])


def fit_quality_model(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS) -> RuleModel:
    """Model of the labelled rows; `where`, over columns id and label, says which may be learned from."""
    known = pick(labels, id=id_col, label=label_col).where("id is not null and label is not null")
    if where is not None:
        known = known.where(where)
    h = F.xxhash64("id")
    chosen = known.groupBy(F.pmod(h, F.lit(rows)).alias("slot")).agg(F.min(F.struct(h, F.col("id"), F.col("label"))).alias("m"))
    chosen = chosen.select(F.col("m.id").alias("id_"), F.col("m.label").alias("label"))  # at most `rows` rows
    own = pick(docs, id=id_col, text=text_col)
    texts = own.join(F.broadcast(chosen), F.col("id") == F.col("id_")).select("id", "text")
    # Rows of one id may repeat: one of them, of least text hash, is learned from.
    found = with_statistics(texts, "id", "text").groupBy("id").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    got = found.join(F.broadcast(chosen), F.col("id") == F.col("id_")).select("id", "label", "s.*").orderBy("id").toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the statistics, score."""
    return with_statistics(docs, id_col, text_col).withColumn("score", model.score()).withColumnRenamed("id", id_col)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = read("documents")
    model = fit_quality_model(docs, read("labels"), fold(F.col("id"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
