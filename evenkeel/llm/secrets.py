"""Secret scan: fixed base patterns plus formats learned by grammar inference.

The values the base patterns find are the labelled credentials. A prefix tree of each label's
strings is folded into a probabilistic automaton by merging states whose end and transition
frequencies, and those of all states after them, are statistically compatible (Hoeffding bound).
States of one depth are merged first, most compatible ones together, so that counts are pooled by
position before states of different depths are compared: lengths, prefixes and the place of a
separator survive, and what has no fixed length folds into loops. The same is done for ordinary
tokens. Every candidate - the value of each base span, and every other token of SHORTEST characters (the
shortest credential) or more - is then scored: bits a character that the ordinary automaton takes more than
the format's. Base spans stay whatever their score; other tokens are reported where a format explains
them at least `margin` bits a character better, and no worse than it explains labelled credentials
that were left out when it was inferred.

Defined cases: null and empty texts have no spans; very long texts are searched whole, their spans are
what is held; repeated rows are scanned each for itself; null ids are kept; patterns of different kinds
may overlap, and ties of start are ordered by kind; an empty table gives an empty result (and an empty
model); positions are code points; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, pick, strings

#: Base patterns (fixed values), in the order in which their kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEARNED = "learned"
#: Characters of the shortest credential that a base pattern finds; no token that may be one is shorter.
SHORTEST = 6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")

#: Distinct strings a label may give to its automaton; a documented bound on the training sample.
SAMPLE = 2000
#: One in so many labelled credentials is left out of its automaton and says how well others of its format fit.
FOLDS = 5


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind's rank, kind, end, start of the value) by start, then kind. Runs of the last two
    patterns are maximal, so asking for their least length in the pattern drops the same matches as
    dropping short matches afterwards; assignments are filtered after matching."""
    low, found = text.lower(), []
    if any(k in low for k in KEYWORDS):  # most texts have none, and finding that out is far cheaper than the pattern
        found = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST]
    found += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def other_candidates(text: str, base: list) -> Iterator[tuple[int, int]]:
    """Tokens of SHORTEST characters or more that no base span overlaps."""
    spans = sorted((s, e) for s, _, _, e, _ in base)
    at, reach = 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= s:
            yield s, e


# --- grammar inference -------------------------------------------------------------------------


@dataclass
class Automaton:
    """moves[state][symbol] = (next state, bits); others[state] = (next state, bits before the symbol's own) for symbols it has not seen."""

    moves: list[dict[str, tuple[int, float]]]
    others: list[tuple[int, float]]
    ends: list[float]
    symbols: dict[str, float]  # bits of a symbol anywhere
    unknown: float

    def bits(self, s: str) -> float:
        """Bits a character, the end counted as one."""
        state, total = 0, 0.0
        for c in s:
            move = self.moves[state].get(c)
            if move is None:
                state, b = self.others[state]
                total += min(self.unknown, b + self.symbols.get(c, self.unknown))
            else:
                state, b = move
                total += b
        return (total + self.ends[state]) / (len(s) + 1)


class _Merging:
    """Counts of a prefix tree whose states are merged step by step (union-find, kept deterministic)."""

    def __init__(self, samples: list[str], alpha: float):
        self.into, self.seen, self.ends, self.kids, self.moved = [0], [0], [0], [{}], [{}]
        for s in sorted(samples):
            at = 0
            for c in s:
                self.seen[at] += 1
                nxt = self.kids[at].get(c)
                if nxt is None:
                    nxt = self.kids[at][c] = len(self.seen)
                    self.into.append(nxt)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.kids.append({})
                    self.moved.append({})
                self.moved[at][c] = self.moved[at].get(c, 0) + 1
                at = nxt
            self.seen[at] += 1
            self.ends[at] += 1
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))

    def find(self, a: int) -> int:
        while self.into[a] != a:
            self.into[a] = self.into[self.into[a]]
            a = self.into[a]
        return a

    def successors(self, a: int) -> list[int]:
        return list(dict.fromkeys(self.find(self.kids[a][c]) for c in sorted(self.kids[a])))

    def distance(self, a: int, b: int) -> float | None:
        """Largest difference of frequencies over what the bound allows, over all pairs of states that follow; None if it is over 1."""
        worst, todo, done = 0.0, [(a, b)], set()
        while todo:
            a, b = sorted(map(self.find, todo.pop()))
            if a == b or (a, b) in done:
                continue
            done.add((a, b))
            na, nb = self.seen[a], self.seen[b]
            bound = self.spread * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if bound >= 1:
                continue  # no frequencies could differ by more
            far = abs(self.ends[a] / na - self.ends[b] / nb)
            ma, mb = self.moved[a], self.moved[b]
            for c in ma.keys() | mb.keys():
                far = max(far, abs(ma.get(c, 0) / na - mb.get(c, 0) / nb))
            if far > bound:
                return None
            worst = max(worst, far / bound)
            todo += [(self.kids[a][c], self.kids[b][c]) for c in ma.keys() & mb.keys()]
        return worst

    def merge(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self.find, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, y in self.kids[b].items():
                self.moved[a][c] = self.moved[a].get(c, 0) + self.moved[b][c]
                x = self.kids[a].setdefault(c, y)
                if x != y:
                    todo.append((x, y))

    def join_nearest(self, state: int, kept: list[int]) -> bool:
        near = [(d, k) for k in kept if (d := self.distance(k, state)) is not None]
        if near:
            self.merge(min(near)[1], state)
        return bool(near)


def infer(samples: list[str], alpha: float = 0.05, weight: float = 2.0) -> Automaton:
    """The automaton of samples; `weight`: how many strings a state's unseen symbols and ends count for."""
    m = _Merging(samples, alpha)
    level = [0]
    while level:  # states of one depth
        following = dict.fromkeys(m.find(k) for s in level for k in m.successors(m.find(s)))
        kept: list[int] = []
        for state in sorted(following, key=lambda x: (-m.seen[x], x)):
            state = m.find(state)
            if state not in kept and not m.join_nearest(state, kept):
                kept.append(state)
        level = list(dict.fromkeys(map(m.find, kept)))
    kept, todo = [0], m.successors(0)
    while todo:  # states of different depths, from the root on
        state = m.find(todo.pop(0))
        kept = list(dict.fromkeys(map(m.find, kept)))
        if state in kept:
            continue
        if not m.join_nearest(state, kept):
            kept.append(state)
        todo += [x for x in m.successors(m.find(state)) if x not in kept]
    order = list(dict.fromkeys([m.find(0), *map(m.find, kept)]))
    number = {s: i for i, s in enumerate(order)}
    tally: dict[str, int] = {}
    for s in order:
        for c, n in m.moved[s].items():
            tally[c] = tally.get(c, 0) + n
    letters = sum(tally.values())
    alphabet = 256  # what a token may be made of, generously
    share = {c: (n + 0.5) / (letters + 0.5 * alphabet) for c, n in tally.items()}
    rare = 0.5 / (letters + 0.5 * alphabet)
    stop = (len(samples) + 0.5) / (letters + len(samples) + 1)
    out = Automaton([], [], [], {c: -math.log2(p) for c, p in share.items()}, 4 - math.log2(rare))
    for s in order:
        total = m.seen[s] + weight
        out.moves.append({c: (number[m.find(k)], -math.log2((m.moved[s][c] + weight * share[c]) / total)) for c, k in m.kids[s].items()})
        usual = max(m.moved[s], key=lambda c: (m.moved[s][c], c), default=None)
        out.others.append((number[s] if usual is None else number[m.find(m.kids[s][usual])], -math.log2(weight / total)))
        out.ends.append(-math.log2((m.ends[s] + weight * stop) / total))
    return out


@dataclass
class SecretModel:
    formats: dict[str, Automaton] = field(default_factory=dict)
    ordinary: Automaton | None = None
    limits: dict[str, float] = field(default_factory=dict)  # most bits a character that a credential of the format takes
    margin: float = 1.0

    def score(self, token: str, kind: str | None = None) -> tuple[float | None, bool]:
        """(bits a character by which the best format - or that of `kind` - explains the token better than ordinary ones, whether it is a secret)."""
        if self.ordinary is None:
            return None, False
        plain, best, secret = self.ordinary.bits(token), None, False
        if token in (token.upper(), token.capitalize()):  # a word is as ordinary in capitals
            plain = min(plain, self.ordinary.bits(token.lower()))
        for k, a in self.formats.items():
            if kind in (None, k):
                b = a.bits(token)
                best = plain - b if best is None else max(best, plain - b)
                secret = secret or (b <= self.limits[k] and plain - b >= self.margin)
        return best, secret

    def is_secret(self, token: str) -> bool:
        return self.score(token)[1]


def labelled_sample(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(label, token): for each label, of each of `sample` hash slots the token of the least hash, over all documents."""

    def per_task(batches):
        best: dict[tuple[str, int], tuple[int, str]] = {}
        for batch in batches:
            for text in strings(batch.column(0)):
                base = base_spans(text)
                found = [(kind, text[v:e]) for _, _, kind, e, v in base]
                found += [("", text[s:e]) for s, e in other_candidates(text, base)]
                for label, token in found:
                    h = zlib.crc32(token.encode())
                    key = (label, h % sample)
                    if key not in best or (h, token) < best[key]:
                        best[key] = (h, token)
        if best:
            yield pa.RecordBatch.from_pydict({"label": [k[0] for k in best], "slot": pa.array([k[1] for k in best], pa.int32()), "h": [v[0] for v in best.values()], "token": [v[1] for v in best.values()]})

    rows = pick(docs, text=text_col).mapInArrow(lean(per_task), "label string, slot int, h long, token string")
    return rows.groupBy("label", "slot").agg(F.min(F.struct("h", "token")).alias("m")).select("label", F.col("m.token").alias("token"))


def learn(strings: dict[str, list[str]], margin: float = 1.0, quantile: float = 0.99) -> SecretModel:
    """A model of labelled credentials by kind, and of ordinary tokens (label "")."""
    model = SecretModel(margin=margin)
    if strings.get(""):
        model.ordinary = infer(strings[""])
    for kind in KINDS:
        own = sorted(strings.get(kind, ()), key=lambda s: (zlib.crc32(s.encode()[::-1]), s))
        if own:
            apart, rest = own[::FOLDS], [s for i, s in enumerate(own) if i % FOLDS] or own
            a = model.formats[kind] = infer(rest)
            bits = sorted(map(a.bits, apart))
            model.limits[kind] = bits[min(len(bits) - 1, int(quantile * len(bits)))]
    return model


def fit_secret_model(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, margin: float = 1.0, quantile: float = 0.99) -> SecretModel:
    """Automata from at most `sample` distinct credentials a label and as many ordinary tokens."""
    by: dict[str, list[str]] = {}
    for r in labelled_sample(docs, text_col, sample).collect():  # (labels + 1) * sample rows at most
        by.setdefault(r["label"], []).append(r["token"])
    return learn(by, margin, quantile)


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, spans (array of kind, start, end, score; base and learned ones by start, then kind)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    frame = pick(docs, id=id_col, text=text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scan(batches):
        m = shared.value
        known: dict[tuple[str, str | None], tuple[float | None, bool]] = {}

        def score(token: str, kind: str | None) -> tuple[float | None, bool]:
            got = known.get((token, kind))
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = m.score(token, kind)
                if len(token) < 200:
                    known[token, kind] = got
            return got

        for batch in batches:
            out = []
            for text in strings(batch.column(1)):
                base = base_spans(text)
                found = [(s, rank, k, e, score(text[v:e], k)[0]) for s, rank, k, e, v in base]
                for s, e in other_candidates(text, base):
                    bits, yes = score(text[s:e], None)
                    if yes:
                        found.append((s, len(KINDS), LEARNED, e, bits))
                out.append([{"kind": k, "start": s, "end": e, "score": bits} for s, _, k, e, bits in sorted(found, key=lambda x: x[:4])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(lean(scan), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs, fit_secret_model(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != LEARNED)
    return found.select("doc_id", *map(of, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The base columns, straight from the contract's wording; for tests."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())
