"""Token counts by compiled machines: pre-token machine (pretoken.py), count transducer (bpe.py).

The machines run over blocks. A block's map from entry states to exit states is composed with those
before it by a parallel prefix scan, which settles where pre-tokens start; at each start the count
transducer is in its first state, so what a block emits does not depend on the blocks before, and
emitted counts compose by adding: a prefix sum over pre-tokens gives every text's count at once.

Defined cases: null and empty texts have no tokens; a special string inside a text is one token
and parts the text; repeated rows are counted each for itself, and rows of one id too; very long
texts run in slices of SWEEP characters, cut where a pre-token starts whatever came before (one unbroken
pre-token is held whole, and counted in one run of the transducer); null ids are kept; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import CountTransducer, read_merges
from .common import by_size, lean, pick, strings
from .pretoken import pretokens, slices

#: Characters that one sweep of the machines takes.
SWEEP = 1 << 18


class Counter:
    """Counts the tokens of texts with one byte-level tokenizer file."""

    def __init__(self, path: str, remember: int = 400_000):
        tokens, ranks, special = read_merges(path)
        self.transducer = CountTransducer(tokens, ranks)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.remember = remember

    def __call__(self, texts: list[str]) -> np.ndarray:
        pieces, owner, out = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special else [t]
            out[i] = len(parts) - 1
            parts = [x for part in parts for x in slices(part, SWEEP)]
            pieces += parts
            owner += [i] * len(parts)
        for a, b in by_size(pieces, SWEEP):
            words, upto = pretokens(pieces[a:b])
            known = self.known
            counts = list(map(known.get, words))
            if None in counts:
                if len(known) > self.remember:
                    known.clear()
                for w in {w for w, c in zip(words, counts, strict=True) if c is None}:
                    known[w] = self.transducer.count(w.encode())
                counts = [known[w] if c is None else c for w, c in zip(words, counts, strict=True)]
            total = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
            np.add.at(out, owner[a:b], total[upto[1:]] - total[upto[:-1]])
        return out


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens. tokenizer: a byte-level tokenizer file that every executor has."""
    frame = pick(docs, id=id_col, text=text_col)

    def count(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(tokenizer)
            texts = strings(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size.cast(pa.int64()), pa.array(counter(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(lean(count), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op4_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > limit)
