"""Token counts by a whole-token shortcut.

The piece vocabulary (a sentencepiece BPE model) merges pairs of neighbouring
pieces whose join is in the vocabulary. No vocabulary string has a space mark
after another character, and none has a line break, so no merge crosses the place
before a run of spaces or around a line break: a text's count is the sum over
the pre-tokens between these places. ``prove`` checks both facts on the
vocabulary itself and then encodes every vocabulary string alone: those that
give one token count as one wherever they are a whole pre-token. Only the rest
are merged, by the library, and remembered per worker up to a fixed number.

Defined cases: a null text counts as empty and has no tokens; ids and other
columns pass through untouched; one row comes out for each row that goes in.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, text_slices, tokenizer_path, worker_cache

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Merged pre-tokens that a worker remembers. Past the number it keeps the first
#: KEPT, which hold the common ones, and merges the rest anew.
REMEMBERED = 400_000
KEPT = 200_000
#: Longer pre-tokens are merged each time, so the memory stays bounded in bytes.
REMEMBERED_CHARS = 48
SPACE = "▁"


def prove(model) -> frozenset[str]:
    """Pre-tokens (space mark as a space) that the vocabulary encodes as one token.

    Raises if a vocabulary string could join what the pre-tokens separate.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    crossing = [p for p in pieces if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
    if crossing:
        raise ValueError(f"pieces join across pre-tokens: {crossing[:5]}")
    texts = [p.replace(SPACE, " ") for p in pieces]
    return frozenset(t for t, n in zip(texts, merged_counts(model, texts), strict=True) if n == 1)


def merged_counts(model, pre_tokens: list[str]) -> list[int]:
    """The library's token counts of pre-tokens that stand alone.

    The library puts a space mark before each text. It takes the place of the one
    space that most pre-tokens begin with; the others follow a line break, whose
    two tokens (mark, byte) are then taken off.
    """
    plain = [len(t) > 1 and t[0] == " " and t[1] != " " for t in pre_tokens]
    got = model.encode([t[1:] if p else "\n" + t for t, p in zip(pre_tokens, plain, strict=True)], num_threads=1)
    return [len(ids) - (0 if p else 2) for ids, p in zip(got, plain, strict=True)]


PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")


class _Counts(dict):
    """Pre-token -> tokens: the proven ones and those merged so far."""

    def __init__(self, model):
        self.model, self.single = model, prove(model)
        super().__init__(dict.fromkeys(self.single, 1))
        self["\n"] = 1
        self.floor = len(self)

    def learn(self, merged: dict[str, int]) -> None:
        if len(self) - self.floor + len(merged) > REMEMBERED:
            kept = dict(itertools.islice(self.items(), self.floor + KEPT))
            self.clear()
            self.update(kept)
        self.update(merged)


def count_texts(counts: _Counts, texts: list[str | None]) -> list[int]:
    out = []
    for text in texts:
        if not text:
            out.append(0)
            continue
        pre = PRE_TOKEN.findall(" " + text.replace(SPACE, " "))
        get = counts.get
        got = list(map(get, pre))
        if None in got:
            rest = list({p for p, n in zip(pre, got, strict=True) if n is None})
            merged = dict(zip(rest, merged_counts(counts.model, rest), strict=True))
            counts.learn({p: n for p, n in merged.items() if len(p) <= REMEMBERED_CHARS})
            got = [merged[p] if n is None else n for p, n in zip(pre, got, strict=True)]
        out.append(sum(got))
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 model_path: str | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    path = model_path or tokenizer_path(MODEL)
    d = docs.select(column(docs, id_col).alias(id_col), column(docs, text_col).cast("string").alias("__text"))
    kind = d.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import sentencepiece

        cache = worker_cache()
        if ("counts", path) not in cache:
            cache["counts", path] = _Counts(sentencepiece.SentencePieceProcessor(model_file=path))
        counts = cache["counts", path]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in text_slices(batch, 1):
                n_bytes += [len(t.encode()) if t else 0 for t in texts]
                n_tokens += count_texts(counts, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()),
                                              pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    got = map_arrow(d, run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
