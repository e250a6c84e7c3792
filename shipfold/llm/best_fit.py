"""Best-fit packing by the sum of squares.

Documents become token ids; only those above the length are cut, into whole
lengths and a rest. Pieces are spread over groups by a hash, so that no task
holds more than a bounded share, and every group packs its own sequences:
a piece goes where the sum over residual gaps of (open sequences with that gap)
squared becomes smallest, a new sequence being one of the choices; of equal
choices the tightest. Pieces come longest first. Each group leaves at most a few
sequences part full, so groups of ``group_rows`` pieces cost next to nothing.

Ids of a text are the library's ids of its parts between ASCII white space: its
normaliser and its word pattern act within such parts, and so do the special
strings, which have no space in them. A part of Latin letters with marks after it is
two pre-tokens, which the library's merges take directly; other parts go
through the whole library. Both are remembered per worker up to a fixed number.

Defined cases: a null text counts as empty and becomes the end id alone;
repeated rows are packed each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, text_slices, tokenizer_path, worker_cache, write_scratch

MODEL = "word_bpe_49k.json"
LENGTH = 2048
END = 0
#: Pieces that one task packs.
GROUP_ROWS = 50_000
#: Words that a worker remembers, of at most so many bytes each. Past the number
#: it keeps the first KEPT, which hold the common ones, and learns the rest anew.
REMEMBERED = 500_000
KEPT = 250_000
PARTS = 300_000
REMEMBERED_BYTES = 48


#: A word of Latin letters and the marks after it: two pre-tokens, the first in lower
#: case. Its letters are composed already, so the normaliser leaves them as they are.
LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|\"()*%$&#]*)")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class WordIds:
    """Words (UTF-8, no ASCII white space) to token ids, remembered in one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.index: dict[bytes, int] = {}
        self.parts: dict[str, bytes] = {}
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.n = 0

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian 32-bit integers."""
        out: list = [None] * len(words)
        hard = []
        if len(self.parts) > PARTS:
            self.parts = dict(itertools.islice(self.parts.items(), PARTS // 2))
        for i, w in enumerate(words):
            m = LETTERS.fullmatch(w.decode()) if len(w) <= REMEMBERED_BYTES else None
            if m:
                out[i] = self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
            else:
                hard.append(i)
        whole = self.tokenizer.encode_batch_fast([words[i].decode() for i in hard], add_special_tokens=False)
        for i, e in zip(hard, whole, strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def part(self, text: str) -> bytes:
        """Ids of one pre-token, by the library's merges."""
        got = self.parts.get(text)
        if got is None:
            mapped = text.encode().decode("latin-1").translate(BYTE_CHARS)
            got = self.parts[text] = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        return got

    def learn(self, words: list[bytes]) -> None:
        ids = self.encode(words)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        end = self.starts[self.n]
        need = end + lens.sum()
        while self.n + len(ids) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[end:need] = np.frombuffer(b"".join(ids), np.uint32)
        self.starts[self.n + 1:self.n + 1 + len(ids)] = end + np.cumsum(lens)
        self.index.update(zip(words, range(self.n, self.n + len(ids)), strict=True))
        self.n += len(ids)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each text, without an end id."""
        split = [t.split() for t in texts]
        words = [w for ws in split for w in ws]
        if self.n > REMEMBERED:
            self.index = {w: i for w, i in self.index.items() if i < KEPT}
            self.n = KEPT
        find = self.index.get
        at = np.fromiter(map(find, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        long: list[bytes] = []
        if missing:
            unknown = [words[i] for i in missing]
            new = dict.fromkeys(unknown)
            long = [w for w in new if len(w) > REMEMBERED_BYTES]
            self.learn([w for w in new if len(w) <= REMEMBERED_BYTES])
            mark = self.n
            if long:  # kept for this call only
                self.learn(long)
            at[missing] = list(map(find, unknown))
        lens = self.starts[at + 1] - self.starts[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(lens)
        flat = self.flat[np.arange(int(lens.sum())) + np.repeat(self.starts[at] - (ends - lens), lens)]
        if long:
            for w in long:
                del self.index[w]
            self.n = mark
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ws) for ws in split])])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 model_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each row's ids and the end id, cut at ``length``."""
    path = model_path or tokenizer_path(MODEL)
    d = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("__text"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache()
        if ("ids", path) not in cache:
            cache["ids", path] = WordIds(path)
        words = cache["ids", path]
        for batch in batches:
            rows, piece, start, size, crc = [], [], [], [], []
            for first, texts in text_slices(batch, 1):
                for k, ids in enumerate(words.ids([(t or "").encode() for t in texts])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for j, at in enumerate(range(0, len(ids), length)):
                        part = ids[at:at + length]
                        rows.append(first + k)
                        piece.append(j)
                        start.append(at)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(d, run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the given order."""
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    gain = np.zeros(size + 1, np.int64)  # what one more sequence with this gap adds; none for a full one
    gain[1:] = 1
    never = np.iinfo(np.int64).max
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:size]
        cost = np.where(here > 0, gain[:size - s] - 2 * here + 1, never)
        g = int(np.argmin(cost)) + s if len(cost) else size
        if g == size or cost[g - s] >= gain[size - s]:  # a new sequence adds least
            g, b = size, made
            made += 1
        else:
            b = open_at[g].pop()
            count[g] -= 1
            gain[g] -= 2
        seq[i], off[i] = b, size - g
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
            gain[g - s] += 2
    return seq, off


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
             group_rows: int = GROUP_ROWS, model_path: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = write_scratch(token_pieces(docs, id_col, text_col, length, model_path)
                           .withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, math.ceil(pieces.count() / group_rows))
    kind = pieces.schema["id"].dataType.simpleString()
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece", "rid"), F.lit(groups)))

    def pack(pdf):
        pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], kind="stable")
        seq, off = sum_of_squares(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(pdf["grp"].to_numpy() << 32) + seq, offset=off).drop(columns=["grp", "rid"])

    return (pieces.groupBy("grp").applyInPandas(pack, (
        f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))
        .withColumnRenamed("id", id_col))
