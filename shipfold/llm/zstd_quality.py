"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A
text that its class's dictionary knows compresses better with it, so
(bytes with the bad one - bytes with the good one) / bytes of the text
grows with quality; a logistic curve fitted on other labelled rows turns it into the
probability of label 1. Nothing but the text enters a score.

Every text is compressed whole, as consecutive chunks of ``CHUNK_BYTES``, each on its
own, and the sizes are summed: a dictionary helps every chunk alike, so the difference
does not fade with a text's length, and the curve holds for all lengths.

Fitting takes at most ``TRAIN_ROWS`` labelled rows of each class, those with the
smallest hash of their id, with their whole texts, which stay in Spark. Three fifths of
them make the dictionaries, from ``TRAIN_CHUNKS`` chunks a class drawn by hash from all
their chunks (the only texts that reach the driver, 16 MB at most); the others choose
the dictionaries' sizes and fit the curve.

Defined cases: a null or empty text has no difference and gets the curve's value there;
a null id is never held out; rows that repeat score each; a class without labelled
rows has no dictionary; without any labelled row every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, text_slices, write_scratch

TRAIN_ROWS = 4000
CHUNK_BYTES = 4096
#: Chunks of each class that make its dictionary.
TRAIN_CHUNKS = 2000
#: Tasks that the fitting rows are spread over.
FIT_TASKS = 16
#: Dictionary and sample sizes to choose from, by the area under the curve on the
#: training rows that the dictionaries did not see.
SETTINGS = ((112_640, 4096), (112_640, 2048), (262_144, 4096), (262_144, 2048), (524_288, 2048))
LEVEL = 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def fold(id_column: F.Column) -> F.Column:
    """crc32 of the id as text, modulo ``FOLDS``."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS))


def sizes(dictionary, texts: list[bytes]) -> np.ndarray:
    """Compressed bytes of each text, its chunks summed."""
    import zstandard

    options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    c = zstandard.ZstdCompressor(dict_data=dictionary, **options) if dictionary else zstandard.ZstdCompressor(**options)
    return np.array([sum(len(c.compress(t[k:k + CHUNK_BYTES])) for k in range(0, len(t), CHUNK_BYTES)) for t in texts], float)


def differences(good, bad, texts: list[str | None]) -> np.ndarray:
    """Normalised compressed-size difference of each text; 0 for an empty one."""
    data = [(t or "").encode() for t in texts]
    n = np.array([len(t) for t in data], float)
    return np.where(n > 0, (sizes(bad, data) - sizes(good, data)) / np.maximum(n, 1), 0.0)


def dictionary(raw: bytes | None, raw_content: bool):
    import zstandard

    if not raw:
        return None
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw_content else zstandard.DICT_TYPE_AUTO
    d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return d


def train_dictionary(texts: list[bytes], size: int, sample: int) -> tuple[bytes | None, bool]:
    """(dictionary, plain content?); too few samples to train on serve as they are."""
    import zstandard

    chunks = [t[i:i + sample] for t in texts for i in range(0, len(t), sample)]
    if not chunks:
        return None, True
    try:
        return zstandard.train_dictionary(size, chunks, level=LEVEL).as_bytes(), False
    except zstandard.ZstdError:
        return b"\n".join(chunks)[:size], True


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float, float]:
    """(centre, slope, offset) of p = 1 / (1 + exp(-(slope * (x - centre) + offset))), by Newton steps."""
    if not len(x) or x.std() == 0:
        p = (y.sum() + 1) / (len(y) + 2)
        return 0.0, 0.0, float(np.log(p / (1 - p)))
    centre, scale = x.mean(), x.std()
    a = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(centre), float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple:
    """((good dictionary, plain?), (bad dictionary, plain?), curve) from rows outside the held-out fold."""
    lab = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("int").alias("y"))
    lab = lab.where("y in (0, 1)").where(fold(F.col("id")) != HELD_OUT).distinct()
    order = F.xxhash64(F.col("id").cast("string"))
    drawn = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(order, "id").limit(train_rows)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
                        .alias("text"))
    rows = write_scratch(
        texts.join(F.broadcast(drawn), "id")  # at most 2 * train_rows ids
        .groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that share an id, one
        .withColumn("part", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(5)))
        .repartition(FIT_TASKS, "id"), "quality-fit")
    whole = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("text") - 1, F.lit(0)), F.lit(CHUNK_BYTES))
    pieces = (rows.where("part < 3").select("id", "y", whole.alias("whole"), F.explode(starts).alias("at"))
              .select("id", "y", "at", F.substring("whole", F.col("at") + 1, F.lit(CHUNK_BYTES)).alias("chunk")))
    drawn = {}
    for y in (1, 0):
        got = pieces.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id").cast("string"), "at"), "id", "at").limit(TRAIN_CHUNKS)
        drawn[y] = [bytes(r.chunk) for r in got.select("chunk").collect()]
    made = [[train_dictionary(drawn[y], size, sample) for y in (1, 0)] for size, sample in SETTINGS]

    def compare(batches):
        import pyarrow as pa

        pairs = [[dictionary(*m) for m in pair] for pair in made]
        for batch in batches:
            for first, texts in text_slices(batch, 0):
                x = np.stack([differences(*pair, texts) for pair in pairs], axis=1)
                at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(pairs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["y", "x"])

    judge = rows.where("part >= 3")
    judge = rows if judge.isEmpty() else judge
    got = map_arrow(judge.select("text", "y"), compare, "y int, x array<double>").collect()
    y = np.array([float(r.y) for r in got])
    x = np.array([r.x for r in got], float).reshape(len(got), len(SETTINGS))
    best = max(range(len(SETTINGS)), key=lambda k: area_under(x[:, k], y))
    return *made[best], fit_curve(x[:, best], y)


def area_under(x: np.ndarray, y: np.ndarray) -> float:
    """Share of (1, 0) pairs that ``x`` puts in order, ties half; 0.5 without pairs."""
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse] if len(x) else x
    ones = y.sum()
    pairs = ones * (len(y) - ones)
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / pairs) if pairs else 0.5


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, difference."""
    good, bad, (centre, slope, offset) = fit(docs, labels, id_col, text_col, label_col, train_rows)
    d = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("__text"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        g, b = dictionary(*good), dictionary(*bad)
        for batch in batches:
            got = [differences(g, b, texts) for _, texts in text_slices(batch, 1)]
            x = np.concatenate(got) if got else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(slope * (x - centre) + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x)],
                                             names=["id", "score", "difference"])

    out = map_arrow(d, run, f"id {kind}, score double, difference double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")
