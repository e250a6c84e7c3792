"""Language ID by Bayesian evidence fusion.

The posterior of a language is the product of four kinds of evidence:

* text: a naive Bayes model over hashed byte trigrams of the whole text, counted
  by a grouped aggregation over every labelled row; a trigram shares its bytes with
  its neighbours, so the log-likelihood counts a third;
* declared language (markup attribute or column): P(declared | language), counted
  from how declarations go with what the texts say, smoothed;
* address suffix and host: the prior of a row is its host's share of each language,
  smoothed towards the suffix's, which is smoothed towards the corpus's, with
  ``kappa`` pseudo-rows. A row's own text is left out of the counts of its host.

Beside the labelled languages there is ``und``, under which all trigrams are
equally likely. A row is accepted if its best language is not ``und``, its posterior
reaches ``least`` and its text has a letter.

The model has every declared language up to ``MAX_LANGS``, the most frequent ones, times
``BUCKETS`` numbers. If there are more, a row that declares none of the model's cannot
be judged: it keeps its declared language, with a null posterior, and is accepted if its
text has a letter. So no language is lost for being rare. Per-host tables stay distributed; a hot host is one
row of a small table after partial aggregation and a skew-split join side.

Defined cases: null or letterless texts are ``und`` and rejected; null declared
language, host and suffix count as values of their own; an empty table gives an
empty result; no labelled rows at all leave ``und`` alone, which rejects all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, text_slices, without, write_scratch

BUCKETS = 1 << 14
MAX_LANGS = 256
#: Rows that one task judges, about.
TASK_ROWS = 10_000
KAPPA = 20.0
LEAST = 0.5
UND = "und"
SLICE = 1 << 20

# Bytes as the model sees them: lower case, all but letters and non-ASCII a space.
_SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, number of the text it is in) of whole texts."""
    data = [(t or "").encode() for t in texts]
    b = _SEEN[np.frombuffer(b"  ".join([b"", *data, b""]), np.uint8)]
    ends = np.cumsum([len(x) + 2 for x in data])
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    at = np.flatnonzero(code != 0x202020)
    bucket = (code[at] * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
    return bucket, np.searchsorted(ends, at, side="right")


def train(labelled: DataFrame, text_col: str, lang_col: str, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray, bool]:
    """(languages with ``und`` last, log P(bucket | language), whether languages are left out) from every labelled row."""
    rows = labelled.select(column(labelled, text_col).cast("string").alias("text"),
                           column(labelled, lang_col).cast("string").alias("lang")).where("lang is not null")
    often = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_langs + 1)
    langs = [r[0] for r in often.collect()]
    partial, langs = len(langs) > max_langs, sorted(langs[:max_langs])
    number = {name: k for k, name in enumerate(langs)}

    def count(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()])
            for first, texts in text_slices(batch, 0, SLICE):
                bucket, of = trigrams(texts)
                of = lang[first + of]
                for k in np.unique(of[of >= 0]):
                    got = np.bincount(bucket[of == k], minlength=BUCKETS)
                    sums[k] = sums[k] + got if k in sums else got
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)),
                                              pa.array(v[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = np.zeros((len(langs) + 1, BUCKETS))
    if langs:
        for k, bucket, n in (map_arrow(rows, count, "lang int, bucket int, n bigint")
                             .groupBy("lang", "bucket").agg(F.sum("n")).toPandas().itertuples(index=False)):
            counts[k, bucket] = n
    counts = counts + 0.5
    counts[-1] = 1.0
    return [*langs, UND], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), partial


def softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def text_evidence(items: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """Rows (rid, text, ...) with ``text`` replaced by ``grams``, ``ll`` (log-likelihoods by
    language) and ``soft`` (the same as a posterior under equal priors)."""
    names = [c for c in items.columns if c != "text"]
    at = items.columns.index("text")
    keep = [k for k in range(len(items.columns)) if k != at]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "text"),
                        "grams bigint", "ll array<double>", "soft array<double>"])

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            n, ll = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(langs)))
            for first, texts in text_slices(batch, at, SLICE):
                bucket, of = trigrams(texts)
                n[first:first + len(texts)] = np.bincount(of, minlength=len(texts))[:len(texts)]
                for k in range(len(langs)):
                    ll[first:first + len(texts), k] = np.bincount(of, logp[k][bucket], len(texts))[:len(texts)] / 3
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(langs))
            lists = (pa.ListArray.from_arrays(starts, pa.array(x.ravel())) for x in (ll, softmax(ll)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n), *lists],
                                             names=[*names, "grams", "ll", "soft"])

    return map_arrow(items, score, schema)


def _sums(rows: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Per key the rows' posteriors summed by language, as an array."""
    got = rows.groupBy(*keys).agg(*[F.sum(F.col("soft")[k]).alias(f"s{k}") for k in range(n)])
    return got.select(*keys, F.array(*[f"s{k}" for k in range(n)]).alias(out))


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the left columns and the right's other ones."""
    renamed = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"r_{k}" for k in keys])


def fuse(evidence: DataFrame, langs: list[str], kappa: float = KAPPA, least: float = LEAST, partial: bool = False) -> DataFrame:
    """Rows (rid, kind, declared, host, suffix, grams, ll) with lang, posterior, accepted, text_lang.

    ``kind`` keeps apart tables whose declarations and hosts mean different things.
    ``partial``: the model left languages out, so rows that declare none of its own are not judged.
    """
    n, known_langs = len(langs), set(langs)
    rows = write_scratch(evidence, "language-text")
    known = rows.where("grams > 0")
    said = _sums(known, ["kind", "declared"], n, "said_n")
    out = _match(rows, _sums(known, ["kind"], n, "all_n"), ["kind"], "left")
    for table, keys in ((_sums(known, ["kind", "suffix"], n, "suffix_n"), ["kind", "suffix"]),
                        (_sums(known, ["kind", "suffix", "host"], n, "host_n"), ["kind", "suffix", "host"]),
                        (said, ["kind", "declared"]),
                        (said.groupBy("kind").agg(F.count(F.lit(1)).alias("declarations")), ["kind"])):
        out = _match(out, table, keys, "left")
    helpers = ["grams", "ll", "soft", "all_n", "suffix_n", "host_n", "said_n", "declarations"]
    kept = [f for f in out.schema if f.name not in helpers]
    # By rows, not by bytes: the step after is heavy on the processor.
    out = out.select(*[f.name for f in kept], *helpers).repartition(max(1, -(-rows.count() // TASK_ROWS)))

    def decide(batches):
        import pyarrow as pa

        for batch in batches:
            grams = batch.column("grams").to_numpy()
            soft, ll = (np.array(batch.column(c).to_pylist()).reshape(-1, n) for c in ("soft", "ll"))
            own = soft * (grams > 0)[:, None]  # a row's own text is not evidence for its host

            def others(name):
                none = [0.0] * n
                counts = np.array([x or none for x in batch.column(name).to_pylist()]).reshape(-1, n)
                return np.maximum(counts - own, 0)

            def smooth(counts, parent):
                return (counts + kappa * parent) / (counts.sum(axis=1, keepdims=True) + kappa)

            every, said = others("all_n"), others("said_n")
            prior = (every + 1) / (every.sum(axis=1, keepdims=True) + n)
            prior = smooth(others("host_n"), smooth(others("suffix_n"), prior))
            values = np.array([x or 1 for x in batch.column("declarations").to_pylist()])[:, None]
            posterior = softmax(ll + np.log(prior) + np.log((said + 1) / (np.maximum(every, said) + values + 1)))
            best, score = posterior.argmax(axis=1), posterior.max(axis=1)
            lang = [langs[k] if g else UND for k, g in zip(best, grams, strict=True)]
            text = [langs[k] if g else UND for k, g in zip(ll.argmax(axis=1), grams, strict=True)]
            accepted = [x != UND and s >= least for x, s in zip(lang, score, strict=True)]
            score = score.tolist()
            for k, x in enumerate(batch.column("declared").to_pylist() if partial else ()):
                if x is not None and x not in known_langs:
                    if grams[k]:
                        lang[k] = x
                    score[k], accepted[k] = None, bool(grams[k])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(lang, pa.string()), pa.array(text, pa.string()),
                 pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[*(f.name for f in kept), "lang", "text_lang", "score", "accepted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "lang string, text_lang string, score double, accepted boolean"])
    return map_arrow(out, decide, schema)


def page_items(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host, suffix) of web pages: markup off, ``lang`` attribute, address parts."""
    html = column(pages, html_col).cast("string")
    url = column(pages, url_col).cast("string")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&[#\w]{1,12};", " ")
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))
    return (pages.select(column(pages, id_col).alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
                         F.nullif(host, F.lit("")).alias("host"))
            .withColumn("suffix", F.element_at(F.split("host", r"\."), -1)))


def document_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """(id, text, declared, host, suffix) of documents: the source stands for the host."""
    return docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"),
                       F.lower(column(docs, lang_col).cast("string")).alias("declared"),
                       column(docs, source_col).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def identify(items: DataFrame, labelled: DataFrame, kappa: float = KAPPA, least: float = LEAST,
             max_langs: int = MAX_LANGS) -> DataFrame:
    """(id and further columns, lang, text_lang, score, accepted) of rows
    (id, kind, text, declared, host, suffix), with the model of ``labelled`` (text, lang)."""
    langs, logp, partial = train(labelled, "text", "lang", max_langs)
    return fuse(text_evidence(items, langs, logp), langs, kappa, least, partial)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns."""
    text, lang, source = (column(docs, c) for c in (text_col, lang_col, source_col))
    # Rows alike in what is judged are judged alike, so they need no number.
    keys = [column(docs, id_col), F.xxhash64(text, lang, source)]
    items = docs.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("id"),
                        *[c.alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    labelled = docs.select(text.alias("text"), F.lower(lang.cast("string")).alias("lang"))
    judged = identify(document_items(items, "id", "text", "lang", "source").withColumn("kind", F.lit("documents")), labelled)
    gone = write_scratch(judged.where(~F.col("accepted")).select("id.k0", "id.k1").distinct(), "language-rejected")
    return without(docs, keys, gone)


def identify_tables(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document and per page; the other table's id is null."""
    items = (document_items(documents).withColumn("kind", F.lit("documents"))
             .unionByName(page_items(pages).withColumn("kind", F.lit("pages"))))
    labelled = documents.select("text", F.lower("lang").alias("lang"))
    got = identify(items, labelled)
    return got.select(F.when(F.col("kind") == "documents", F.col("id")).alias("doc_id"),
                      F.when(F.col("kind") == "pages", F.col("id")).alias("page_id"), "declared", "text_lang", "lang",
                      "score", "accepted")
