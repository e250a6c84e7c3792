"""Personal data: fixed patterns and a linear-chain CRF over word shapes.

Base spans come from the patterns over the whole text (``base_spans``) and always
stay. A conditional random field adds spans that the patterns miss, such as
national telephone numbers and bracketed mail addresses. Its features are shapes of
words, never the words; it is trained in numpy from a small labelled table
(``labelled_rows``: marked-up lines of invented data made by rule, or the caller's
own) and decoded by Viterbi over batches of padded windows.

Tokens end at white space, brackets, colons, slashes, quotes and the like, and are seen by
their whole shape. Those with a digit, an at sign, a bracketed "at" or "dot" and those beside them may carry
a label, and so may the three on each side of a "dot" that stands as a word. The others are fixed to O, which
cuts a text into windows (runs of such tokens with ``CONTEXT`` tokens around) that decode
independently: two windows are joined by fixed O labels alone. The field decides where a span
starts and ends; it is added if it can be of its kind (``fitting``) and meets no base span.

Defined cases: null counts as empty; empty texts give no spans and the hash of the
empty string; very long texts run in linear time (the patterns never rescan a run);
one row comes out for each row that goes in; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipfold.llm.common import column, map_arrow, text_slices, worker_cache

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
HASHED = 1 << 13
CONTEXT = 2
EPOCHS = 60
#: Labelled rows made by rule, and the seed they are made from.
LABELLED_ROWS = 1200
SEED = 7
#: Windows decoded together, by length.
BATCH = 512

# --- base patterns ------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Whole runs are taken even where the rest fails, so that no digit is read twice.
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every pattern match, by start and then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# --- windows and features -----------------------------------------------------

_SPACE = " \t\n\r\f\v"
#: Tokens: bracketed "at", "dot" and full stops; runs without white space, brackets, colons, slashes and the like; else single marks.
_TOKEN = re.compile(r"[\[(](?:at|dot|\.)[\])]|[^ \t\n\r\f\v()\[\]{}<>:/,;\"'=|]+|[^ \t\n\r\f\v]", re.I)
_SEES = re.compile(r"[0-9]+|@|[\[(](?:at|dot|\.)[\])]|(?<![A-Za-z])dot(?![A-Za-z])", re.I)
_MARK = re.compile(r"[\[(](at|dot|\.)[\])]", re.I)
#: Tokens on each side that a seen token opens, and a "dot" that stands as a word.
REACH, WORD_REACH = 1, 3


def shape(token: str) -> str:
    """A token's shape: digits 0 with their count, letters a or A, marks themselves; "at" and "dot" are marks."""
    mark = _MARK.fullmatch(token)
    word = mark[1].lower() if mark else token.lower()
    if word in ("at", "dot", "."):
        return {"at": "\x01", "dot": "\x02", ".": "\x02"}[word] + ("m" if mark else "")
    out, last, run = [], "", 0
    for c in token:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == last:
            run += 1
            continue
        if last:
            out.append(f"0{min(run, 9)}" if last == "0" else last)
        last, run = k, 1
    out.append(f"0{min(run, 9)}" if last == "0" else last)
    return "".join(out)


def reach(token: str) -> int:
    """Tokens that this one opens on each side; -1 if it opens none, itself included."""
    if token.strip(".").lower() == "dot":
        return WORD_REACH
    return REACH if "@" in token or _DIGIT.search(token) or _MARK.fullmatch(token) else -1


def windows(text: str) -> list[list[tuple[int, int, str, bool]]]:
    """Runs of (start, end, shape, open?) around the tokens that may carry a label."""
    out: list[list] = []
    done = 0  # tokens before this place are in a window already
    for mark in _SEES.finditer(text):
        if mark.start() < done:
            continue
        start = mark.start()
        for _ in range(WORD_REACH + CONTEXT + 1):  # back over white-space-free stretches, in whole
            while start > done and text[start - 1] in _SPACE:
                start -= 1
            while start > done and text[start - 1] not in _SPACE:
                start -= 1
        run, reaches, idle, last, seen = [], [], 0, -1, False
        for m in _TOKEN.finditer(text, start):
            r = reach(m[0])
            run.append((m.start(), m.end(), ("~" if m.start() == last else "") + shape(m[0])))
            reaches.append(r)
            last = done = m.end()
            seen = seen or r >= 0
            idle = 0 if r >= 0 else idle + 1
            if seen and idle == 2 * WORD_REACH + CONTEXT:
                # No token is open for this window and the next; the last ones may be the next one's.
                keep = len(run) - WORD_REACH
                done = run[keep - CONTEXT - 1][1]
                run, reaches = run[:keep], reaches[:keep]
                break
        opened = np.zeros(len(run), bool)
        for k, r in enumerate(reaches):
            if r >= 0:
                opened[max(0, k - r):k + r + 1] = True
        if not seen:
            continue
        # The context in front is the two tokens before the first that may carry a label.
        first = max(0, int(opened.argmax()) - CONTEXT)
        out.append([(*t, bool(o)) for t, o in zip(run[first:], opened[first:], strict=True)])
    return out


def features(run: list[tuple[int, int, str, bool]]) -> list[list[int]]:
    """Hashed features of each chunk of a window: its shape and its neighbours'."""
    import zlib

    s = ["<2", "<1", *(c[2] for c in run), ">1", ">2"]
    out = []
    for k in range(2, len(s) - 2):
        names = (f"w{s[k]}", f"l{s[k - 1]}", f"r{s[k + 1]}", f"lw{s[k - 1]}|{s[k]}", f"wr{s[k]}|{s[k + 1]}",
                 f"lr{s[k - 1]}|{s[k + 1]}", f"ll{s[k - 2]}|{s[k - 1]}", f"rr{s[k + 1]}|{s[k + 2]}",
                 f"f{s[k][:2]}", f"e{s[k][-2:]}")
        out.append([zlib.crc32(n.encode()) % HASHED for n in names])
    return out


# --- the labelled table -------------------------------------------------------

def labelled_rows(spark, n: int = LABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """(text, spans array<struct<start, end, kind>>): lines of invented data made by rule."""
    rows = [(t, [(s, e, KINDS[k]) for s, e, k in spans]) for t, spans in _invent(n, seed)]
    return spark.createDataFrame(rows, "text string, spans array<struct<start int, end int, kind string>>")


#: Sentences and layouts that hold an item; the table's own words are of no account, as only shapes are seen.
CARRIERS = (
    "Please write to {} before Friday.", "You can reach me on {} after six.", "My new number is {}, call any time!",
    "Contact: {}", "tel:{}", "Tel. {} / Fax {}", "phone={}", "({})", "[{}]", "<{}>", "\"contact\": \"{}\",", "'{}'", "{}",
    "Name | {} | City", "id,{},note", "mailto:{}", "href=\"tel:{}\"", "- {}\n- {}", "user {} logged in from {}", "Paid with {} yesterday.",
    "Bitte schreiben Sie an {} oder rufen Sie {} an.", "Meine Nummer lautet {}.", "Appelez le {} ou écrivez à {} ;", "Mon adresse : {}.",
    "Llame al {} o escriba a {}.", "Mi correo es {}, gracias.", "pin {} please", "Server {} is down", "from {} to {}", "{};{};{}",
    "Ask Ann Lee ({}) or Bo ({}).", "Call us: {}. Thanks", "KEY {} END", "see {} and {}", "{}\t{}\t{}", "Order by phone at {} today",
)


def _invent(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def digits(k):
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def word():
        return "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))

    def card():
        body = digits(15)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick(["", " ", "-", ".", "  ", "/"]).join(full[i:i + 4] for i in range(0, 16, 4))

    def email():
        local = pick([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", word().title()])
        host = f"{word()}.{pick(['com', 'org', 'net', 'example.com'])}"
        at, dot = pick([("@", "."), ("@", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "),
                        (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), ("[at]", "."), ("@", "[.]")])
        return f"{local}{at}{host.replace('.', dot)}"

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}",
                     f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}", f"0{digits(3)} {digits(3)} {digits(4)}", f"({a}) {b} {c}"])

    def ip():
        return pick([".", ".", "[.]", "(.)", "[dot]", " dot "]).join(str(x) for x in rng.integers(0, 256, 4))

    def nothing():
        return pick([digits(int(rng.integers(1, 9))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}",
                     f"{digits(2)}:{digits(2)}", f"version {digits(1)}.{digits(1)}.{digits(1)}", f"${digits(3)}.{digits(2)}",
                     f"token = \"{''.join(pick('0123456789abcdef') for _ in range(40))}\"", f"{digits(2)}%", f"@{word()}",
                     f"{word()}{digits(2)}", f"({digits(4)})", f"{digits(3)},{digits(3)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
                     f"https://{word()}.com/{digits(5)}?p={digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(20)}",
                     f"AKIA{digits(4)}{word().upper()}{digits(4)}", f"pages {digits(3)}-{digits(3)}", f"{digits(16)}x", f"{digits(10)}",
                     " ".join(digits(int(rng.integers(1, 6))) for _ in range(int(rng.integers(2, 12)))), f"the {word()} dot {word()} is",
                     " ".join(digits(3) for _ in range(int(rng.integers(4, 9)))), f"{digits(4)}-{digits(4)}-{digits(2)}", f"a dot and a {word()}",
                     f"{digits(3)}-{digits(2)}-{digits(3)}-{digits(5)}-{digits(1)}", f"at {digits(2)}:{digits(2)}", f"{word()}[{digits(1)}]",
                     f"{digits(2)} x {digits(2)} x {digits(2)}", f"({digits(3)}) {word()}", f"{digits(8)}-{digits(4)}-{digits(4)}-{digits(12)}"])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = pick(["", " ".join(word() for _ in range(int(rng.integers(1, 5)))) + pick([" ", ". ", ", "])]), []
        for part in re.split(r"(\{\})", pick(CARRIERS)):
            if part != "{}":
                text += part
                continue
            k = int(rng.integers(0, 8))
            got = makers[k]() if k < 4 else nothing()
            if k < 4:
                spans.append((len(text), len(text) + len(got), k))
            text += got
        out.append((text + pick(["", " " + word(), "\n" + word().title()]), spans))
    return out


# --- the field ----------------------------------------------------------------

def _allowed() -> np.ndarray:
    """0 where a label may follow another, very low where not (the first row: at the start)."""
    bad = np.full((len(LABELS) + 1, len(LABELS)), 0.0)
    for j, b in enumerate(LABELS):
        for i, a in enumerate(["O", *LABELS]):
            if b[0] == "I" and a[2:] != b[2:]:
                bad[i, j] = -1e4
    return bad


def _pad(runs: list, opens: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, length, k) with HASHED as none, open?, and lengths of windows."""
    length, k = max(map(len, runs)), len(runs[0][0])
    f = np.full((len(runs), length, k), HASHED, np.int32)
    o = np.zeros((len(runs), length), bool)
    for i, (r, w) in enumerate(zip(runs, opens, strict=True)):
        f[i, :len(r)], o[i, :len(r)] = r, w
    return f, o, np.array([len(r) for r in runs])


def _scores(weights: np.ndarray, f: np.ndarray, opens: np.ndarray) -> np.ndarray:
    s = weights[f].sum(axis=2)
    s[~opens, 1:] = -1e4  # fixed to O; so are the places after a window's end
    return s


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, l2: float = 1e-3
          ) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transitions) by gradient ascent on the conditional likelihood."""
    runs, opens, gold = [], [], []
    for text, spans in rows:
        for w in windows(text):
            labels, last = [], None
            for s, e, _, opened in w:
                hit = next((x for x in spans if s < x[1] and e > x[0]), None) if opened else None
                labels.append(0 if hit is None else (2 if hit == last else 1) + 2 * hit[2])
                last = hit
            runs.append(features(w))
            opens.append([c[3] for c in w])
            gold.append(labels)
    n = len(LABELS)
    weights, trans = np.zeros((HASHED + 1, n)), np.zeros((n, n))
    if not runs:
        return weights, trans + _allowed()[1:]
    f, o, size = _pad(runs, opens)
    y = np.zeros(o.shape, int)
    for i, g in enumerate(gold):
        y[i, :len(g)] = g
    real = np.arange(o.shape[1])[None, :] < size[:, None]
    bad, start = _allowed()[1:], _allowed()[0]
    # Places by feature, sorted once: a gradient is a sum over each feature's places.
    order = np.argsort(f, axis=None, kind="stable")
    names, firsts = np.unique(f.ravel()[order], return_index=True)
    places = order // f.shape[2]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans)]
    rate = 0.15
    for step in range(1, epochs + 1):
        s = _scores(weights, f, o)
        s[:, 0] += start
        t = trans + bad
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for j in range(1, s.shape[1]):
            alpha[:, j] = s[:, j] + _logsum(alpha[:, j - 1, :, None] + t[None], 1)
        for j in range(s.shape[1] - 2, -1, -1):
            beta[:, j] = _logsum(t[None] + (s[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        diff = (np.eye(n)[y] - node) * real[:, :, None] / len(runs)
        gw, gt = np.zeros_like(weights), np.zeros_like(trans)
        gw[names] = np.add.reduceat(diff.reshape(-1, n)[places], firsts)
        for j in range(1, s.shape[1]):
            pair = np.exp(alpha[:, j - 1, :, None] + t[None] + (s[:, j] + beta[:, j])[:, None, :] - z[:, None, None])
            live = real[:, j][:, None, None]
            np.add.at(gt, (y[:, j - 1], y[:, j]), real[:, j] / len(runs))
            gt -= (pair * live).sum(axis=0) / len(runs)
        gw[HASHED] = 0
        for p, g, (m, v) in zip((weights, trans), (gw - l2 * weights, gt - l2 * trans), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return weights, trans + bad


def viterbi(model: tuple[np.ndarray, np.ndarray], runs: list, opens: list) -> list[np.ndarray]:
    """Best labels of each window, in batches of windows of like length."""
    weights, trans = model
    start = _allowed()[0]
    out: list = [None] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    at = 0
    while at < len(order):
        step = max(1, min(BATCH, (1 << 17) // max(1, len(runs[order[min(at + BATCH, len(order)) - 1]]))))
        part = order[at:at + step]
        at += step
        f, o, size = _pad([runs[i] for i in part], [opens[i] for i in part])
        s = _scores(weights, f, o)
        best = s[:, 0] + start
        back = np.zeros(s.shape, np.int8)
        for j in range(1, s.shape[1]):
            cand = best[:, :, None] + trans[None]
            back[:, j] = cand.argmax(axis=1)
            best = s[:, j] + cand.max(axis=1)
        label = best.argmax(axis=1)
        path = np.zeros(o.shape, np.int8)
        for j in range(s.shape[1] - 1, -1, -1):
            path[:, j] = label
            label = back[np.arange(len(part)), j, label]
        for k, i in enumerate(part):
            out[i] = path[k, :size[k]]
    return out


_TRIM = _SPACE + ",;:\"'<>|=/{}-"
_AT = re.compile(r"\s*[\[(]at[\])]\s*|\s+at\s+|\s*@\s*", re.I)
_DOT = re.compile(r"\s*[\[(](?:dot|\.)[\])]\s*|\s+dot\s+", re.I)
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> str:
    """A span with its spelled-out marks as marks."""
    return _DOT.sub(".", _AT.sub("@", text))


def fitting(text: str, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """A found span without the marks at its ends, or None if it can't be of its kind: a mail
    address has a local part and a host with a dot, an IP address four numbers up to 255, a card 13 to 19
    digits passing Luhn, a telephone number 10 to 15 digits and no letter."""
    while start < end and (text[start] in _TRIM + ".)]" or (text[start] in "([" and text.find(")" if text[start] == "(" else "]", start, end) < 0)):
        start += 1
    while end > start and (text[end - 1] in _TRIM + ".([" or (text[end - 1] in ")]" and not _MARK.search(text, max(start, end - 5), end)
                                                            and text.rfind("(" if text[end - 1] == ")" else "[", start, end) < 0)):
        end -= 1
    if start == end or (start and text[start - 1].isalnum()) or text[end:end + 1].isalnum():
        return None  # a slice of a longer word or number is none
    got = plain(text[start:end])
    digits = _DIGITS.sub("", got)
    if kind == 0:
        local, _, host = got.partition("@")
        ok = bool(local) and _DOMAIN.fullmatch(host) is not None and set(local) <= _LOCAL
    elif kind == 1:
        parts = got.split(".")
        ok = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    else:
        ok = not _LETTER.search(got) and (13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15)
    return (start, end) if ok else None


def find_texts(model: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t or "") for t in texts]
    at, runs = [], []
    for i, t in enumerate(texts):
        for w in windows(t) if t else ():
            at.append(i)
            runs.append(w)
    added: list[list] = [[] for _ in texts]
    if runs:
        paths = viterbi(model, [features(w) for w in runs], [[c[3] for c in w] for w in runs])
        for i, w, path in zip(at, runs, paths, strict=True):
            j = 0
            while j < len(path):
                if not path[j]:
                    j += 1
                    continue
                k, last = (int(path[j]) - 1) // 2, j
                while last + 1 < len(path) and path[last + 1] == 2 + 2 * k:
                    last += 1
                got = fitting(texts[i], w[j][0], w[last][1], k)
                if got and all(got[1] <= s or got[0] >= e for s, e, _ in base[i]):
                    added[i].append((*got, k))
                j = last + 1
    return list(zip(base, added, strict=True))


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
             epochs: int = EPOCHS) -> DataFrame:
    """One row per input row: id, counts of base spans by kind, base_sha256, spans, n_added, n_spans (of all kinds and both sorts).

    ``labelled`` is a small table (text, spans); at most ``10 * LABELLED_ROWS`` rows of it train.
    """
    table = labelled if labelled is not None else labelled_rows(docs.sparkSession)
    rows = [(r.text, [(s.start, s.end, KINDS.index(s.kind)) for s in r.spans])
            for r in table.orderBy("text").limit(10 * LABELLED_ROWS).collect()]
    weights, trans = train(rows, epochs)
    model = (weights.astype(np.float32), trans.astype(np.float32))
    d = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("__text"))
    kind = d.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, sha, spans, more = [], [], [], []
            for _, texts in text_slices(batch, 1):
                for base, added in find_texts(model, texts):
                    per = [0, 0, 0, 0]
                    for s in base:
                        per[s[2]] += 1
                    counts.append(per)
                    sha.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                    spans.append(_text_of(base + added))
                    more.append(len(added))
            counts = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(sha, pa.string()),
                 pa.array(spans, pa.string()), pa.array(more, pa.int64()),
                 pa.array(counts.sum(axis=1) + np.array(more, np.int64))],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return map_arrow(d, run, (f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                              + ", base_sha256 string, spans string, n_added bigint, n_spans bigint")).withColumnRenamed("id", id_col)
