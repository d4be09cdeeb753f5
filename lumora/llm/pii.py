"""Personal data: patterns, and spans that a character BiLSTM-CRF trained on them finds besides."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import read, sampled, text_batches
from lumora.llm.tagger import PAD, Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next.
WINDOW, HOP = 64, 32
EDGE = (WINDOW - HOP) // 2
#: Least probability of each tag of a span that the tagger adds, by kind; a card's digits must pass Luhn besides.
SURE = {"email": 0.7, "ip": 0.7, "card": 0.3, "phone": 0.7}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, since all starts in a run go on alike; this keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Addresses with a spelt-out sign, by which windows are found that hold neither @ nor digits.
_SPELT = re.compile(r"[\[(]\s?at\s?[\])]|\sat\s\S{1,40}\sdot\s", re.I)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """What a match must fulfil besides its pattern."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, by going back from each @ to the last match or the first character that cannot belong."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns' valid matches, by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the tagger must fulfil; wider than the patterns."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and valid("ip", ".".join(parts))
    if kind == "card":
        return valid("card", digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and digits != found and not re.search("[^0-9+ ()./-]", found) and not _DATE.fullmatch(found)
    return len(found) >= 6 and not found.isdigit()


def _label(y: np.ndarray, spans: list[Span], at: int) -> None:
    """Tags 1 + 2 k (first character) and 2 + 2 k of the spans' parts in the window that starts at ``at``."""
    for k, s, e in spans:
        a, b = max(s - at, 0), min(e - at, len(y))
        if a < b:
            y[a:b] = 2 + 2 * k
            if s >= at:
                y[a] = 1 + 2 * k


def _digits(rng: np.random.Generator, form: str) -> str:
    """``form`` with each # as a digit, the first one of a run from 1 on."""
    return re.sub("#+", lambda m: str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, len(m[0]) - 1))), form)


def _letters(rng: np.random.Generator, least: int = 3, most: int = 9) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(least, most + 1)))


def made_card(rng: np.random.Generator, good: bool = True) -> str:
    while True:
        d = _digits(rng, "#" * 16)
        if luhn(d) == good:
            sep = str(rng.choice(["", " ", "-", "."])) if good else ""
            return sep.join(d[i : i + 4] for i in range(0, 16, 4))


AT = ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " dot "), (" @ ", " . "), (" [at] ", "."), ("(at)", "(dot)"))
PHONES = (
    "0## #######", "(0##) #### ####", "0###-#######", "0###/######", "###-###-####", "(###) ###-####", "0## #### ####", "0#### ######", "###.###.####", "00## ### #######", "0## ###-####", "0###.## ## ##", "+(##) ### ######",
)
DOTS = ("[.]", " . ", "(.)", "[dot]")
OTHERS = (
    "####-0#-1#", "1#.0#.20##", "0#/1#/20##", "1#:##:##", "#,###,###", "##########", "#.#.#", "$##.##", "978-#-##-######-#", "19##-20##", "#######", "####", "p. ##-##", "#.####", "##%", "############", "Nr. ###/##",
)


def made_span(rng: np.random.Generator) -> tuple[int, str]:
    """A span of a kind in a form that the patterns miss: spelt-out or spaced addresses, defanged ips, national phone
    numbers, cards with other separators."""
    k = int(rng.integers(len(KINDS)))
    if k == 0:
        at, dot = AT[rng.integers(len(AT))]
        local = _letters(rng) + str(rng.choice(["", ".", "_", "-"])) + str(rng.choice([_letters(rng, 2, 6), _digits(rng, "##")]))
        return k, local + at + _letters(rng) + dot + str(rng.choice(["com", "org", "net", "de", "fr", "es", "info", "co"]))
    if k == 1:
        return k, str(rng.choice(DOTS)).join(str(v) for v in rng.integers(0, 256, 4))
    if k == 2:
        return k, made_card(rng)
    return k, _digits(rng, str(rng.choice(PHONES)))


def made_other(rng: np.random.Generator) -> str:
    """What looks like personal data and is none."""
    form = int(rng.integers(len(OTHERS) + 4))
    if form < len(OTHERS):
        return _digits(rng, OTHERS[form])
    if form == len(OTHERS):
        return made_card(rng, good=False)
    if form == len(OTHERS) + 1:
        return "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, rng.integers(8, 41)))
    return str(rng.choice(["look at the dot on it", "at ten dot two", "(at least)", "[at last] .", "all at once dot"]))


def _with(rng: np.random.Generator, text: str, piece: str) -> tuple[str, int]:
    """``text`` with ``piece`` as a word of its own somewhere, and where it starts."""
    gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
    at = gaps[rng.integers(len(gaps))]
    tail = str(rng.choice([" ", ". ", ", ", "\n"]))
    return text[:at] + " " + piece + tail + text[at:].lstrip(" "), at + 1


def training_windows(texts: list[str], seed: int = 7, of_each: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags. Of each sort ``of_each`` windows are drawn: around the patterns' spans of a kind; three times that
    where two numbers stand side by side, which the patterns run together; twice that around what is none, and elsewhere in
    the texts; and five times around spans in forms that the patterns miss (``made_span``), put between words."""
    rng = np.random.default_rng(seed)
    found = [base_spans(t) for t in texts]
    by_kind: list[list[tuple[int, Span]]] = [[] for _ in KINDS]
    for d, spans in enumerate(found):
        for s in spans:
            if s[2] - s[1] <= HOP:
                by_kind[s[0]].append((d, s))
    xs, ys = [], []

    def add(text: str, spans: list[Span], at: int) -> None:
        x, y = np.full(WINDOW, PAD, np.int16), np.zeros(WINDOW, np.int8)
        lo, hi = max(at, 0), max(max(at, 0), min(at + WINDOW, len(text)))
        x[lo - at : hi - at] = char_ids(text[lo:hi])
        _label(y, spans, at)
        xs.append(x)
        ys.append(y)

    for own in by_kind:
        for _ in range(of_each if own else 0):
            d, (_, s, e) = own[rng.integers(len(own))]
            add(texts[d], found[d], int(s - rng.integers(0, WINDOW - (e - s) + 1)))
    numbers = [x for own in by_kind[1:] for x in own]
    for _ in range(3 * of_each if numbers else 0):
        (d, a), (c, b) = numbers[rng.integers(len(numbers))], numbers[rng.integers(len(numbers))]
        left, first, second = texts[d][max(0, a[1] - WINDOW) : a[1]], texts[d][a[1] : a[2]], texts[c][b[1] : b[2]]
        made = left + first + " " + second + texts[c][b[2] : b[2] + WINDOW]
        s1, s2 = len(left), len(left) + len(first) + 1
        add(made, [(a[0], s1, s1 + len(first)), (b[0], s2, s2 + len(second))], int(s1 - rng.integers(0, 12)))
    stretches = [t for t in texts if t]

    def stretch() -> str:
        t = stretches[rng.integers(len(stretches))]
        at = int(rng.integers(len(t)))
        return re.sub(r"\S*[0-9@]\S*", "", t[at : at + 2 * WINDOW])

    for _ in range(5 * of_each if stretches else 0):
        k, piece = made_span(rng)
        text, s = _with(rng, stretch(), piece)
        add(text, [(k, s, s + len(piece))], s - int(rng.integers(0, max(1, WINDOW - len(piece)))))
    for _ in range(2 * of_each if stretches else 0):
        piece = made_other(rng)
        text, s = _with(rng, stretch(), piece)
        add(text, base_spans(text), s - int(rng.integers(0, max(1, WINDOW - len(piece)))))
    for _ in range(2 * of_each if stretches else 0):
        d = int(rng.integers(len(texts)))
        if texts[d]:
            at = int(rng.integers(len(texts[d]))) - WINDOW // 2
            digits = [m.start() for m in re.finditer(r"[0-9@]", texts[d][max(at, 0) : at + 4096])]
            at = max(at, 0) + digits[0] - int(rng.integers(0, HOP)) if digits else at
            add(texts[d], found[d], at)
    return np.array(xs, np.int16).reshape(-1, WINDOW), np.array(ys, np.int8).reshape(-1, WINDOW)


def fit(docs: DataFrame, rows: int = 400, steps: int = 500) -> Tagger | None:
    """A tagger trained on the driver from a bounded sample: the ``rows`` documents with a digit or @ whose id and text hash
    lowest, labelled by the patterns and by spans put into them. None if there is no such document. Rows that repeat
    an id, or have none, are told apart by their texts."""
    sample = sampled(docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text"), rows).toPandas()
    x, y = training_windows(sample["text"].tolist())
    if not len(x):
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(x, y.astype(int), steps)
    return tagger


def _runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a span: around windows with an @, four digits or a spelt-out sign, joined
    where they overlap. Both are multiples of HOP less EDGE, and may lie beyond the text."""
    ids = char_ids(text)
    hit = 4 * (ids == 64) + ((ids >= 48) & (ids <= 57))
    for m in _SPELT.finditer(text):
        hit[m.start()] += 4
    n = -(-len(ids) // HOP)
    cells = np.zeros((n + 2) * HOP, np.int16)
    cells[HOP : HOP + len(hit)] = hit
    half = cells.reshape(-1, EDGE).sum(1)  # window k: half-cells 2 k + 1 to 2 k + 4
    sums = np.convolve(half, np.ones(WINDOW // EDGE, np.int64), "valid")[1 : 1 + 2 * n : 2]
    ks = np.flatnonzero(sums >= 4)
    if not len(ks):
        return []
    cuts = np.flatnonzero(np.diff(ks) > WINDOW // HOP)
    first, last = ks[np.concatenate(([0], cuts + 1))], ks[np.concatenate((cuts, [len(ks) - 1]))]
    return list(zip((first * HOP - EDGE).tolist(), (last * HOP - EDGE + WINDOW).tolist()))


def emissions(tagger: Tagger, runs: list[np.ndarray]) -> list[np.ndarray]:
    """The emissions of each run of character ids (a multiple of HOP long, WINDOW at least): the mean over the windows that
    hold a character, each weighed by how far it stands from the window's edge."""
    weight = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW, 0, -1)).astype(np.float32)
    starts = [np.arange(0, len(r) - WINDOW + 1, HOP) for r in runs]
    windows = np.concatenate([r[s[:, None] + np.arange(WINDOW)] for r, s in zip(runs, starts)])
    e = np.concatenate([tagger.emissions(windows[k : k + 4096])[0] for k in range(0, len(windows), 4096)], axis=1)
    out, at = [], 0
    for r, s in zip(runs, starts):
        total, mass = np.zeros((len(r), e.shape[2]), np.float32), np.zeros((len(r), 1), np.float32)
        for k in range(len(s)):
            total[s[k] : s[k] + WINDOW] += e[:, at + k] * weight[:, None]
            mass[s[k] : s[k] + WINDOW] += weight[:, None]
        out.append(total / mass)
        at += len(s)
    return out


def _spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, least probability of its tags)."""
    out, k, s = [], -1, 0
    for i, t in enumerate([*tags.tolist(), 0]):
        if k >= 0 and t != 2 + 2 * k:
            out.append((k, s, i, float(sure[s:i].min())))
            k = -1
        if t % 2:
            k, s = (t - 1) // 2, i
    return out


def decoded(tagger: Tagger, runs: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """``_spans`` of each run, decoded as one sequence however many windows it has. Runs of some length are decoded together,
    filled up with characters that have no tag."""
    e = emissions(tagger, runs)
    out: list[list] = [[] for _ in runs]
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    while order:
        longest, n = len(runs[order[-1]]), 1
        while n < len(order) and n * longest < 1 << 18 and 2 * len(runs[order[-1 - n]]) > longest:
            n += 1
        own, order = order[-n:], order[:-n]
        both = np.full((longest, n, tagger.tags), -50, np.float32)
        both[:, :, 0] = 0
        for j, i in enumerate(own):
            both[: len(runs[i]), j] = e[i]
        tags, sure = tagger.decode(both)
        for j, i in enumerate(own):
            if tags[j].any():
                out[i] = _spans(tags[j][: len(runs[i])], sure[j])
    return out


def _reconciled(text: str, base: list[Span], proposed: list[tuple[int, int, int, float]]) -> list[Span]:
    """Base spans and those proposed ones that are sure and plausible and overlap nothing kept; surer ones go first."""
    taken, out = [(s, e) for _, s, e in base], []
    for k, s, e, sure in sorted(proposed, key=lambda x: (-x[3], x[1], x[0])):
        while s < e and text[s] in " \n\t":
            s += 1
        while s < e and text[e - 1] in " \n\t.,":
            e -= 1
        if sure < SURE[KINDS[k]] or not plausible(KINDS[k], text[s:e]) or any(s < b and a < e for a, b in taken):
            continue
        if text[s - 1 : s].isalnum() or text[e : e + 1].isalnum():
            continue
        taken.append((s, e))
        out.append((k, s, e))
    return sorted(base + out)


def find(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Runs of all texts are decoded together, some thousand windows at a time."""
    base = [base_spans(t) for t in texts]
    proposed: list[list] = [[] for _ in texts]
    owner, runs, held = [], [], 0

    def decode() -> None:
        for (i, at), spans in zip(owner, decoded(tagger, runs)):
            n = len(texts[i])
            proposed[i] += [(k, max(s + at, 0), min(e + at, n), p) for k, s, e, p in spans if s + at < n and e + at > 0]
        owner.clear(), runs.clear()

    for i, t in enumerate(texts if tagger else []):
        if re.search("[0-9@]", t) or _SPELT.search(t):
            padded = None
            for a, b in _runs(t):
                if padded is None:
                    padded = np.full(len(t) + 4 * WINDOW, PAD, np.int16)
                    padded[WINDOW : WINDOW + len(t)] = char_ids(t)
                owner.append((i, a))
                runs.append(padded[a + WINDOW : b + WINDOW])
                held += (b - a) // HOP
            if held >= 4096:
                decode()
                held = 0
    if runs:
        decode()
    return [(b, _reconciled(t, b, p) if p else sorted(b)) for t, b, p in zip(texts, base, proposed)]


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def detected(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, numbers of the patterns' spans by kind, base_sha256, spans.

    The numbers and ``base_sha256`` are of the patterns' spans alone, which no model changes; ``spans`` has the tagger's
    besides. Null is an empty text; its lists are empty. Each text is read whole, in one pass without a shuffle, and
    ids never leave Spark; the tagger is some 40 kB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = find([t or "" for t in texts], shared.value)
            out = {f"n_{kind}": [sum(s[0] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(described(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [described(every) for _, every in found]
            yield pd.DataFrame(out)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    look = F.pandas_udf(run, ", ".join(f"{c} {'long' if c[:2] == 'n_' else 'string'}" for c in names)).asNondeterministic()  # else a filter on its result runs it again
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), look(F.col("text").cast("string")).alias("_f"))
    return rows.select("doc_id", *[F.col("_f")[c].alias(c) for c in names])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in angle brackets."""
    out, done, upto = [], 0, 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= upto:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        upto = done = max(upto, e)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with the spans of each text replaced; null texts stay null, n_chars follows if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = find([t or "" for t in texts], shared.value)
            yield pd.Series([t if t is None else redact(t, every) for t, (_, every) in zip(texts, found)], dtype=object)

    clean = F.pandas_udf(run, "string")
    out = text_batches(docs).withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return detected(docs, fit(docs))
