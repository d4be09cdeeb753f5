"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import checkpointed, fraction, read, settled, text_batches

#: Order of the models; four characters of 16 bits each make one 64-bit key.
ORDER = 4
SPACE = np.uint64(32)
#: Odd multiplier that turns a key into its hash; the low bits of the key reach the high bits of the hash.
MIX = np.uint64(0x9E3779B97F4A7C15)
UND = "und"
#: Characters that are handled at a time.
STEP = 1 << 18


def _folding() -> np.ndarray:
    """For each code point of the basic plane: its lower-case form if it is a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, each run of other characters as one space, with a space at either end.

    Code points above the basic plane keep their low 16 bits if they are letters.
    """
    global _FOLD
    if _FOLD is None:
        _FOLD = _folding()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and int(points.max()) > 0xFFFF:
        high = points > 0xFFFF
        folded = _FOLD[np.where(high, 32, points)]
        folded[high] = [ord(chr(p).lower()[0]) & 0xFFFF if chr(p).isalpha() else 32 for p in points[high].tolist()]
    else:
        folded = _FOLD[points]
    folded = np.concatenate((np.array([32], np.uint16), folded, np.array([32], np.uint16)))
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    return folded[keep]


def grams(folded: np.ndarray) -> np.ndarray:
    """Keys of all characters after the first, each with the ORDER - 1 before it (spaces before the start)."""
    c = np.concatenate((np.full(ORDER - 2, 32, np.uint16), folded)).astype(np.uint64)
    n = len(folded) - 1
    key = np.zeros(n, np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(16)) | c[k : k + n]
    return key


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owner) of about STEP characters at a time; owner is the text's place in ``texts``."""
    keys, owners, held = [], [], 0
    for i, t in enumerate(texts):
        k = grams(letters(t))
        if len(k) < 2:
            continue
        for at in range(0, len(k), STEP):
            part = k[at : at + STEP]
            keys.append(part)
            owners.append(np.full(len(part), i, np.int32))
            held += len(part)
            if held >= STEP:
                yield np.concatenate(keys), np.concatenate(owners)
                keys, owners, held = [], [], 0
    if keys:
        yield np.concatenate(keys), np.concatenate(owners)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts over all rows of ``docs`` (text, lang), added up within each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, pd.Series] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, s in total.items():
                yield pd.DataFrame({"lang": lang, "gram": s.index.to_numpy().view(np.int64), "n": s.to_numpy()})
            total.clear()

        for b in batches:
            for lang, own in b.groupby("lang", sort=False):
                for keys, _ in _pieces(own["text"].tolist()):
                    s = pd.Series(keys.view(np.int64)).value_counts(sort=False)
                    total[lang] = s if lang not in total else total[lang].add(s, fill_value=0).astype(np.int64)
            if sum(map(len, total.values())) > 1 << 19:  # bounded memory; the shuffle adds the rest
                yield from flush()
        yield from flush()

    return text_batches(docs).select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels(counted: DataFrame) -> DataFrame:
    """(k, lang, gram, n): the n-grams of each order k of ``counted`` (lang, gram, n), which holds those of the highest.

    Lower orders count the different characters seen before an n-gram, as Kneser-Ney asks.
    """
    level = counted.select(F.lit(ORDER).alias("k"), "lang", "gram", "n")
    out = level
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "lang", "gram", "n")
        out = out.unionByName(level)
    return out


def weighed(grams: DataFrame) -> DataFrame:
    """``grams`` (k, lang, gram, n) with ``alpha``, the discounted share of the n-gram in its context: (n - d) over the
    context's sum of n, where d is the discount of order and language, n1 / (n1 + 2 n2), at least 0.1, and 0.5 where
    neither one nor two occurs. Discounts and sums are over all n-grams."""
    n1, n2 = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    discount = grams.groupBy(F.col("k").alias("_k"), F.col("lang").alias("_l")).agg(F.when(n1 + n2 == 0, 0.5).otherwise(F.greatest(F.lit(0.1), n1 / (n1 + 2 * n2))).alias("d"))
    rows = grams.withColumn("context", F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned("gram", 16)))
    mass = rows.groupBy(F.col("k").alias("_mk"), F.col("lang").alias("_ml"), F.col("context").alias("_mc")).agg(F.sum("n").alias("mass"))
    rows = rows.join(mass, (F.col("k") == F.col("_mk")) & (F.col("lang") == F.col("_ml")) & (F.col("context") == F.col("_mc")))
    rows = rows.join(F.broadcast(discount), (F.col("k") == F.col("_k")) & (F.col("lang") == F.col("_l")))  # a row per order and language
    return rows.select("k", "lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("mass")).alias("alpha"))


def room(sizes: dict[tuple[int, str], int], most: int) -> dict[tuple[int, str], int]:
    """How many n-grams of each (order, language) of ``sizes`` the tables have room for: a language's share of ``most`` is
    dealt out evenly from the lowest order up, and what an order does not need goes to the higher ones. 1000 at least."""
    langs = {lang for _, lang in sizes}
    out = {}
    for lang in langs:
        left = most // len(langs)
        for k in range(1, ORDER + 1):
            out[k, lang] = max(1000, left // (ORDER + 1 - k))
            left = max(0, left - min(out[k, lang], sizes.get((k, lang), 0)))
    return out


def most_frequent(rows: DataFrame, most: int | dict[tuple, int], group: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The rows of ``rows`` (group, gram, n) with the highest counts, some ``most`` of each group (by group, if a dict).

    A histogram of the counts, exact up to 64 and then in sixteenths of a power of two, tells from which bin on a
    group's rows are too many; rows of just that bin are kept by their hash, in the share that there is room for.
    No group's rows are ranked in one task, and the histogram, some thousand rows a group at most, is cut on the driver.
    """
    place = F.when(F.col("n") <= 64, F.col("n").cast("long")).otherwise(65 + F.floor(F.log2(F.col("n") / 64.0) * 16))
    sizes = rows.groupBy(*group, place.alias("bin")).agg(F.count("*").alias("k_rows")).toPandas()
    cuts = []
    for at, own in sizes.sort_values("bin", ascending=False).groupby(list(group), sort=False):
        upto = own["k_rows"].cumsum()
        limit = most[at] if isinstance(most, dict) else most
        over = own[upto > limit]
        if len(over):
            first = over.iloc[0]
            cuts.append((*(v.item() if isinstance(v, np.generic) else v for v in at), int(first["bin"]), float((limit - (upto[over.index[0]] - first["k_rows"])) / first["k_rows"])))
    if not cuts:
        return rows
    kinds = ", ".join(f"_{c} {rows.schema[c].dataType.simpleString()}" for c in group)
    cut = F.broadcast(rows.sparkSession.createDataFrame(cuts, f"{kinds}, _bin long, _share double"))  # a row per group
    same = [F.col(c) == F.col(f"_{c}") for c in group]
    kept = F.col("_bin").isNull() | (place > F.col("_bin")) | ((place == F.col("_bin")) & (fraction(F.xxhash64("gram")) < F.col("_share")))
    return rows.join(cut, same, "left").where(kept).select(*rows.columns)


@dataclass(frozen=True)
class Model:
    """``tail``, if there are more n-grams than the tables keep: (kind, k, x, vector), the shares by language of all n-grams
    (kind 0) and what all contexts leave (kind 1); then ``open`` is a filter of those that the tables lack.

    One table per order: the hashes of the n-grams kept, ascending, with their discounted shares by language (0: not
    kept there), and the hashes of their contexts with what those leave to the lower order (1: nothing kept). The last
    row of either stands for what a table does not hold."""

    langs: list[str]
    hashes: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    rest: list[np.ndarray]
    limits: np.ndarray
    tail: DataFrame | None = None
    open: np.ndarray | None = None

    def unsettled(self, keys: np.ndarray) -> np.ndarray:
        """Whether an n-gram or context of each key may be one that the tables lack."""
        out = np.zeros(len(keys), bool)
        for kind, k, x in _parts(keys) if self.open is not None else ():
            at = _place(kind, k, x, len(self.open) * 8)
            out |= (self.open[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def table(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities (keys by language) of each key's last character after those before it: each order adds its
        share to what it leaves of the order below, from the uniform share of all characters up."""
        p = np.full((len(keys), len(self.langs)), 1.0 / (1 << 16))
        for n in range(1, ORDER + 1):
            part = keys & np.uint64((1 << 16 * n) - 1) if n < 4 else keys
            p *= self.rest[n - 1][_find(self.contexts[n - 1], (part >> np.uint64(16)) * MIX)] if n > 1 else self.rest[0][:1]
            p += self.shares[n - 1][_find(self.hashes[n - 1], part * MIX)]
        return np.log(p)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """(log probabilities added up by text and language, characters by text, (text, key, n): the keys left out of these
        sums, as they may need the tail)."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        left = [pd.DataFrame({"text": np.empty(0, np.int64), "key": np.empty(0, np.int64), "n": np.empty(0, np.int64)})]
        for keys, owner in _pieces([t or "" for t in texts]):
            codes, seen = pd.factorize(keys)
            logs = self.table(seen)
            if (away := self.unsettled(seen)).any():
                logs[away] = 0.0
                at = np.flatnonzero(away[codes])
                left.append(pd.DataFrame({"text": owner[at].astype(np.int64), "key": keys[at].view(np.int64)}).value_counts().rename("n").reset_index())
            logs = logs[codes]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            total[owner[starts]] += np.add.reduceat(logs, starts, axis=0)
            count[owner[starts]] += np.diff(np.concatenate((starts, [len(owner)])))
        return total, count, pd.concat(left, ignore_index=True)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropies in nats a character by text and language, characters scored by text), from the tables alone."""
        total, count, _ = replace(self, open=None).sums(texts)
        return -total / np.maximum(count, 1)[:, None], count

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy, rejected of each text."""
        if not self.langs:
            return pd.DataFrame({"lang_pred": UND, "score": 0.0, "cross_entropy": np.nan, "rejected": True}, index=range(len(texts)))
        return self.decided(*self.score(texts))

    def decided(self, cross: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        none = n == 0
        best = cross.argmin(1)
        low = cross[np.arange(len(best)), best]
        gap = (low[:, None] - cross) * np.minimum(n, 64)[:, None]
        score = 1 / np.exp(gap).sum(1)
        rejected = none | (low > self.limits[best] + SLACK / np.sqrt(np.maximum(n, 1)))
        pred = np.where(none, UND, np.array(self.langs, object)[best])
        return pd.DataFrame({"lang_pred": pred, "score": np.where(none, 0.0, score), "cross_entropy": np.where(none, np.nan, low), "rejected": rejected})


#: Added to the rejection limit over the root of the number of characters: short texts scatter.
SLACK = 10.0


def _parts(keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(kind, k, x): the n-grams (kind 0) and contexts (kind 1) of each order of the keys."""
    for k in range(1, ORDER + 1):
        part = keys & np.uint64((1 << 16 * k) - 1)
        yield 0, k, part
        if k > 1:
            yield 1, k, part >> np.uint64(16)


def _place(kind, k, x: np.ndarray, bits: int) -> np.ndarray:
    """Places in a filter of ``bits`` bits, a power of two."""
    h = (x + np.uint64(2) * np.asarray(k).astype(np.uint64) + np.asarray(kind).astype(np.uint64)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _find(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in a sorted table; its length for what it does not hold."""
    if not len(table):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, len(table))


def assembled(kept: pd.DataFrame, langs: list[str], taken: pd.DataFrame | None = None) -> Model:
    """The model of ``kept`` (k, lang, gram, alpha): a context leaves to the lower order what its kept n-grams do not take,
    so each context's probabilities add up to 1 whatever was pruned. With ``taken`` (k, lang, context, alpha) it leaves
    what is not taken there."""
    hashes, shares, contexts, rest = [], [], [], []
    column = {lang: i for i, lang in enumerate(langs)}
    for n in range(1, ORDER + 1):
        own = kept[kept["k"] == n]
        keys, lang = own["gram"].to_numpy(np.int64).view(np.uint64), own["lang"].map(column).to_numpy(int)
        for at, tables, values, fill in ((keys, hashes, shares, 0.0), (keys >> np.uint64(16) if n > 1 else keys * np.uint64(0), contexts, rest, 1.0)):
            seen, place = np.unique(at * MIX, return_inverse=True)
            sums, by, alpha = np.zeros((len(seen), len(langs))), lang, own["alpha"].to_numpy(float)
            if taken is not None and fill == 1.0:
                of = taken[taken["k"] == n]
                place = _find(seen, of["context"].to_numpy(np.int64).view(np.uint64) * MIX)
                by, alpha = of["lang"].map(column).to_numpy(int)[place < len(seen)], of["alpha"].to_numpy(float)[place < len(seen)]
                place = place[place < len(seen)]
            np.add.at(sums, (place, by), alpha)
            tables.append(seen)
            values.append(np.vstack([sums if fill == 0.0 else np.maximum(1.0 - sums, 1e-12), np.full(len(langs), fill)]).astype(np.float32))
    return Model(langs, hashes, shares, contexts, rest, np.full(len(langs), np.inf))


#: Bits of the filter of a tail; with more n-grams in that, more keys are looked up in vain, and none is missed.
OPEN_BITS = 1 << 25


def tailed(grams: DataFrame, chosen: DataFrame, langs: list[str]) -> Model:
    """The model of all ``grams`` (k, lang, gram, alpha), whose tables keep those in ``chosen`` and their contexts."""
    context = F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned("gram", 16)).alias("context")
    keys = checkpointed(chosen.select("k", "gram").distinct())
    around = checkpointed(keys.select("k", context).distinct())
    taken = checkpointed(grams.select("k", "lang", context, "alpha").groupBy("k", "lang", "context").agg(F.sum("alpha").alias("alpha")))
    model = assembled(grams.join(keys, ["k", "gram"], "left_semi").select("k", "lang", "gram", "alpha").toPandas(), langs, taken.join(around, ["k", "context"], "left_semi").toPandas())
    by_lang = lambda fill: F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("v"))), F.lit(fill)) for x in langs]).alias("vector")
    shares = grams.select(F.lit(0).alias("kind"), "k", F.col("gram").alias("x"), "lang", F.col("alpha").alias("v")).groupBy("kind", "k", "x").agg(by_lang(0.0))
    leaves = taken.select(F.lit(1).alias("kind"), "k", F.col("context").alias("x"), "lang", F.greatest(1 - F.col("alpha"), F.lit(1e-12)).alias("v")).groupBy("kind", "k", "x").agg(by_lang(1.0))
    tail = checkpointed(shares.union(leaves))
    lacking = grams.join(keys, ["k", "gram"], "left_anti").select(F.lit(0).alias("kind"), "k", F.col("gram").alias("x"))
    lacking = lacking.union(taken.where("k > 1").join(around, ["k", "context"], "left_anti").select(F.lit(1), "k", "context"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = _place(b["kind"].to_numpy(), b["k"].to_numpy(), b["x"].to_numpy(np.int64).view(np.uint64), OPEN_BITS)
            yield pd.DataFrame({"block": at >> 13, "p": at & 8191})

    marks = np.zeros(OPEN_BITS // 8, np.uint8)
    for r in lacking.mapInPandas(places, "block long, p int").groupBy("block").agg(F.collect_set("p").alias("p")).toLocalIterator():  # OPEN_BITS / 8192 rows
        p = np.array(r["p"], np.int64) + r["block"] * 8192
        np.bitwise_or.at(marks, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
    return replace(model, tail=tail, open=marks)


def summed(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(_row, total, n): the columns ``keep`` of ``docs``, the log probabilities of its texts added up by language, characters.

    Keys that the model's tables settle are added up where the text is. The others, with how often each occurs in a text,
    are dealt out; each distinct one is looked up in the tail once, by a join, and its logs are added to its texts' sums.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tail=None))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            total, n, left = shared.value.sums(texts.tolist())
            own = left.groupby("text")
            at = {i: (g["key"].to_numpy(), g["n"].to_numpy()) for i, g in own}
            none = np.empty(0, np.int64)
            yield pd.DataFrame({"total": list(total), "n": n, "keys": [at.get(i, (none, none))[0] for i in range(len(n))], "times": [at.get(i, (none, none))[1] for i in range(len(n))]})

    sums = F.pandas_udf(run, "total array<double>, n long, keys array<long>, times array<long>").asNondeterministic()
    rows = text_batches(docs).select(F.struct(*keep).alias("_row"), sums(F.col("text").cast("string")).alias("_s"))
    rows = checkpointed(rows.select(F.monotonically_increasing_id().alias("_id"), "_row", "_s.*"))
    left = rows.select("_id", F.explode(F.arrays_zip("keys", "times")).alias("z")).select("_id", F.col("z.keys").alias("key"), F.col("z.times").alias("times"))
    part = {k: F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else F.col("key") for k in range(1, ORDER + 1)}
    of = [(0, k, part[k]) for k in part] + [(1, k, F.shiftrightunsigned(part[k], 16) if k > 1 else F.lit(0).cast("long")) for k in part]
    asked = left.select("key").distinct().select("key", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), x.alias("x")) for kind, k, x in of])).alias("a")).select("key", "a.*")
    found = asked.join(model.tail, ["kind", "k", "x"], "left").groupBy("key").agg(*[F.max(F.when((F.col("kind") == kind) & (F.col("k") == k), F.col("vector"))).alias(f"v{kind}{k}") for kind, k, _ in of])
    logs = []
    for i in range(len(model.langs)):
        p = F.lit(1.0 / (1 << 16))
        for k in part:
            p = p * F.coalesce(F.col(f"v1{k}")[i], F.lit(1.0)) + F.coalesce(F.col(f"v0{k}")[i], F.lit(0.0))
        logs.append(F.log(p).alias(f"l{i}"))
    found = found.select("key", *logs)
    more = left.join(found, "key").groupBy("_id").agg(F.array(*[F.sum(F.col("times") * F.col(f"l{i}")) for i in range(len(logs))]).alias("more")).withColumnRenamed("_id", "_i")
    total = F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda x, y: x + y))
    return rows.join(more, F.col("_id") == F.col("_i"), "left").select("_row", total.alias("total"), "n")


#: A language's limit is this quantile of the cross-entropies of its rows, three tenths more, and 0.3.
QUANTILE, MARGIN = 0.99, (1.3, 0.3)


def left_out(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` (doc_id, text, lang) with ``_left``: whether a row is for calibration; some ``rows`` of each language, a fifth
    of its rows at most, by the hash of id and text."""
    sizes = docs.groupBy(F.col("lang").alias("_l")).agg(F.least(F.lit(0.2), F.lit(float(rows)) / F.count("*")).alias("_share"))
    h = fraction(F.xxhash64("doc_id", "text", F.lit("left out")))
    return docs.join(F.broadcast(sizes), docs["lang"] == sizes["_l"]).withColumn("_left", h < F.col("_share")).drop("_l", "_share")  # a row per language


def _crossed(total: pd.Series, n: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    n = n.to_numpy(np.int64)
    return -np.stack(total.tolist()) / np.maximum(n, 1)[:, None], n


def calibrated(left: DataFrame, model: Model) -> Model:
    """``model`` with the rejection limits of its languages from the rows ``left`` (text, lang). Each row's own cross-entropy,
    less what short texts scatter by, is computed where the row is; a language without rows has the highest limit."""
    shared = left.sparkSession.sparkContext.broadcast(replace(model, tail=None))
    whole = model.tail is not None
    first = "total" if whole else "text"

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, langs, n in batches:
            cross, n = _crossed(texts, n) if whole else shared.value.score(texts.tolist())
            own = cross[np.arange(len(langs)), [shared.value.langs.index(x) if x in shared.value.langs else 0 for x in langs]]
            yield pd.Series(np.where((n > 0) & langs.isin(shared.value.langs).to_numpy(), own - SLACK / np.sqrt(np.maximum(n, 1)), np.nan))

    own = F.pandas_udf(run, "double")
    rows = summed(left, model, ["lang"]).select("_row.lang", "total", "n") if whole else text_batches(left).withColumn("n", F.lit(0))
    found = rows.select("lang", own(first, "lang", "n").alias("e")).where(~F.isnan("e")).groupBy("lang").agg(F.percentile_approx("e", QUANTILE, 10000).alias("q")).collect()
    limits = {r["lang"]: MARGIN[0] * max(r["q"], 0.0) + MARGIN[1] for r in found}
    most = max(limits.values(), default=np.inf)
    return replace(model, limits=np.array([limits.get(x, most) for x in model.langs]))


#: Entries of a model, over all languages and orders: some 25 bytes each and 4 a language.
MAX_GRAMS = 400_000


def fit(docs: DataFrame, max_grams: int = MAX_GRAMS, calibration_rows: int | None = None) -> Model:
    """A model of each language of ``docs`` (doc_id, text, lang).

    All rows are counted, and each language's rejection limit comes from the cross-entropies of all its rows. With
    ``calibration_rows`` some so many of each language (a fifth at most) are left out of the counts and give its limit.
    Counts of all orders, discounts and shares are Spark jobs over all n-grams; of their result, each
    language's and order's most frequent n-grams reach the driver, ``max_grams`` of all together (1000 of each at
    least), which bounds the tables whatever the corpus. The others stay in Spark as the model's tail, where ``predict``
    looks them up, so all n-grams count. Rows with a
    null text or lang are left out; rows that repeat id and text are for calibration together or not at all;
    without any row the model has no language.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counting = judging = docs
    if calibration_rows is not None:
        marked = left_out(docs, calibration_rows)
        counting, judging = marked.where("NOT _left"), marked.where("_left")
    counted, _ = settled(gram_counts(counting))
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    every, _ = settled(levels(counted))  # used three times
    grams, _ = settled(weighed(every))
    sizes = {(r["k"], r["lang"]): r["count"] for r in grams.groupBy("k", "lang").count().collect()}  # a row per order and language
    chosen = most_frequent(grams, room(sizes, max_grams), ("k", "lang"))
    model = assembled(grams.select("k", "lang", "gram", "alpha").toPandas(), langs) if chosen is grams else tailed(grams, chosen, langs)
    return calibrated(judging.select("text", "lang"), model) if langs else model


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score, cross_entropy, rejected of its whole texts.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, tail=None))  # max_grams n-grams at most
    kinds = "lang_pred string, score double, cross_entropy double, rejected boolean"
    if model.tail is not None:

        def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for total, n in batches:
                yield shared.value.decided(*_crossed(total, n))

        judged = summed(docs, model, keep).select("_row", F.pandas_udf(decide, kinds).asNondeterministic()("total", "n").alias("_j"))
        return judged.select(*[F.col("_row")[k].alias(k) for k in keep], "_j.*")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.judge(texts.tolist())

    judge = F.pandas_udf(run, kinds).asNondeterministic()  # else a filter on its result runs it again
    rows = text_batches(docs).select(F.struct(*keep).alias("_row"), judge(F.col("text").cast("string")).alias("_j"))
    return rows.select(*[F.col("_row")[k].alias(k) for k in keep], "_j.lang_pred", "_j.score", "_j.cross_entropy", "_j.rejected")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
