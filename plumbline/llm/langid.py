"""Language identification with interpolated Kneser-Ney character models.

A text is lowered and read as symbols: a-z have one each, every other letter is
hashed to one of 37 more (any 37 neighbouring code points differ), and a run of
anything else is one boundary. A symbol takes six bits, so a 4-gram hashes to
24 bits and lower orders to 18 and fewer: the tables of one language hold at
most 2**24 entries at any size of corpus, and the model may be broadcast.

Training counts the 4-grams of all labelled training rows: tasks count their own
rows, the counts are summed by (language, hash) with map-side combining, and the
sums, bounded as said, make one interpolated model with absolute discounting for
each language. Lower orders use continuation counts. The 4-grams are kept as one
sorted hash array, each with an entry for every language that has seen it, so the
model grows with the 4-grams that languages really have; a language that has not
seen one backs off through dense tables of contexts and 3-grams, 2 MB a language.

The language of the least length-normalised cross-entropy is chosen. All labelled
training rows fit the temperature of the score and each language's rejection threshold:
losses are summed as whole numbers and quantiles are exact, found by counts of ever
longer prefixes of the values, so that no rows are collected and any order of them gives
the same model. Only who asks for ``calibration_rows`` gets a sample of so many rows,
those of the least hashes of id and text.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected; ties go to the language first in sorting order; repeated rows are
scored once each; without labelled rows everything is ``und``; an empty table
yields no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, dropped, kept, pairs, written

BITS, ORDER = 6, 4
SYMBOLS = 1 << BITS
LOW = (1 << BITS * (ORDER - 1)) - 1
UNKNOWN = "und"
#: Temperatures that are tried, and the unit in which losses are summed.
TEMPERATURES = [2.0**-k for k in range(8)]
LOSS_UNIT = 1 << 24
#: Bits below the prefixes by which a quantile is found, one after the other.
SHIFTS = (52, 40, 28, 16, 4, 0)
#: Codes that a task gathers before it counts them.
BUFFER = 4 << 20
#: Codes that are scored at once.
BLOCK = 1 << 13
#: Symbols beyond which a longer text gives no more confidence.
CONFIDENT = 64

COUNTS = "lang string, code long, n long"
SCHEMA = "doc_id {id}, lang_pred string, score double, cross_entropy double, n_symbols long, rejected boolean"


def _alphabet() -> np.ndarray:
    found = np.zeros(1 << 16, np.uint8)
    for point in range(1 << 16):
        if chr(point).isalpha():
            found[point] = point - 96 if 97 <= point <= 122 else 27 + point % 37
    return found


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The text's symbols; boundaries are 0 and never stand beside each other."""
    if not _TABLE:
        _TABLE.append(_alphabet())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() > 0xFFFF:
        # ideographs of the higher planes are letters, the rest there (pictures, historic scripts) a boundary
        found = np.where(points > 0xFFFF, np.where((points >= 0x20000) & (points < 0x40000), 27 + points % 37, 0), _TABLE[0][points & 0xFFFF]).astype(np.uint8)
    else:
        found = _TABLE[0][points]
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep] if len(found) else found


def codes(text: str) -> np.ndarray:
    """The 24-bit hash of the 4-gram that ends at each symbol, and of one that ends the text."""
    own = symbols(text)
    if not own.any():
        return np.empty(0, np.uint32)
    own = own[1:] if own[0] == 0 else own
    own = own[:-1] if own[-1] == 0 else own
    s = np.zeros(len(own) + ORDER, np.uint32)
    s[ORDER - 1 : -1] = own
    found = s[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        found |= s[ORDER - 1 - back : len(s) - back] << np.uint32(BITS * back)
    return found


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    raw: dict[str, list[np.ndarray]] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    load = 0

    def settle() -> None:
        for lang, parts in raw.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in sums:
                old, m = sums[lang]
                keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([m, n]).astype(np.float64)).astype(np.int64)
            sums[lang] = keys, n
        raw.clear()

    for lang, text in pairs(stream):
        own = codes(text or "")
        raw.setdefault(lang, []).append(own)
        load += len(own)
        if load >= BUFFER:
            settle()
            load = 0
    settle()
    for lang, (keys, n) in sums.items():
        yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


@dataclass
class Model:
    """Log2 probabilities: dense columns for each language below the highest order, sparse entries in it."""

    langs: list[str]
    keys: np.ndarray  # sorted 4-gram hashes that any language has seen
    first: np.ndarray  # where the entries of each key begin, and their number at the end
    of: np.ndarray  # of each entry, the language
    gain: np.ndarray  # of each entry, the interpolated log2 probability less that of backing off
    backoff: np.ndarray  # of every 3-gram context, the log2 weight of the lower order
    lower: np.ndarray  # of every 3-gram, the log2 probability
    temperature: float = 1.0
    thresholds: np.ndarray | None = None

    def entropies(self, own: np.ndarray) -> np.ndarray:
        """Bits a symbol under each language."""
        total = np.zeros(len(self.langs))
        # in order, so that neighbouring codes are found near each other
        own = np.sort(own)
        for at in range(0, len(own), BLOCK):
            block = own[at : at + BLOCK]
            ones = np.ones(len(block))
            # products with ones are sums, several times faster than sums of so few columns
            total += ones @ np.take(self.backoff, block >> BITS, axis=0).astype(np.float64)
            total += ones @ np.take(self.lower, block & LOW, axis=0).astype(np.float64)
            place = np.searchsorted(self.keys, block)
            place[place == len(self.keys)] = 0
            place = place[self.keys[place] == block]
            start = self.first[place]
            n = self.first[place + 1] - start
            # the entries of all keys, one after the other
            ends = np.cumsum(n)
            entries = np.repeat(start + n - ends, n) + np.arange(ends[-1] if len(ends) else 0)
            total += np.bincount(self.of[entries], self.gain[entries], len(self.langs))
        return -total / len(own)

    def predict(self, text: str | None) -> tuple[str, float, float | None, int, bool]:
        """(language, score, bits a symbol, symbols, rejected)."""
        own = codes(text or "")
        if not len(own):
            # letters outside the tables: no evidence for any language, though the text has letters
            if self.langs and any(c.isalpha() for c in text or ""):
                return self.langs[0], 1 / len(self.langs), None, 0, True
            return UNKNOWN, 0.0, None, 0, True
        if not self.langs:
            return UNKNOWN, 0.0, None, len(own), True
        bits = self.entropies(own)
        best = int(np.argmin(bits))
        score = 1 / float(np.exp2(-(bits - bits[best]) * min(len(own), CONFIDENT) * self.temperature).sum())
        rejected = self.thresholds is not None and bits[best] > self.thresholds[best] + allowance(len(own))
        return self.langs[best], score, float(bits[best]), len(own), bool(rejected)


def allowance(n: int) -> float:
    """Bits a symbol by which a text of n symbols may exceed the threshold by chance: four deviations of three bits."""
    return 12 / math.sqrt(n)


def _discounted(keys: np.ndarray, n: np.ndarray, lower: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each key, weight of the lower order in each context) by absolute discounting."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones and twos else 0.5
    context = (keys >> BITS).astype(np.int64)
    total = np.bincount(context, n, contexts)
    kinds = np.bincount(context, minlength=contexts)
    weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return (n - discount) / total[context] + weight[context] * lower[keys & ((contexts << BITS) - 1) & (len(lower) - 1)], weight


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each 4-gram, backoff weight of each context, probability of every 3-gram) of one language."""
    chain = [(keys, n.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        lower, kinds = np.unique(chain[-1][0] & np.uint32((1 << BITS * order) - 1), return_counts=True)
        chain.append((lower, kinds.astype(np.float64)))
    dense = np.full(1, 1 / SYMBOLS)
    for order, (own, kinds) in enumerate(reversed(chain), 1):
        contexts = 1 << BITS * (order - 1)
        p, weight = _discounted(own, kinds, dense if order > 1 else np.full(SYMBOLS, 1 / SYMBOLS), contexts)
        if order == ORDER:
            return p, weight, dense
        every = np.arange(contexts << BITS)
        filled = weight[every >> BITS] * (dense[every & (len(dense) - 1)] if order > 1 else 1 / SYMBOLS)
        filled[own] = p
        dense = filled
    raise AssertionError


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of sorted (4-gram hashes, counts) by language."""
    langs = sorted(counts)
    backoff, lower = (np.zeros((LOW + 1, len(langs)), np.float32) for _ in range(2))
    codes_of, gains = [np.empty(0, np.uint32)], [np.empty(0, np.float32)]
    for at, lang in enumerate(langs):
        own = counts[lang][0]
        p, weight, dense = kneser_ney(*counts[lang])
        backoff[:, at], lower[:, at] = np.log2(weight), np.log2(dense)
        codes_of.append(own)
        gains.append((np.log2(p) - backoff[own >> BITS, at] - lower[own & LOW, at]).astype(np.float32))
    of = np.repeat(np.arange(-1, len(langs)), [len(c) for c in codes_of]).astype(np.int16)
    every, gain = np.concatenate(codes_of), np.concatenate(gains)
    order = np.argsort(every, kind="stable")
    keys, first = np.unique(every[order], return_index=True)
    if not len(keys):
        keys, first = np.zeros(1, np.uint32), np.zeros(1, np.int64)
    return Model(langs, keys, np.append(first, len(every)).astype(np.int64), of[order], gain[order], backoff, lower)


MEASURED = "lang string, h long, t long, n long, bits array<double>"


def measurer(shared):
    """The rows (language, text, h, t) with symbols and bits a symbol under each language in place of the text."""
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("bits", pa.list_(pa.float64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def rows() -> Iterator[tuple]:
            for batch in stream:
                for i in range(batch.num_rows):
                    lang, text, h, t = (batch.column(c)[i].as_py() for c in range(4))
                    own = codes(text or "")
                    if len(own):
                        yield lang, h, t, len(own), model.entropies(own).tolist()

        yield from batches(rows(), schema)

    return run


def _losses(bits: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log loss of every row (of bits a symbol under each language) at each temperature."""
    b = (bits - bits.min(1)[:, None]) * np.minimum(lengths, CONFIDENT)[:, None] * math.log(2)
    return np.array([np.log(np.exp(-b * t).sum(1)) + (b * t)[np.arange(len(own)), own] for t in TEMPERATURES])


def _set(model: Model, losses: list, everywhere: float, each: list[float | None], slack: float) -> None:
    model.temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: losses[k])]
    model.thresholds = np.array([everywhere if x is None else max(x, everywhere) for x in each]) + slack


def calibrate(model: Model, rows: list[tuple[str, int, list[float]]], quantile: float = 0.999, slack: float = 0.5) -> None:
    """Fit the temperature by log loss, and each language's threshold as a high quantile plus ``slack`` bits.

    ``rows``: language, symbols, bits a symbol under each language.
    """
    if not rows:
        return
    langs, lengths, bits = zip(*rows, strict=True)
    b, t = np.array(bits), np.array([model.langs.index(x) for x in langs])
    best = b.min(1)
    each = [np.quantile(best[t == i], quantile) if (t == i).any() else None for i in range(len(model.langs))]
    _set(model, _losses(b, np.array(lengths), t).mean(1).tolist(), np.quantile(best, quantile), each, slack)


def _ordered(value: float) -> int:
    """A signed 64-bit number in the order of the values; its own inverse but for the type."""
    bits = int(np.float64(value).view(np.int64))
    return bits ^ (0x7FFFFFFFFFFFFFFF if bits < 0 else 0)


def _value(key: int) -> float:
    return float(np.int64(key ^ (0x7FFFFFFFFFFFFFFF if key < 0 else 0)).view(np.float64))


SURVEYED = "lang string, key long, losses array<long>"


def surveyor(shared):
    """Of rows (language, text), the least bits a symbol as a key in order; one row more a batch has its losses' sums."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("losses", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {lang: at for at, lang in enumerate(model.langs)}

        def rows() -> Iterator[tuple]:
            for batch in stream:
                sums = np.zeros(len(TEMPERATURES), np.int64)
                for lang, text in pairs(iter([batch])):
                    own = codes(text or "")
                    if len(own):
                        bits = model.entropies(own)
                        sums += np.rint(_losses(bits[None], np.array([len(own)]), np.array([place[lang]]))[:, 0] * LOSS_UNIT).astype(np.int64)
                        yield lang, _ordered(bits.min()), None
                yield None, None, sums.tolist()

        yield from batches(rows(), schema)

    return run


def quantiles(values: DataFrame, quantile: float) -> dict[str | None, float]:
    """The exact quantile of the keys of each language, and of all under None; ``values``: (lang, key)."""
    both = values.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), "key")
    sizes = {r.lang: r.n for r in both.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spots = {lang: quantile * (n - 1) for lang, n in sizes.items()}
    # of each wanted value, the prefix so far and its rank among the values that have it
    wanted = {(lang, side): (0, min(math.floor(at) + side, sizes[lang] - 1)) for lang, at in spots.items() for side in (0, 1)}
    last = None
    for shift in SHIFTS if wanted else ():
        inside = both.withColumn("prefix", F.lit(0).cast("long") if last is None else F.shiftright("key", last))
        asked = values.sparkSession.createDataFrame(sorted({(lang, w[0]) for (lang, _), w in wanted.items()}, key=repr), "own string, at long")
        inside = inside.join(F.broadcast(asked), F.col("lang").eqNullSafe(F.col("own")) & (F.col("prefix") == F.col("at")))
        bins: dict[tuple, list] = {}
        for r in inside.groupBy("lang", "prefix", F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("n")).collect():
            bins.setdefault((r.lang, r.prefix), []).append((r.bin, r.n))
        for (lang, side), (prefix, rank) in wanted.items():
            for bin, n in sorted(bins[lang, prefix]):
                if rank < n:
                    wanted[lang, side] = bin, rank
                    break
                rank -= n
        last = shift
    return {lang: float(np.quantile([_value(wanted[lang, side][0]) for side in (0, 1)], at - math.floor(at))) for lang, at in spots.items()}


def calibrate_whole(model: Model, labelled: DataFrame, quantile: float = 0.999, slack: float = 0.5) -> None:
    """As ``calibrate``, over all rows (language, text) of a table, of which none is collected."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    surveyed = written(labelled.mapInArrow(surveyor(shared), SURVEYED), "surveyed")
    shared.unpersist()
    found = quantiles(surveyed.where("lang is not null").select("lang", "key"), quantile)
    if found:
        sums = surveyed.where("lang is null").select(F.posexplode("losses").alias("at", "loss")).groupBy("at").agg(F.sum(F.col("loss").cast("decimal(38,0)")).alias("loss"))
        _set(model, [r.loss for r in sums.orderBy("at").collect()], found[None], [found.get(lang) for lang in model.langs], slack)
    dropped(surveyed)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration_rows: int | None = None) -> Model:
    """Count all rows that have a language and calibrate on all of them, or on at most ``calibration_rows`` if that is given."""
    labelled = docs.where(F.col(lang_col).isNotNull())
    counted = labelled.select(lang_col, text_col).mapInArrow(_count, COUNTS).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = table["lang"].to_pandas().astype("category")
    keys, n = table["code"].to_numpy().astype(np.uint32), table["n"].to_numpy()
    counts = {}
    for at, lang in enumerate(names.cat.categories):
        own = np.flatnonzero(names.cat.codes.to_numpy() == at)
        own = own[np.argsort(keys[own])]
        counts[lang] = keys[own], n[own]
    model = build(counts)
    if calibration_rows is None:
        calibrate_whole(model, labelled.select(lang_col, text_col))
        return model
    # the least hashes of id, then of text: rows that are equal in both are alike, so the limit is strict
    h, t = F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text_col, lang_col).alias("t")
    order = F.struct(h, t)
    last = labelled.select(order.alias("o")).orderBy("o").limit(calibration_rows).agg(F.max("o")).first()[0]
    if last is not None:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        bound = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["t"]).alias("t"))
        rows = labelled.where(order <= bound).select(lang_col, text_col, h, t).mapInArrow(measurer(shared), MEASURED)
        calibrate(model, [(r.lang, r.n, r.bits) for r in rows.orderBy("h", "t").limit(calibration_rows).collect()])
        shared.unpersist()
    return model


def predictor(shared, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("n_symbols", pa.int64()), ("rejected", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        yield from batches(((doc, *model.predict(text)) for doc, text in pairs(stream)), schema)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, score and rejection of every whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(id_col, text_col).mapInArrow(predictor(shared, to_arrow_type(kind)), SCHEMA.format(id=kind.simpleString()))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language that is not rejected, with all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        own = shared.value
        return lambda text: not own.predict(text)[4]

    return kept(docs, text_col, judge)
