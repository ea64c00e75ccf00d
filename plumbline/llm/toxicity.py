"""Toxic spans by a linear-chain conditional random field over words.

Fitting takes a bounded sample of labelled documents: at most ``sample_rows`` ids
of each class, those of the least hashes, so that the ids may be broadcast, and one
text of each id, the least if it has several. Over the sample, words and their prefixes of three to six letters are
counted by class; those that a likelihood-ratio test finds bound to toxic
documents, at ``least_lift`` times the rate of clean ones, are the features, at
most ``max_features`` of them. A word of a toxic document is
labelled toxic if one of its features occurs in toxic documents at least
``purity`` of the time, any other word clean. A chain with two states is fitted
to these labelled tokens by maximum likelihood; gradients are marginals of the
forward-backward algorithm.

A word without a feature is neutral, and all neutral words have the same
potentials. A run of g of them is therefore the g-th power of one two-by-two
matrix, which has a closed form: forward-backward visits the other words alone
and still gives the exact marginals of the whole text, of any length.

A document's evidence is the log odds that at least one of its words is toxic
and the expected number of toxic words; logistic regression on sample documents
that the chain was not fitted to turns it into the score.

Defined results: null and empty texts have no evidence and get the score of a
document without any; repeated rows are scored once each; labels that are null
are ignored and a document labelled twice counts as toxic if one label says so;
without labelled rows of both classes there are no features and every score is
the share of toxic labels (0 if there are none); an empty table yields no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, dropped, pairs, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Tokens of a training sequence.
SEGMENT = 64
#: Training sequences whose expectations are computed at once.
AT_ONCE = 1024
#: One in so many training sequences without features is used, with that weight.
THIN = 16
#: Words and counts that a worker keeps before it hands them on or forgets them.
MEMORY = 300_000

SCHEMA = "doc_id {id}, score double, expected_toxic double, n_words long, spans array<struct<start:long,end:long,marginal:double>>"


def names(word: str) -> list[str]:
    """The features of a word: the word itself and its proper prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIXES if n < len(word))]


def _word_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, clean documents, toxic documents) of the rows (toxic, text)."""
    schema = pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())])
    found = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list(found[0].keys() | found[1].keys())
        batch = pa.record_batch([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], schema=schema)
        for counts in found:
            counts.clear()
        return batch

    for toxic, text in pairs(stream):
        found[toxic].update(set(WORD.findall((text or "").lower())))
        if len(found[0]) + len(found[1]) > MEMORY:
            yield flush()
    if found[0] or found[1]:
        yield flush()


@dataclass
class Model:
    features: dict[str, int] = field(default_factory=dict)
    seeds: set[int] = field(default_factory=set)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -5.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def prepare(self) -> None:
        """The closed form of powers of the neutral step, and the memory of words."""
        self.words: dict[str, tuple[int, ...] | None] = {}
        step = np.exp(self.transitions) * np.exp([0.0, self.bias])
        mean, half = (step[0, 0] + step[1, 1]) / 2, (step[0, 0] - step[1, 1]) / 2
        root = math.sqrt(half * half + step[0, 1] * step[1, 0])
        top, low = mean + root, mean - root
        first = (step - low * np.eye(2)) / (top - low)
        self.first, self.second, self.ratio = first, np.eye(2) - first, low / top

    def run(self, n: int) -> np.ndarray:
        """The n-th power of the neutral step, divided by the n-th power of its larger eigenvalue."""
        return self.first + self.second * self.ratio**n

    def lookup(self, word: str) -> tuple[int, ...] | None:
        if len(self.words) >= MEMORY:
            self.words.clear()
        found = tuple(self.features[x] for x in names(word) if x in self.features) or None
        self.words[word] = found
        return found

    def tokens(self, text: str) -> tuple[int, list[int], list[tuple[int, ...]]]:
        """(words, places of words with features, their features)."""
        known, lookup = self.words, self.lookup
        words = WORD.findall(text.lower())
        places, features = [], []
        for i, word in enumerate(words):
            found = known[word] if word in known else lookup(word)
            if found is not None:
                places.append(i)
                features.append(found)
        return len(words), places, features

    def marginals(self, n: int, places: list[int], features: list[tuple[int, ...]]) -> list[float]:
        """Probability of the toxic state at each place, given the whole text of n words."""
        if not places:
            return []
        trans = np.exp(self.transitions)
        emit = [np.array([1.0, math.exp(min(self.bias + self.weights[list(f)].sum(), 50.0))]) for f in features]
        neutral = np.array([1.0, math.exp(self.bias)])
        forward, last = [], -1
        state = None
        for place, own in zip(places, emit, strict=True):
            if state is None:
                state = own if place == 0 else (neutral @ self.run(place - 1)) @ trans * own
            else:
                state = state @ self.run(place - last - 1) @ trans * own
            state = state / state.sum()
            forward.append(state)
            last = place
        back = self.run(n - 1 - places[-1]) @ np.ones(2)
        found = [0.0] * len(places)
        for j in range(len(places) - 1, -1, -1):
            both = forward[j] * back
            found[j] = float(both[1] / both.sum())
            if j:
                back = self.run(places[j] - places[j - 1] - 1) @ trans @ (emit[j] * back)
                back = back / back.sum()
        return found

    def evidence(self, marginals: list[float]) -> tuple[float, float]:
        """(log odds that any word is toxic, log of 1 + expected toxic words)."""
        clean = sum(math.log1p(-min(m, 1 - 1e-9)) for m in marginals)
        any_toxic = min(max(-math.expm1(clean), 1e-6), 1 - 1e-9)
        return math.log(any_toxic / (1 - any_toxic)), math.log1p(sum(marginals))

    def score(self, marginals: list[float]) -> float:
        a, b, c = self.calibration
        x, y = self.evidence(marginals)
        return 1 / (1 + math.exp(-max(min(a + b * x + c * y, 60.0), -60.0)))

    def spans(self, text: str, places: list[int], marginals: list[float], least: float = 0.5) -> list[tuple[int, int, float]]:
        """Character offsets of neighbouring toxic words in the text as it came, with the highest marginal."""
        toxic = {p: m for p, m in zip(places, marginals, strict=True) if m >= least}
        if not toxic:
            return []
        low = text.lower()
        # lowering can lengthen a text: then each character's own share gives the offset
        share = None if len(low) == len(text) else np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        found: list[tuple[int, int, float]] = []
        before = -2
        for i, match in enumerate(WORD.finditer(low)):
            if i in toxic:
                start, end = match.span()
                if share is not None:
                    start, end = int(share[min(start, len(share) - 1)]), int(share[min(end, len(share)) - 1]) + 1
                if before == i - 1:
                    start, marginal = found.pop()[0], max(toxic[i], toxic[i - 1])
                else:
                    marginal = toxic[i]
                found.append((start, end, marginal))
                before = i
        return found


def _expectations(emission: np.ndarray, trans: np.ndarray, valid: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of the toxic state, weighted sums of the pairs of states) by forward-backward over sequences."""
    own = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], 2)
    forward, back = np.empty_like(own), np.ones_like(own)
    forward[:, 0] = own[:, 0] / own[:, 0].sum(1, keepdims=True)
    for t in range(1, SEGMENT):
        nxt = forward[:, t - 1] @ trans * own[:, t]
        forward[:, t] = nxt / nxt.sum(1, keepdims=True)
    for t in range(SEGMENT - 2, -1, -1):
        prev = (own[:, t + 1] * back[:, t + 1]) @ trans.T
        back[:, t] = np.where(valid[:, t + 1, None], prev / prev.sum(1, keepdims=True), 1.0)
    both = forward * back
    joint = forward[:, :-1, :, None] * trans[None, None] * (own * back)[:, 1:, None, :]
    joint = joint / joint.sum((2, 3), keepdims=True) * (valid[:, 1:] * weights[:, None])[..., None, None]
    return both[..., 1] / both.sum(2) * valid, joint.sum((0, 1))


def fit_chain(model: Model, docs: list[tuple[int, int, list[int], list[list[int]]]], rounds: int = 80) -> None:
    """Maximum likelihood of the labelled tokens of (toxic, words, places, features) rows by Adam."""
    rows, cols, entry_token, entry_feature, labels, lengths, weights = [], [], [], [], [], [], []
    segments = 0
    for d, (toxic, n, places, features) in enumerate(docs):
        at: dict[int, list[int]] = {}
        for j, place in enumerate(places):
            at.setdefault(place // SEGMENT, []).append(j)
        for s in range((n + SEGMENT - 1) // SEGMENT):
            if s not in at and (d + s) % THIN:
                continue
            lengths.append(min(SEGMENT, n - s * SEGMENT))
            weights.append(1.0 if s in at else float(THIN))
            for j in at.get(s, ()):
                entry_token += [len(rows)] * len(features[j])
                entry_feature += features[j]
                rows.append(segments)
                cols.append(places[j] - s * SEGMENT)
                labels.append(bool(toxic and model.seeds.intersection(features[j])))
            segments += 1
    if not rows:
        return
    rows, cols, entry_token, entry_feature = map(np.array, (rows, cols, entry_token, entry_feature))
    lengths, weights = np.array(lengths), np.array(weights)
    valid = np.arange(SEGMENT)[None, :] < lengths[:, None]
    truth = np.zeros((segments, SEGMENT), np.int64)
    truth[rows, cols] = labels
    pair_valid = valid[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (truth[:, :-1][pair_valid], truth[:, 1:][pair_valid]), np.broadcast_to(weights[:, None], pair_valid.shape)[pair_valid])
    total = float((weights[:, None] * valid).sum())
    kinds = len(model.features)
    theta = np.concatenate([np.zeros(kinds), [model.bias], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        emission = np.full((segments, SEGMENT), theta[kinds])
        emission[rows, cols] += np.bincount(entry_token, theta[entry_feature], len(rows))
        trans = np.exp(theta[kinds + 1 :].reshape(2, 2))
        gap, expected = np.empty_like(emission), np.zeros((2, 2))
        for at in range(0, segments, AT_ONCE):
            part = slice(at, at + AT_ONCE)
            p, pairs_of = _expectations(emission[part], trans, valid[part], weights[part])
            gap[part] = (truth[part] - p) * weights[part, None] * valid[part]
            expected += pairs_of
        grad = np.concatenate([np.bincount(entry_feature, gap[rows, cols][entry_token], kinds), [gap.sum()], (observed - expected).ravel()])
        grad = grad / total * 1e3 - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        theta = theta + 0.3 * (1 - turn / (rounds + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.98**turn)) + 1e-8)
    model.weights, model.bias, model.transitions = theta[:kinds], float(theta[kinds]), theta[kinds + 1 :].reshape(2, 2)


def fit_score(rows: list[tuple[int, float, float]], weight: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic regression of (toxic, evidence) rows, each class weighted to its share among all labels."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([[1.0, r[1], r[2]] for r in rows])
    w = np.where(y > 0, weight[1], weight[0])
    theta = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2]) * w.sum() * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3)
        theta = theta + np.clip(np.linalg.solve(hess, x.T @ (w * (y - p)) - ridge @ theta), -5, 5)
    return float(theta[0]), max(float(theta[1]), 0.0), max(float(theta[2]), 0.0)


def _sparse(shared):
    schema = pa.schema([("toxic", pa.int64()), ("n", pa.int64()), ("places", pa.list_(pa.int64())), ("features", pa.list_(pa.list_(pa.int64())))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.prepare()
        rows = ((toxic, *model.tokens(text or "")) for toxic, text in pairs(stream))
        yield from batches(rows, schema, lambda row: 64 + 32 * len(row[2]))

    return run


def _evidence(shared):
    schema = pa.schema([("toxic", pa.int64()), ("odds", pa.float64()), ("many", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.prepare()
        yield from batches(((toxic, *model.evidence(model.marginals(*model.tokens(text or "")))) for toxic, text in pairs(stream)), schema)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, chain_rows: int = 1_500, max_features: int = 4_096, purity: float = 0.9, least_ratio: float = 30.0, least_lift: float = 3.0) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of each class, the chain on about ``chain_rows`` of each."""
    context = docs.sparkSession.sparkContext
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("long").alias("toxic"))
    share = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = share.get(0, 0), share.get(1, 0)
    base = toxic / max(clean + toxic, 1)
    model = Model(calibration=(math.log(max(base, 1e-9) / max(1 - base, 1e-9)), 0.0, 0.0))
    if not clean or not toxic:
        return model
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    for_chain = F.when(F.col("toxic") == 1, min(0.5, chain_rows / toxic)).otherwise(min(0.5, chain_rows / clean))
    spreads = known.select(id_col, "toxic", spread.alias("spread"))
    # bounded by sample_rows of each class, whatever hashes are equal
    chosen = reduce(DataFrame.unionAll, [spreads.where(F.col("toxic") == side).orderBy("spread", id_col).limit(sample_rows) for side in (0, 1)])
    chosen = chosen.select(id_col, "toxic", (F.col("spread") < for_chain).alias("chain"))
    found = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    # one text of each id: many rows may have one
    sample = written(found.groupBy(id_col).agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("chain").alias("chain")).select("toxic", "text", "chain"), "toxic-sample")

    words = sample.select("toxic", "text").mapInArrow(_word_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    every = F.array(F.concat(F.lit("="), "word"), *(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES))
    counted = words.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("feature"), "clean", "toxic").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    of = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = of.get(0, 0) or 1, of.get(1, 0) or 1
    n = F.col("a") + F.col("b")
    rate = n_toxic / (n_clean + n_toxic)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    # shares as they are among all labels, whatever the sample's balance
    weight = F.col("b") / n_toxic * base / (F.col("b") / n_toxic * base + F.col("a") / n_clean * (1 - base))
    lift = F.col("b") * n_clean / (F.greatest("a", F.lit(1)) * n_toxic)
    rated = counted.where((F.col("b") >= 3) & (lift >= least_lift)).select("feature", (2 * (part(F.col("a"), n * (1 - rate)) + part(F.col("b"), n * rate))).alias("ratio"), weight.alias("pure"))
    kept = rated.where(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), "feature").limit(max_features).collect()
    model.features = {row["feature"]: i for i, row in enumerate(kept)}
    model.seeds = {i for i, row in enumerate(kept) if row["pure"] >= purity}
    model.weights = np.zeros(len(kept))

    shared = context.broadcast(model)
    sparse = sample.where("chain").select("toxic", "text").mapInArrow(_sparse(shared), "toxic long, n long, places array<long>, features array<array<long>>")
    fit_chain(model, [tuple(row) for row in sparse.collect()])
    shared = context.broadcast(model)
    rows = [tuple(row) for row in sample.where("not chain").select("toxic", "text").mapInArrow(_evidence(shared), "toxic long, odds double, many double").collect()]
    if len({row[0] for row in rows}) == 2:
        ones = sum(row[0] for row in rows)
        model.calibration = fit_score(rows, ((1 - base) / (len(rows) - ones), base / ones))
    dropped(sample)
    return model


def scorer(shared, id_type: pa.DataType):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
    schema = pa.schema([("doc_id", id_type), ("score", pa.float64()), ("expected_toxic", pa.float64()), ("n_words", pa.int64()), ("spans", pa.list_(span))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.prepare()

        def rows() -> Iterator[tuple]:
            for doc, text in pairs(stream):
                n, places, features = model.tokens(text or "")
                found = model.marginals(n, places, features)
                spans = model.spans(text or "", places, found)
                yield doc, model.score(found), float(sum(found)), n, [{"start": a, "end": b, "marginal": m} for a, b, m in spans]

        yield from batches(rows(), schema, lambda row: 64 + 24 * len(row[4]))

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score, expected toxic words and toxic spans of every whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(id_col, text_col).mapInArrow(scorer(shared, to_arrow_type(kind)), SCHEMA.format(id=kind.simpleString()))
