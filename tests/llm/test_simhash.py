"""Groups against brute force over all pairs, and the defined cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    own = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in own]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(points, radius):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    own = simhash.masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(m & flips == 0 for m in own)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_match_all_pairs(spark, radius):
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(12)]
    points = {c ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
    chain = [rng.getrandbits(64)]
    for i in range(30):  # a long chain of single links
        chain.append(chain[-1] ^ sum(1 << b for b in range(radius * i % 64, radius * i % 64 + radius) if b < 64))
    points = sorted(points | set(chain))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    order = sorted(range(len(points)), key=lambda i: signed[i])
    expected = {}
    for i, r in zip(order, brute_groups([points[i] for i in order], radius)):
        expected[signed[i]] = signed[order[r]]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = dict(map(tuple, simhash.components(simhash.links(df, radius)).collect()))
    assert {s: found.get(s, s) for s in signed} == expected


def test_groups_and_cases(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(60, 400))) for _ in range(20)]
    texts = [None, "", " \t\n", "One", "one", "two words", "ONE\x0btwo\x1cthree", "Äpfel und Birnen essen"]
    for b in base:
        texts += [b, b.upper()]
        own = b.split()
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts.append("long " * 200_000)
    rows = [(100 - i, t, "x", i) for i, t in enumerate(texts)] + [(None, base[0], "y", 0), (100, None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    found = simhash.groups(df).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fp"), "component_id").collect()
    assert len(found) == len(rows)
    prints = [brute(r[1]) for r in rows]
    roots = brute_groups(prints, 2)
    least = {}
    for r, g in zip(rows, roots):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    expected = sorted((repr(r[0]), f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, roots))
    assert sorted((repr(a), b, c) for a, b, c in found) == expected
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df).count() == 0
    assert simhash.representatives(df).count() == 0


def test_similar_texts_join_groups(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    rows, want = [], []
    for n in (40, 90, 200, 600):
        for _ in range(6):
            base = rng.choices(words, k=n)
            other = list(base)
            for at in range(n // 60 + 1):
                other[rng.randrange(n)] = f"changed{at}"
            far = base[: n // 2] + rng.choices(words, k=n // 2)
            first = len(rows)
            rows += [(first, " ".join(base)), (first + 1, " ".join(other)), (first + 2, " ".join(far))]
            near = simhash.jaccard(rows[first][1], rows[first + 1][1]) >= 0.8
            want.append((first + 1, near))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.representatives(df, similarity=0.8).collect()}
    assert all(d in kept for d in range(len(rows)) if d % 3 != 1)
    caught = [d not in kept for d, near in want if near]
    assert len(caught) >= 12 and sum(caught) >= 0.9 * len(caught)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.representatives(none, similarity=0.8).count() == 0


@pytest.mark.parametrize("n", [9, 200, 1000, 2000])
def test_similar_pairs_share_a_band_at_every_length(n):
    rng = random.Random(n)
    words = ["w%d" % i for i in range(5000)]
    found = seen = 0
    while seen < 60:
        base = rng.choices(words, k=n)
        other = list(base)
        for at in rng.sample(range(n), max(1, n // 47)) if n > 9 else [n - 1]:
            other[at] = "changed%d" % at
        left, right = " ".join(base), " ".join(other)
        if n == 9:  # one word more: 5 of 6 shingles
            right = left + " more"
        if simhash.jaccard(left, right) < 0.8:
            continue
        seen += 1
        found += bool(set(simhash.band_keys(left)) & set(simhash.band_keys(right)))
    assert found >= 59


def test_long_and_short_similar_texts_are_linked(spark):
    rng = random.Random(21)
    words = ["w%d" % i for i in range(5000)]
    rows, want = [], set()
    for n in (9, 10, 1500, 1500, 2500, 2500, 2500):
        base = rng.choices(words, k=n)
        more = base + rng.choices(words, k=max(1, n // 6))
        assert simhash.jaccard(" ".join(base), " ".join(more)) >= 0.8
        want.add(len(rows))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(more))]
    # null ids and rows of one id are texts of their own
    base = rng.choices(words, k=300)
    rows += [(None, " ".join(base)), (None, " ".join(base + ["tail"])), (5000, "one"), (5000, " ".join(base + ["more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.groups(df, similarity=0.8).collect()
    roots = {r.doc_id: r.component_id for r in found if r.doc_id is not None and r.doc_id < 5000}
    assert roots == {d: d - d % 2 for d in range(14)} and {d for d in roots.values()} == want
    assert sorted({r.component_id for r in found if r.doc_id is None}) == [5000]


def same_rows(spark, rows, similarity):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, node int")
    found = simhash.representatives(df, similarity=similarity)
    assert found.columns == df.columns
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.kept_id or "") for r in found.collect())


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_one_row_of_each_group_whatever_the_ids(spark, similarity):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(900)]
    a, b, c = (" ".join(rng.choices(words, k=50)) for _ in range(3))
    # exact copies under ids that repeat or are null
    assert [r[:3] for r in same_rows(spark, [(0, a, None, 1), (1, a, None, 1), (1, b, None, 1)], similarity)] == [(False, 0, a), (False, 1, b)]
    assert [r[:3] for r in same_rows(spark, [(None, a, None, 1), (0, a, None, 1), (None, b, None, 1)], similarity)] == [(False, 0, a), (True, 0, b)]
    assert [r[:3] for r in same_rows(spark, [(None, a, "x", 1), (None, a, "y", 1), (None, b, None, 1), (7, c, None, 1), (7, c, None, 2), (7, a.upper(), None, 1)], similarity)] == [(False, 7, a.upper()), (False, 7, c), (True, 0, b)]
    # every text stands for itself where one id holds many
    assert len(same_rows(spark, [(5, " ".join(rng.choices(words, k=40)), None, i) for i in range(60)], similarity)) == 60
    # null, empty and blank texts are one group
    assert len(same_rows(spark, [(None, None, None, 1), (3, "", None, 1), (2, " ", None, 1)], similarity)) == 1


def brute_components(texts, similarity):
    """Groups by fingerprints of at most two bits and by similarity, over all pairs."""
    prints = [simhash.fingerprint(t, 3) for t in texts]
    sets = [set(simhash.shingles(t, simhash.SIMILAR_WORDS)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if bin(prints[i] ^ prints[j]).count("1") <= 2 or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_recall_in_large_families(spark):
    """Families of many near copies, so that buckets hold far more texts than are compared in each."""
    rng = random.Random(12)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for family in range(6):
        base = rng.choices(words, k=150)
        texts.append(" ".join(base))
        for _ in range(40):
            own = list(base)
            for at in rng.sample(range(150), rng.randint(1, 3)):
                own[at] = "new%d" % rng.randrange(10**6)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(100)]
    want = brute_components(texts, 0.8)
    found = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.8).collect()}
    assert all(want[i] == want[found[i]] for i in found)
    linked = [i for i in found if want[i] != i]
    assert sum(found[i] != i for i in linked) >= 0.99 * len(linked) and len(linked) > 200


def test_recall_on_the_documents(spark):
    """Every link of the documents, by two bits or by 0.8 of five-word shingles, over all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = brute_components([r.text for r in rows], 0.8)
    found = {r.doc_id: r.component_id for r in simhash.groups(docs, similarity=0.8).collect()}
    least = {}
    for r, g in zip(rows, want):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert found == {r.doc_id: least[g] for r, g in zip(rows, want)}


def test_prefixes_hold_a_shared_shingle():
    """Of sets that reach the similarity, the first shared member lies in the lesser one's shorter and the other's longer prefix."""
    rng = random.Random(8)
    for _ in range(3000):
        both, left, right = rng.randrange(1, 90), rng.randrange(12), rng.randrange(12)
        similarity = rng.choice([0.5, 0.8, both / (both + left + right)])
        if both / (both + left + right) < similarity:
            continue
        members = rng.sample(range(1000), both + left + right)
        a, b = sorted(([*members[:both], *members[both : both + left]], [*members[:both], *members[both + left :]]), key=len)
        first = min(set(a) & set(b))
        assert sorted(a).index(first) < simhash.prefix_lengths(len(a), similarity)[1]
        assert sorted(b).index(first) < simhash.prefix_lengths(len(b), similarity)[0]


def test_every_link_in_large_buckets_of_many_groups(spark):
    """Pages of one template: all share a long core, which fills large buckets, and only pairs of them reach the similarity."""
    rng = random.Random(17)
    core = ["core%d" % i for i in range(84)]
    texts = []
    for pair in range(150):
        for own in range(2):
            texts.append(" ".join([*core, f"p{pair}", f"q{pair}", *("own%d" % rng.randrange(10**9) for _ in range(9))]))
    rng.shuffle(texts)
    assert 0.8 < simhash.jaccard(texts[0], next(t for t in texts[1:] if t.split()[84] == texts[0].split()[84])) < 0.83
    want = brute_components(texts, 0.8)
    found = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.8).collect()}
    assert len(set(want)) > 100 and [found[i] for i in range(300)] == want
