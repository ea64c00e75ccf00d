"""Secret scans: candidates by one expression, false positives removed by a random forest; DataFrame functions only.

A candidate is the value after a credential word and an assignment sign, or a run
of token characters with a digit in it, each whole at any length, or a private key
from its BEGIN to its END line (without an END line, over the base64 lines below it),
which the forest rates by its BEGIN line. The text is split at the candidates, so
that each has its offset and its neighbourhood without a second search. Features
are length, transitions between character classes, class shares, distinct
characters, dictionary coverage, marks of paths and addresses, and the words
beside it. The forest is trained on labelled findings with the library's own
random forest and then written as one SQL expression: each tree is a nested CASE,
and the score is the share of trees that vote for a secret (the library itself
averages the class shares of the leaves instead). Everything happens inside the
row; nothing is shuffled, so no source or copy is hot.

Training takes at most ``training_rows`` labelled findings. Findings of a
reviewer may be given; the default is a set made by rules from a hash, with the
shapes of credentials and of the values that are mistaken for them.

Defined results: null text counts as empty and has no finding; repeated rows have
their findings each; a null id is kept; an empty table yields no rows; other
columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import free

#: Characters of tokens.
RUN = "A-Za-z0-9_+/.~-"
#: A key before a value: a credential word, an assignment sign, an opening quote.
KEY = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
#: The header of a private key.
HEADER = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: A line end or blank in a key block, also as written inside a quoted string.
GAP = r"(?:\s|\\[rn])"
#: A key from its header over all up to the END line; without one, over the header fields and base64 lines that follow.
PRIVATE_KEY = rf"{HEADER}(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----|(?:{GAP}++(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*+)*+(?:{GAP}++[A-Za-z0-9+/]{{40,}}+={{0,2}})*+(?:{GAP}++[A-Za-z0-9+/]+={{0,2}}(?=[ \t]*+(?:[\r\n\"']|\\[rn]|\Z)))?)"
#: Values are taken whole, however long: possessive runs, and a look for a digit that starts only where a run starts.
CANDIDATE = rf"(?:{PRIVATE_KEY})|(?:(?=[PpSsTtAaCc]){KEY}(?:{PRIVATE_KEY}|(?:(?!{HEADER})[^\s\"'<>(){{}}\[\],;]){{6,}}+))|(?:(?<![{RUN}])(?=[A-Za-z_+/.~-]*+[0-9])(?:(?!{HEADER})[{RUN}]){{8,}}+={{0,2}})"
#: Every candidate has one of these; texts without any are not searched further.
NEEDED = r"[0-9=:]|-----BEGIN"
#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 48
#: Words of the dictionary that covers false positives; fixed values.
DICTIONARY = "password|passwd|example|sample|secret|token|change|placeholder|dummy|test|demo|default|your|user|name|admin|value|string|config|version|index|file|path|page|image|http|https|www|mail|com|org|net|html|json|python|main|lib|src|usr|local|data|model|chapter|section|figure|table|release|build|license|self|environ|none|null|true|false|key|xxxx+|abcd|1234"
#: Words beside a candidate that speak for and against a secret; fixed values.
FOR = r"(?i)(?:password|passwd|pwd|secret|token|api.?key|access.?key|credential|bearer|private|auth)"
AGAINST = r"(?i)(?:commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|hash|isbn|phone|tel|version|revision|license|e-?mail|http)"
#: Beginnings of tokens that issuers fix; fixed values.
PREFIX = r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30}|github_pat_|xox[abprs]-|sk-[A-Za-z0-9]{16}|sk_live_|eyJ[A-Za-z0-9_-]{8,}\.|AIza[0-9A-Za-z_-]{30}|glpat-|-----BEGIN )"

FEATURES = ("length", "transitions", "digits", "uppers", "lowers", "marks", "hexadecimal", "distinct", "dictionary", "slashes", "dots", "address", "assigned", "prefix", "near_for", "near_against", "dashes", "repeats")


def features(value: Column, key: Column, before: Column, after: Column) -> Column:
    """The feature struct of a candidate."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / n

    classes = F.translate(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "123456789", "000000000")
    classes = F.regexp_replace(classes, "[^aA0]", "-")
    runs = F.length(F.regexp_replace(classes, "(.)\\1+", "$1"))
    flag = lambda condition: condition.cast("double")
    found = {
        "length": n,
        "transitions": (runs - 1) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.sqrt(n),
        "dictionary": share(f"(?i)(?:{DICTIONARY})"),
        "slashes": share("/"),
        "dots": share("[.]"),
        "address": flag(before.rlike("@$") | after.rlike("^@") | value.contains("@") | before.rlike("://\\S*$") | value.contains("://")),
        "assigned": flag(key != ""),
        "prefix": flag(value.rlike(PREFIX)),
        "near_for": flag(before.rlike(FOR)),
        "near_against": flag(before.rlike(AGAINST)),
        "dashes": flag(value.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$")),
        "repeats": flag(value.rlike("(.)\\1{4}|(..)\\2{3}")),
    }
    return F.struct(*(found[name].cast("double").alias(name) for name in FEATURES))


def raw_candidates(text: Column) -> Column:
    return F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit("(?s)" + CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))


def between(text: Column, raws: Column) -> Column:
    """The gaps around the candidates, one more than these."""
    return F.when(F.size(raws) > 0, F.split(text, "(?s)" + CANDIDATE, -1)).otherwise(F.array(text))


def beginnings(raws: Column, gaps: Column) -> Column:
    """Where each candidate begins: sums of the lengths so far."""
    empty = F.array().cast("array<int>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        return F.struct((start + F.length(F.get(raws, i))).alias("at"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    sums = F.aggregate(F.sequence(F.lit(0), F.size(raws) - 1), F.struct(F.lit(0).alias("at"), empty.alias("starts")), step)
    return F.when(F.size(raws) > 0, sums["starts"]).otherwise(empty)


def located(raws: Column, gaps: Column, starts: Column) -> Column:
    """Array of (value, key, before, after, kind, start) of the candidates."""

    def one(raw: Column, i: Column) -> Column:
        key = F.regexp_extract(raw, "^(" + KEY + ")", 1)
        value = F.substring(raw, F.length(key) + 1, F.length(raw))
        gap = F.get(gaps, i)
        before = F.concat(F.substring(gap, F.greatest(F.length(gap) - NEAR + 1, F.lit(1)), F.lit(NEAR)), key)
        after = F.substring(F.get(gaps, i + 1), F.lit(1), F.lit(NEAR))
        kind = F.when(value.startswith("-----BEGIN "), "private_key").when(value.rlike(PREFIX), "known_prefix").when(key != "", "assignment").otherwise("token")
        return F.struct(value.alias("value"), key.alias("key"), before.alias("before"), after.alias("after"), kind.alias("kind"), (F.get(starts, i) + F.length(key)).alias("start"))

    return F.when(F.size(raws) > 0, F.transform(raws, one)).otherwise(F.array().cast("array<struct<value:string,key:string,before:string,after:string,kind:string,start:int>>"))


def training_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings (value, key, before, after, label) made by rules from a hash."""

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 512)

    hexes, other = digest("a"), digest("b")
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, other))), "[^A-Za-z0-9]", "")
    upper = F.upper(mixed)
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.hash("id", F.lit("p")), F.lit(len(words))) + 1).cast("int"))
    long_key = F.concat(F.substring(hexes, 1, 0), pick("password=", "token = \"", "api_key: ", "secret=", "passwd: ", "access_key = '", "Token: "))
    number = F.conv(F.substring(hexes, 1, 12), 16, 10)
    plain = pick("the ", "of and ", "is in ", "see ", "value ", "")
    word = pick("version", "chapter", "model", "mp", "figure", "covid", "python", "release", "area", "section")
    # (label, key, value, before, after)
    shapes = [
        (1, "password=", F.substring(hexes, 1, 18), plain, " "),
        (1, "token = \"", F.substring(hexes, 1, 40), plain, "\" "),
        (1, "", F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, " "),
        (1, long_key, F.concat(F.substring(mixed, 1, 24), F.substring(hexes, 1, 8)), plain, " "),
        (1, "", F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, " "),
        (1, "", F.concat(F.lit("sk-"), F.substring(mixed, 1, 40)), plain, "\n"),
        (1, "", F.concat(F.lit("xoxb-"), F.substring(number, 1, 11), F.lit("-"), F.substring(mixed, 1, 24)), plain, " "),
        (1, "", F.concat(F.lit("eyJ"), F.substring(mixed, 1, 30), F.lit(".eyJ"), F.substring(mixed, 31, 40), F.lit("."), F.substring(mixed, 10, 43)), pick("Bearer ", "authorization: ", "jwt "), " "),
        (1, long_key, F.concat(F.substring(mixed, 1, 5), F.lit("!"), F.substring(number, 1, 3), F.lit("#"), F.substring(mixed, 9, 4)), plain, "\n"),
        (1, long_key, F.substring(hexes, 1, 32), plain, " "),
        (1, "", F.lit("-----BEGIN RSA PRIVATE KEY-----"), plain, "\nMII"),
        (0, "", F.concat(F.lower(F.substring(mixed, 1, 5)), F.lit("."), F.substring(number, 1, 2)), plain, "@mail.example.com "),
        (0, "", F.concat(pick("mail", "host", "smtp"), F.substring(number, 1, 1), F.lit(".example."), pick("com", "org", "net")), F.lit("someone@"), " "),
        (0, "", F.concat(F.substring(number, 1, 4), F.substring(F.conv(F.substring(other, 1, 12), 16, 10), 1, 12)), plain, " "),
        (0, "", F.concat_ws(".", F.substring(number, 1, 2), F.substring(number, 3, 3), F.substring(number, 4, 2), F.substring(number, 2, 3)), plain, " "),
        (0, "", F.concat(pick("2023-", "2024-", "1999-"), F.lit("0"), F.substring(number, 1, 1), F.lit("-1"), F.substring(number, 2, 1)), plain, " "),
        (0, "", F.concat(pick("/usr/lib/python", "src/main/v", "lib/data/part", "./build/release"), F.substring(number, 1, 2), pick("/index.html", "/config.json", "/file_test.py", "/README.md")), plain, " "),
        (0, "", F.substring(hexes, 1, 40), pick("commit ", "sha1 ", "revision ", "checksum: "), " "),
        (0, "", F.substring(hexes, 1, 64), pick("sha256:", "digest ", "SHA-256 "), " "),
        (0, "", F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick("uuid ", "id ", "the "), " "),
        (0, long_key, F.concat(pick("your_password_", "example_secret", "changeme", "dummy_token_", "placeholder", "xxxxxxxx", "test_password"), F.substring(number, 1, 1)), plain, " "),
        (0, long_key, pick("${DB_PASSWORD}", "self.password", "os.environ.get", "config.secret", "********", "None", "required", "get_token_value"), plain, " "),
        (0, "", F.concat(word, pick("-", "_", ".", ""), F.substring(number, 1, 2), pick(".0.1", "-beta2", "th-edition", "_final")), plain, " "),
        (0, "", F.concat(pick("www.example.com/page", "docs.python.org/3/", "host/index/"), F.substring(number, 1, 3)), F.lit("https://"), " "),
        (0, "", F.concat(pick("RTX", "ISO", "RFC", "GTX", "WB"), F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 2), pick("GB", "A", "B2")), plain, " "),
        (0, "", F.concat(F.lower(F.regexp_replace(F.substring(mixed, 1, 14), "[0-9]", "e")), F.substring(number, 1, 1)), plain, " "),
        (0, "", F.concat(F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 3), F.lit("-"), F.substring(number, 7, 4)), pick("phone ", "tel ", "call "), " "),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(shapes)))
    column = lambda i: reduce(lambda rest, k: F.when(kind == k, shapes[k][i] if isinstance(shapes[k][i], Column) else F.lit(shapes[k][i])).otherwise(rest), range(len(shapes)), F.lit(None))
    own = spark.range(rows).select(column(0).alias("label"), column(1).alias("key"), column(2).alias("value"), column(3).alias("gap"), column(4).alias("after"))
    return own.select("value", "key", F.concat("gap", "key").alias("before"), "after", "label")


def parse_tree(lines: list[str]) -> tuple:
    """(feature, threshold, left, right) or a leaf's class, from the printed form of a tree."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return (float(line.split(":")[1]),)
    feature, threshold = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
    left = parse_tree(lines)
    lines.pop(0)
    return int(feature), float(threshold), left, parse_tree(lines)


def fit(spark: SparkSession, findings: DataFrame | None = None, trees: int = 24, depth: int = 7, seed: int = 7, training_rows: int = 6_000):
    """The library's random forest on labelled findings (value, key, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    found = training_findings(spark, training_rows) if findings is None else findings.limit(training_rows)
    rows = found.select("label", features(F.col("value"), F.col("key"), F.col("before"), F.col("after")).alias("f")).select(F.col("label").cast("double"), "f.*")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1)).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(assembled)


def train(spark: SparkSession, findings: DataFrame | None = None, **parameters) -> list[tuple]:
    """The trees of the forest that ``fit`` makes."""
    return trees_of(fit(spark, findings, **parameters))


def trees_of(model) -> list[tuple]:
    printed = re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]
    return [parse_tree(tree.rstrip().split("\n")) for tree in printed]


def votes(forest: list[tuple], own: Column) -> Column:
    """Share of the trees that vote for a secret."""

    def walk(node: tuple) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        feature, threshold, left, right = node
        if left == right:
            return walk(left)
        return F.when(own[FEATURES[feature]] <= threshold, walk(left)).otherwise(walk(right))

    return reduce(lambda a, b: a + b, map(walk, forest)) / float(len(forest))


def _rated(docs: DataFrame, text_col: str, forest: list[tuple] | None, least: float) -> tuple[DataFrame, str, str, str]:
    """``docs`` with the raw candidates, the gaps and the rated findings in more columns, under names that are free."""
    forest = train(docs.sparkSession) if forest is None else forest
    raws, gaps, starts, found = free(docs.columns, "raws", "gaps", "starts", "found")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # columns of their own, each used more than once, so that the optimiser keeps them and the text is searched once
    parts = docs.withColumn(raws, raw_candidates(text)).withColumn(gaps, between(text, F.col(raws))).withColumn(starts, beginnings(F.col(raws), F.col(gaps)))
    rated = parts.withColumn(found, located(F.col(raws), F.col(gaps), F.col(starts)))
    rated = rated.withColumn(found, F.transform(found, lambda c: F.struct(c.alias("c"), features(F.when(c["kind"] == "private_key", F.regexp_extract(c["value"], "^" + HEADER, 0)).otherwise(c["value"]), c["key"], c["before"], c["after"]).alias("f"))))
    rated = rated.withColumn(found, F.transform(found, lambda x: F.struct(x["c"].alias("c"), votes(forest, x["f"]).alias("score"))))
    kept = rated.withColumn(found, F.transform(found, lambda x: F.struct(x["c"]["start"].cast("long").alias("start"), F.length(x["c"]["value"]).cast("long").alias("length"), x["c"]["kind"].alias("kind"), x["c"]["value"].alias("value"), F.length(x["c"]["key"]).alias("key_length"), x["score"].alias("score"), (x["score"] >= least).alias("secret"))))
    return kept, raws, gaps, found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: list[tuple] | None = None, least: float = 0.5) -> DataFrame:
    """A row for each candidate: its place (characters), kind, value, score and whether it is a secret."""
    rated, _, _, found = _rated(docs.select(id_col, text_col), text_col, forest, least)
    # inline_outer and a filter: below an inner generator the optimiser would filter by the array, and evaluate it anew
    return rated.select(F.col(id_col).alias("doc_id"), F.inline_outer(found)).where("start is not null").select("doc_id", "start", "length", "kind", "value", "score", "secret")


def redact(docs: DataFrame, text_col: str = "text", forest: list[tuple] | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; texts without one, and all other columns, stay as they were."""
    rated, raws, gaps, found = _rated(docs, text_col, forest, least)
    raws, gaps = F.col(raws), F.col(gaps)

    def piece(x: Column, i: Column) -> Column:
        raw = F.get(raws, i)
        return F.concat(F.get(gaps, i), F.when(x["secret"], F.concat(F.substring(raw, F.lit(1), x["key_length"]), F.lit(mark))).otherwise(raw))

    clean = F.concat(F.array_join(F.transform(found, piece), ""), F.get(gaps, F.size(raws)))
    return rated.withColumn(text_col, F.when(F.exists(found, lambda x: x["secret"]), clean).otherwise(F.col(f"`{text_col}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))
