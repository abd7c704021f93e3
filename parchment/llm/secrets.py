"""Secrets in texts: candidates by pattern, false positives removed by a random forest on native features.

Features: length, character transitions (a log-ratio learned from the labelled findings), dictionary coverage (letters
of words that many documents hold), the path around, and neighbouring words. The forest is grown on the driver from
labelled findings, a bounded table, and becomes one SQL expression: scoring is DataFrame operations only.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blocks, cut, let, place_of
from ._common import join_hot, materialize
from ._spans import TERM, located, marked, unmarked

CANDIDATE = r"(?:\G|(?<![\p{L}0-9+/_-]))[A-Za-z0-9+/_-]{16,}+={0,2}(?![\p{L}0-9])"
#: What is assigned to a secret word, of any characters but spaces and quotes, from six on; group 1 is context.
ASSIGNED = r"(?i)((?:passw(?:or)?d|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[\x20\t]{0,3}(?::|=>?)[\x20\t]{0,3}[\"']?)([^\s\"'<>,;]{6,})"
#: Two and more runs joined by dots, as in signed tokens.
DOTTED = r"(?<![\p{L}0-9+/_.-])[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+)+(?![\p{L}0-9])"
#: Rows of words that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Fixed formats of credentials that services publish.
FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk[-_](live|test)?[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}.*)$"
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
OTHER_WORDS = r"(?i)(commit|sha-?[0-9]|md5|checksum|digest|hash|etag|uuid|revision|example|sample|placeholder|dummy|version)"
FEATURES = ("length", "transitions", "dictionary", "digits", "runs", "distinct", "known", "path", "secret_word", "other_word", "assigned", "quoted")
_CLASSES = "vcUdo"


def labelled_findings(n: int = 1600, seed: int = 23) -> list[tuple[str, str, str, int]]:
    """Findings (before, candidate, after, label) to learn from where none are given: formats of credentials in the
    places where they occur against what is taken for them: words, paths, identifiers, digests, placeholders."""
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ing", "ti", "es", "or", "ed", "lich", "keit", "ung", "mente", "que", "ción", "eau", "oi"]
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda k: "".join(r.choice(syllables) for _ in range(k)).replace("ó", "o")
    base62 = string.ascii_letters + string.digits
    prose = lambda: " ".join(word(r.randint(1, 3)) for _ in range(6)) + " "
    out = []
    for i in range(n):
        if i % 2:
            made = r.choice((
                lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: pick(base62, r.randint(20, 64)), lambda: pick(base62 + "+/", r.choice((24, 40, 64))) + r.choice(("", "=", "==")),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: r.choice(("ghp_", "gho_")) + pick(base62, 36), lambda: "sk_live_" + pick(base62, 24), lambda: "AIza" + pick(base62 + "_-", 35),
            ))()
            if i % 10 == 1:
                made = r.choice((lambda: word(2).title() + pick("!#$%&*?", 1) + pick(string.digits, r.randint(1, 4)), lambda: pick(base62 + "!#$%&*?", r.randint(8, 14)), lambda: ".".join(("eyJ" + pick(base62, 20), pick(base62 + "-_", 30), pick(base62 + "-_", 30)))))()
            key = r.choice(("token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "Authorization", "private key"))
            before = prose() + r.choice((f'{key} = "', f"{key}: ", f"{key}=", f"{key}: Bearer ", f"{key} is ")) if r.random() < 0.9 else prose()
            out.append((before, made, '" ' + prose() if before.endswith('"') else " " + prose(), 1))
        else:
            kind = r.randrange(9)
            before, after = prose(), " " + prose()
            if kind <= 1:
                made = word(r.randint(7, 14))
            elif kind == 2:
                made, before = "/".join(word(2) for _ in range(r.randint(3, 6))), before + r.choice(("http://www.example.com", "/usr", ""))
            elif kind == 3:
                made, before = pick("0123456789abcdef", r.choice((40, 64, 32))), before + r.choice(("commit ", "sha256:", "md5 ", "checksum: ", 'etag="', "revision "))
            elif kind == 4:
                made = r.choice((lambda: "_".join(word(2) for _ in range(5)), lambda: "".join(word(2).title() for _ in range(5)), lambda: "-".join(word(2) for _ in range(5))))()
            elif kind == 5:
                made = r.choice(("YOUR_API_KEY_GOES_HERE", "x" * r.randint(16, 40), "0" * 32, "-" * r.randint(16, 60), "_" * 24, "REPLACE_WITH_YOUR_TOKEN", "0123456789abcdef0123456789abcdef", "=" * 20))
                before += r.choice(('token = "', "api_key: ", ""))
            elif kind == 7:
                made, before = r.choice((lambda: word(r.randint(2, 4)), lambda: word(2) + "." + word(2), lambda: r.choice(("required", "optional", "changeme", "<none>", "********", "undefined", "${PASSWORD}", "string"))))(), before + r.choice(("password: ", "the token: ", "secret = ", "Passwort: password: "))
            elif kind == 8:
                made, before = ".".join(word(r.randint(4, 6)) for _ in range(r.randint(2, 4))), before + r.choice(("www.", "import ", ""))
            else:
                made, before = pick("0123456789", r.randint(16, 20)), before + r.choice(("", "order ", "id "))
            out.append((before, made, after, 0))
    return out


def document_frequency(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, df): in how many rows of docs each of terms (term, distinct) occurs, over whole texts; none: no row.

    Each document's distinct words meet the set of terms before they are counted, and counts combine before the
    shuffle, so frequent words move no more than rare ones.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(f"({TERM})"), F.lit(1)))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.explode(words).alias("term"))
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return rows.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", before: int = 40, after: int = 20) -> DataFrame:
    """(id_col, start, end, candidate, before, after) of everything that has a candidate's form, in whole texts: what is
    assigned to a secret word, runs joined by dots, and long runs; a candidate within one of an earlier form is that one."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain, low = unmarked(text), F.lower(text)
    named = low.contains("passw") | low.contains("passphrase") | low.contains("pwd") | low.contains("secret") | low.contains("token") | low.contains("credential") | low.contains("key")
    forms = F.array(marked(plain, ASSIGNED, named, before=True), marked(plain, DOTTED, text.rlike(r"[A-Za-z0-9_-]{10}\.[A-Za-z0-9_-]{10}")), marked(plain, CANDIDATE, F.length(text) >= 16))

    def free(spans: Column, taken: Column) -> Column:
        inside = lambda s, starts: let(F.get(taken, place_of(starts, s["start"])), lambda t: (t["start"] <= s["start"]) & (t["end"] >= s["end"]))
        return F.when(F.size(taken) > 0, let(F.transform(taken, lambda t: t["start"]), lambda starts: F.filter(spans, lambda s: ~inside(s, starts)))).otherwise(spans)

    every = let(F.transform(forms, lambda f: located(f)), lambda fs: let(free(fs[1], fs[0]), lambda dotted: F.concat(fs[0], dotted, free(free(fs[2], fs[0]), dotted))))
    context = lambda held, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("candidate"),
        let(F.greatest(F.lit(0), s["start"] - before), lambda at: cut(held, at, s["start"] - at)).alias("before"), cut(held, s["end"], F.lit(after)).alias("after"),
    )
    found = let(every, lambda spans: F.when(F.size(spans) > 0, let(blocks(text), lambda held: F.transform(spans, lambda s: context(held, s)))))
    return rows.select(F.col("id").alias(id_col), F.explode(found).alias("s")).select(id_col, "s.*")


def _classes(c: Column) -> Column:
    """The candidate with vowels, consonants, capitals, digits and others as one letter each."""
    letters = string.ascii_lowercase
    lower = "".join("v" if x in "aeiou" else "c" for x in letters)
    plain = F.translate(F.regexp_replace(c, "[^A-Za-z0-9]", "#"), letters, lower)
    return F.translate(plain, string.ascii_uppercase + string.digits + "#", "U" * 26 + "d" * 10 + "o")


def features(rows: DataFrame, coverage: Column, transitions: dict[str, float]) -> DataFrame:
    """rows with a column for each of FEATURES."""
    c, size = F.col("candidate"), F.length("candidate").cast("double")
    table = F.create_map(*[F.lit(x) for pair in transitions.items() for x in pair])
    classes = F.col("classes")
    steps = F.transform(F.sequence(F.lit(1), F.length(classes) - 1), lambda i: F.coalesce(table[F.substr(classes, i, F.lit(2))], F.lit(0.0)))
    made = {
        "length": size,
        "transitions": F.aggregate(steps, F.lit(0.0), lambda a, b: a + b) / size,
        "dictionary": coverage / size,
        "digits": F.length(F.regexp_replace(c, "[^0-9]", "")) / size,
        "runs": F.size(F.regexp_extract_all(c, F.lit("([a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+)"), F.lit(1))) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(32.0)),
        "known": c.rlike(FORMATS).cast("double"),
        "path": (c.contains("/") & ~c.rlike("[0-9]")).cast("double") + F.col("before").rlike(r"[\w.]/?$").cast("double"),
        "secret_word": F.col("before").rlike(SECRET_WORDS).cast("double"),
        "other_word": (F.col("before").rlike(OTHER_WORDS) | c.rlike(OTHER_WORDS)).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).cast("double"),
    }
    return rows.withColumn("classes", _classes(c)).withColumns({k: v for k, v in made.items()}).drop("classes")


def learn_transitions(findings: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Log-ratio of each pair of character classes between findings of label 1 and 0, with add-one smoothing."""
    kind = lambda x: "v" if x in "aeiou" else "c" if x in string.ascii_lowercase else "U" if x in string.ascii_uppercase else "d" if x in string.digits else "o"
    n = {y: {a + b: 1.0 for a in _CLASSES for b in _CLASSES} for y in (0, 1)}
    for _, c, _, y in findings:
        seen = "".join(map(kind, c))
        for a, b in zip(seen, seen[1:]):
            n[y][a + b] += 1 / len(seen)
    total = {y: sum(v.values()) for y, v in n.items()}
    return {p: float(np.log(n[1][p] / total[1] * total[0] / n[0][p])) for p in n[1]}


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 4):
    """A tree as nested (feature, threshold, below, above), leaves as the share of label 1."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (1e9, None)
    for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
            low = x[:, f] <= t
            a, b = int(low.sum()), int((~low).sum())
            if min(a, b) < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            if (gini := a * p * (1 - p) + b * q * (1 - q)) < best[0]:
                best = (gini, (int(f), float(t)))
    if best[1] is None:
        return float(y.mean())
    f, t = best[1]
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, rng, least), grow(x[~low], y[~low], depth - 1, rng, least)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 12, depth: int = 5, seed: int = 31) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        out.append(grow(x[at], y[at], depth, rng))
    return out


def compiled(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, below, above = tree
    return F.when(F.col(FEATURES[f]) <= t, compiled(below)).otherwise(compiled(above))


def _table(spark: SparkSession, findings: list[tuple[str, str, str, int]]) -> DataFrame:
    rows = json.dumps([{"before": b, "candidate": c, "after": a, "label": y} for b, c, a, y in findings], ensure_ascii=True)
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<before:string,candidate:string,after:string,label:int>>")).alias("r")).select("r.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: list[tuple[str, str, str, int]] | None = None, least_documents: int = 3) -> DataFrame:
    """Per candidate: id_col, start, end (code points), candidate, score and is_secret (score at least 0.5).

    findings: labelled ones to learn from, thousands at most as the driver holds them; by default labelled_findings().
    Candidates are runs of 16 characters and more, dotted runs, and what is assigned to a secret word from six characters
    on; shorter secrets, and those that hold spaces, quotes, commas or semicolons, are not seen.
    A word is in the dictionary if at least least_documents documents hold it. Null and empty texts have no candidates.
    Rows that repeat an id, and equal rows, each have theirs. Other columns are ignored.
    """
    spark = docs.sparkSession
    findings = labelled_findings() if findings is None else findings
    rows = materialize(candidates(docs, id_col, text_col), "secrets")
    teach = _table(spark, findings)
    parts = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), F.lit(1)))
    terms = rows.select("candidate").unionByName(teach.select("candidate")).select(F.explode(parts(F.col("candidate"))).alias("term")).distinct()
    known = materialize(document_frequency(docs, text_col, materialize(terms, "secret-terms")).where(F.col("df") >= least_documents).select("term"), "dictionary")
    transitions = learn_transitions(findings)

    def covered(of: DataFrame, by: Column) -> DataFrame:
        words = of.select("candidate").distinct().select("candidate", F.explode(parts(F.col("candidate"))).alias("term")).join(known, "term")
        sums = words.groupBy("candidate").agg(F.sum(F.length("term")).alias("covered")).select(F.sha2("candidate", 256).alias("key"), "covered")
        return join_hot(of, F.sha2("candidate", 256), by, sums)

    seen = F.coalesce(F.col("covered"), F.lit(0)).cast("double")
    taught = features(covered(teach, F.xxhash64("before", "after")), seen, transitions).select("before", "candidate", *FEATURES, "label").collect()
    taught = sorted(taught, key=lambda r: (r["candidate"], r["before"], r["label"]))
    x = np.array([[r[f] for f in FEATURES] for r in taught], float)
    trees = [compiled(t) for t in forest(x, np.array([r["label"] for r in taught], float))]
    score = sum(trees[1:], trees[0]) / len(trees)
    scored = features(covered(rows, F.xxhash64(id_col, "start")), seen, transitions).withColumn("score", score)
    return scored.select(id_col, "start", "end", "candidate", F.round("score", 6).alias("score"), (F.round("score", 6) >= 0.5).alias("is_secret"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("is_secret")
