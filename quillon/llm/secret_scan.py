"""Secret scanning with a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are runs of key-like characters, and shorter and wider runs after words that name a secret, with the word
and the sign before them and the word after them. Each
gets its length, its character transitions (how likely its letters follow each other in words, how often letters
and digits change places), how much of it words of a dictionary cover, its path and its neighbouring words. The
forest is trained on the driver from labelled findings (a bounded set) whose features come from the same
expressions, then written out as nested CASE expressions, so scanning is one narrow pass inside the JVM.

Edge cases: null text holds no candidates and stays null; a null path counts as an empty one; a null doc_id is
passed through; repeated rows are scanned alike; an empty table gives an empty result; other columns are carried
along and may have any name but those of ``OUT``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = ("n_candidates", "findings")
MASK = "<SECRET>"
KEY = "A-Za-z0-9+/_-"
# Words that name a secret, words that name a digest or an id, paths of examples, and a small dictionary.
NAMES = "token password passwd pwd secret key apikey api_key access auth credential private bearer".split()
#: A candidate is a run of key characters, or after a word that names a secret any run of six signs without its closing
#: punctuation. The word before is looked back at, not matched, since it may be a candidate itself.
BEFORE = r"(?<=(?<![^\s\"'=:])([^\s\"'=:]{1,24})(\s{0,4}[=:]\s{0,4}[\"']?|\s{1,4}[\"']?))"
AFTER_NAME = rf"(?<=[\s=:\"'])(?=[^\s\"'=:][^\s\"']{{5}})(?<=(?i:{'|'.join(NAMES)})(?:\s{{0,4}}[=:]\s{{0,4}}|\s)[\"']?)(?=[^\s\"'=:])"
WIDE = r"[^\s\"']{5,}[^\s\"'.,;:)\]}>]"
RUN = rf"(?<![{KEY}])[{KEY}]{{12,}}"
NEXT = r"(?=[\"']?[\s,;.)]{0,4}([^\s\"'=:]{1,24})?)"
PATTERN = rf"(?<![{KEY}])(?=(?:{RUN}|{AFTER_NAME}{WIDE}))(?:{BEFORE})?((?:{RUN}(?![^\s\"'.,;:)\]}}>]))|{AFTER_NAME}{WIDE}|{RUN}){NEXT}"
DIGESTS = "sha1 sha256 sha512 md5 commit revision checksum digest etag uuid guid hash build version".split()
EXAMPLES = "test tests example examples sample fixture fixtures mock docs".split()
DICTIONARY = (
    "about account action address admin after agent array article balance block board book build button cache call card center change chapter class client cloud code color "
    "column commit config content control count create data date default detail device document domain driver edit email error event example export field file filter first "
    "folder font form format frame function game global group handle header height home host http image import index info input item java label large layer layout left level "
    "library light line link list local lock login mail main manager map mask menu message method mode model module month name network node note number object office option "
    "order output page panel paper paragraph parent part patch path phone photo plan point port post price print process product profile program project query read record "
    "release report request response result right root route sample schema score screen script search section select server service session sheet shop side site size small "
    "source space start state status store stream string style summary support switch system table target task team template test text theme thread time title tool total "
    "track type unit update upload user value vector version video view volume widget width window word world"
).split()
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
FEATURES = ("length", "letters_follow", "changes", "case_changes", "digit_share", "upper_share", "hex_only", "distinct_share", "covered", "example_path", "depth", "named", "digest", "assigned", "quoted", "named_after")


def transitions() -> list[float]:
    """Log-probabilities of one character after another, in dictionary words and decimal numbers, add-half smoothed."""
    n = len(ALPHABET)
    count = np.full((n, n), 0.5)
    for word in [*DICTIONARY, *(str(7919 * i) for i in range(1, 60))]:
        for a, b in zip(word, word[1:]):
            count[ALPHABET.index(a), ALPHABET.index(b)] += 1
    return np.log(count / count.sum(1, keepdims=True)).ravel().round(4).tolist()


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(words: list[str]) -> str:
    return "(" + ", ".join(map(_sql, words)) + ")"


def described(text: Column, path: Column) -> Column:
    """Array of structs with each candidate of a text, and its features."""
    table = "array(" + ",".join(f"{x}D" for x in transitions()) + ")"
    code = f"transform(filter(split(lower(c.cand), ''), z -> z rlike '[a-z0-9]'), z -> instr({_sql(ALPHABET)}, z) - 1)"
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(i)).alias(name) for i, name in ((1, "prev"), (2, "sign"), (3, "cand"), (4, "next"))]
    parts = F.arrays_zip(*found)
    size = "CAST(length(c.cand) AS DOUBLE)"
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    share = lambda keep: f"length(regexp_replace(c.cand, '[^{keep}]', '')) / {size}"
    features = {
        "length": size,
        "letters_follow": f"aggregate(sequence(1, size(k) - 1), 0D, (a, i) -> a + element_at({table}, CAST(element_at(k, i) * {len(ALPHABET)} + element_at(k, i + 1) + 1 AS INT)), a -> a / (size(k) - 1))",
        "changes": f"regexp_count(c.cand, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])') / {size}",
        "case_changes": f"regexp_count(c.cand, '[a-z](?=[A-Z])|[A-Z](?=[a-z])') / {size}",
        "digit_share": share("0-9"),
        "upper_share": share("A-Z"),
        "hex_only": "CAST(c.cand rlike '^([0-9a-f]+|[0-9A-F]+)$' AS DOUBLE)",
        "distinct_share": f"size(array_distinct(split(c.cand, ''))) / {size}",
        "covered": f"1D - length(regexp_replace(lower(c.cand), '{words}', '')) / {size}",
        "example_path": f"CAST(arrays_overlap(split(lower(p), '[^a-z]+'), array{_any(EXAMPLES)}) AS DOUBLE)",
        "depth": "CAST(size(split(p, '/')) AS DOUBLE)",
        "named": f"CAST(lower(c.prev) IN {_any(NAMES)} OR lower(c.prev) rlike '(token|secret|password|key)$' AS DOUBLE)",
        "digest": f"CAST(lower(c.prev) IN {_any(DIGESTS)} AS DOUBLE)",
        "assigned": "CAST(c.sign rlike '[=:]' AS DOUBLE)",
        "quoted": "CAST(c.sign rlike '[\"\\']' AS DOUBLE)",
        "named_after": f"CAST(lower(c.next) rlike '^({'|'.join(NAMES)})\\\\W*$' AS DOUBLE)",
    }
    body = ", ".join(f"'{k}', {v}" for k, v in features.items())
    return F.struct(parts.alias("parts"), F.coalesce(path, F.lit("")).alias("path")), (
        f"transform(parts, c -> named_struct('cand', c.cand, 'prev', c.prev, 'next', c.next, 'f', element_at(transform(array({code}), k -> "
        f"CASE WHEN size(k) > 1 THEN named_struct({body}) ELSE named_struct({body.replace(features['letters_follow'], '0D')}) END), 1)))"
    ).replace("lower(p)", "lower(path)").replace("split(p,", "split(path,")


def candidates(docs: DataFrame, text_col: str, path_col: str | None) -> DataFrame:
    """docs with ``__found``: candidates and their features."""
    first, rest = described(F.col(f"`{text_col}`"), F.col(f"`{path_col}`") if path_col else F.lit(""))
    return docs.withColumn("__parts", first).withColumn("__found", F.expr(rest.replace("transform(parts,", "transform(__parts.parts,", 1).replace("lower(path)", "lower(__parts.path)").replace("split(path,", "split(__parts.path,"))).drop("__parts")


def labelled_findings(seed: int = 7, each: int = 220) -> list[tuple[str, str, int]]:
    """Texts with one candidate, their paths, and whether it is a secret: a bounded training set made by rule."""
    rng = np.random.default_rng(seed)
    chars = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "digits": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "vowels": "aeiou", "consonants": "bcdfghklmnprstvw", "punctuation": "!@#$%&*?"}
    chars |= {"letters": chars["lower"] + chars["capitals"], "signs": chars["base62"] + chars["punctuation"]}
    draw = lambda kind, n: "".join(rng.choice(list(chars[kind]), n))
    pick = lambda xs: str(rng.choice(xs))
    filler = lambda: pick([draw("lower", int(rng.integers(2, 9))), pick(DICTIONARY), "the", "of"])
    n = lambda a, b: int(rng.integers(a, b))

    def digit(s: str) -> str:
        return s if any(ch.isdigit() for ch in s) else s[:-1] + draw("digits", 1)

    sign = lambda: pick([" = ", "=", ": ", ":"])
    quote = lambda s: s if rng.random() < 0.5 else f'"{s}"'
    lower_or_upper = lambda s: s.upper() if rng.random() < 0.25 else s
    secret = (
        lambda: pick(NAMES) + sign() + quote(lower_or_upper(digit(draw("hex", n(16, 65))))),
        lambda: pick(NAMES) + sign() + quote(draw("base62", n(16, 48))),
        lambda: filler() + " " + "AKIA" + draw("upper", 16),
        lambda: filler() + " " + pick(["ghp_", "sk-", "xoxb-", "glpat-"]) + draw("base62", n(20, 40)),
        lambda: filler() + pick([" ", " = "]) + quote(lower_or_upper(digit(draw("hex", 40)))),
        lambda: pick(NAMES) + sign() + quote(draw("signs", n(8, 20)) + draw("base62", 1)),
        lambda: pick(NAMES) + sign() + quote(leet() + draw("punctuation", n(1, 3)) + draw("digits", n(0, 4)) + draw("base62", 1)),
        lambda: pick(NAMES) + sign() + quote(draw("base62", n(8, 16))),
        lambda: pick(NAMES) + sign() + quote(draw(pick(["letters", "capitals"]), n(16, 40))),
        lambda: filler() + " AKIA" + draw("capitals", 16),
        lambda: filler() + " " + quote(draw("base62", n(20, 44))) + " " + pick(NAMES),
    )
    harmless = (
        lambda: filler() + " " + draw("digits", n(12, 20)),
        lambda: filler() + " " + pick(DICTIONARY) + pick(["-", "_", "/", ""]) + pick(DICTIONARY) + pick(["-", "_", ""]) + pick(DICTIONARY) + draw("digits", n(1, 5)),
        lambda: pick(DIGESTS) + pick([" ", ": ", "="]) + digit(draw("hex", pick_n((32, 40, 64)))),
        lambda: filler() + pick([" ", "="]) + "-".join(draw("hex", k) for k in (8, 4, 4, 4, 12)) + "1",
        lambda: filler() + " 20" + draw("digits", 2) + "-0" + draw("digits", 1) + "-1" + draw("digits", 1) + "_" + pick(DICTIONARY),
        lambda: pick(NAMES) + sign() + pick(["changeme12345", "your_token_here_1", "xxxxxxxxxxxx1", "example-password-1", "placeholder_key_01", "000000000000"]),
        lambda: pick(NAMES) + " " + long_word(),
        lambda: pick(NAMES) + sign() + pick(["changeme", "password", "example", "your_password", "<password>", "${TOKEN}", "required", "optional", "https://" + pick(DICTIONARY) + ".com/" + pick(DICTIONARY)]),
        lambda: filler() + " " + pick(DICTIONARY) + pick(DICTIONARY) + pick(DICTIONARY) + "ing",
        lambda: filler() + " " + spoken(n(5, 9)),
        lambda: filler() + " " + "".join(pick(DICTIONARY).capitalize() for _ in range(3)) + "Factory",
        lambda: filler() + " " + pick(list("/-_")).join(["module", *(pick(DICTIONARY) for _ in range(n(2, 5)))]),
        lambda: filler() + " " + pick(list("x-_=a+/")).replace("=", "-") * n(12, 80),
        lambda: pick(["", "export ", "const ", filler() + " "]) + "_".join(pick([*DICTIONARY, *NAMES, "id", "aws", "db"]) for _ in range(n(3, 5))).upper() + pick(["", "x"]),
        lambda: filler() + " " + pick(["", "'"]) + (pick(DICTIONARY) + pick(DICTIONARY) + pick(["ization", "ing", "ed", "able"])).capitalize(),
        lambda: filler() + " " + pick([draw("digits", n(12, 20)), pick(DICTIONARY) + pick(DICTIONARY) + pick(DICTIONARY)]) + " " + pick(NAMES),
    )
    leet = lambda: pick(DICTIONARY).replace("a", "@").replace("o", "0").replace("e", "3")
    long_word = lambda: pick([w for w in DICTIONARY if len(w) >= 6])
    spoken = lambda k: "".join(draw("consonants", 1) + draw("vowels", 1) + pick(["", "n", "r", "s"]) for _ in range(k)) + "nden"
    pick_n = lambda xs: int(rng.choice(xs))
    out = []
    for label, kinds in ((1, secret), (0, harmless)):
        for make in kinds:
            for _ in range(each):
                path = pick(["", "src", "src/main/app", "etc/conf", "lib/util"] + (["tests/data", "docs/example"] if label == 0 else []))
                text = make()
                out.append((text if text.split()[-1] in NAMES else text + pick(["", " ", ", ", ". "]).rstrip(" ") + " " + filler(), path, label))
    return out


class Forest:
    """Random forest of small trees: Gini splits over random features, bootstrapped rows."""

    def __init__(self, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 11):
        self.trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.nodes = []
        for _ in range(self.trees):
            rows = self.rng.integers(0, len(x), len(x))
            self.nodes.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if not depth or len(y) < 2 * self.least or share in (0.0, 1.0):
            return share
        best = (1e-9, None, None)
        for f in self.rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= self.least) & (at <= len(y) - self.least)]
            if not len(at):
                continue
            a, b = hits[at - 1] / at, (hits[-1] - hits[at - 1]) / (len(y) - at)
            gain = share * (1 - share) - (at * a * (1 - a) + (len(y) - at) * b * (1 - b)) / len(y)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[at[i] - 1] + v[at[i]]) / 2)
        _, f, t = best
        if f is None:
            return share
        low = x[:, f] <= t
        return int(f), float(t), self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        def walk(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([np.mean([walk(t, row) for t in self.nodes]) for row in x])

    def sql(self, names: tuple[str, ...], row: str) -> str:
        """The mean of the trees as an SQL expression over fields of a struct."""

        def case(node) -> str:
            if not isinstance(node, tuple):
                return f"{node!r}D"
            f, t, low, high = node
            return f"CASE WHEN {row}.{names[f]} <= {t!r}D THEN {case(low)} ELSE {case(high)} END"

        return "(" + " + ".join(case(t) for t in self.nodes) + f") / {len(self.nodes)}"


def train(spark: SparkSession, findings: list[tuple[str, str, int]] | None = None) -> Forest:
    """A forest from labelled findings; their number bounds what the driver holds."""
    rows = spark.createDataFrame(findings or labelled_findings(), "text string, path string, label int")
    table = candidates(rows, "text", "path").select("label", F.try_element_at("__found", F.lit(-1)).alias("c")).where("c is not null").select("label", *[f"c.f.{n}" for n in FEATURES]).collect()
    data = np.array([tuple(map(float, r)) for r in table])
    return Forest().fit(data[:, 1:], data[:, 0])


def scan(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """docs with n_candidates and findings, an array of (secret, word before, word after, score)."""
    forest = forest or train(docs.sparkSession)
    scored = F.expr(f"transform(__found, c -> named_struct('secret', c.cand, 'prev', c.prev, 'next', c.next, 'score', {forest.sql(FEATURES, 'c.f')}))")
    return (
        candidates(docs, text_col, path_col)
        .withColumn("n_candidates", F.size("__found"))
        .withColumn("findings", F.filter(scored, lambda c: c["score"] >= threshold))
        .drop("__found")
    )


def redacted(text_col: str = "text") -> Column:
    """The text with each finding masked."""
    secrets = F.array_distinct(F.transform("findings", lambda c: c["secret"]))
    text = F.col(f"`{text_col}`")
    return F.when(F.size("findings") > 0, F.aggregate(F.sort_array(secrets, asc=False), text, lambda acc, s: F.replace(acc, s, F.lit(MASK)))).otherwise(text)


def stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the same rows and columns, secrets masked in the texts."""
    from .quality_rules import with_lengths

    return with_lengths(scan(docs, path_col="source" if "source" in docs.columns else None).withColumn("text", redacted()).drop(*OUT))
