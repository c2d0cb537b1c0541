"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame functions.

Candidates are marked in the text and split out with their surroundings. The forest looks at length,
character transitions, dictionary coverage, path and neighbouring words. It is grown on the driver from a
bounded table of labelled findings and becomes one constant that an expression walks in the JVM.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A name that holds one of the words anywhere, and what stands before the value. Each part is possessive and
#: names begin where no name goes on, so that a long run is read once.
LEAD = r"[\w.-]++[\"']?[ \t]*+[:=][ \t]*+[\"']?"
ASSIGNMENT = (
    r"(?i:(?<![\w.-])(?=[\w.-]*?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential))" + LEAD + r")[^\s\"',;]{8,}"
)
#: Kinds of candidates in order: the first that matches at a place counts.
PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----",
    "aws_key": r"(?<![0-9A-Za-z_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z_])",
    "github_token": r"(?<![0-9A-Za-z_])gh[pousr]_[0-9A-Za-z]{36,}",
    "slack_token": r"(?<![0-9A-Za-z_])xox[abprs]-[0-9A-Za-z-]{10,}",
    "google_key": r"(?<![0-9A-Za-z_])AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"(?<![0-9A-Za-z_])[rs]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "web_token": r"(?<![0-9A-Za-z_])eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "assignment": ASSIGNMENT,
    "high_entropy": r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9A-Za-z+/_-]{24})(?![\w.+/-]*?" + ASSIGNMENT + r")[0-9A-Za-z+/_-]{24,}={0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
OPEN, CLOSE = "\x01", "\x02"
AROUND = 60
#: Characters before a value in which words speak against it.
NEAR = 30
#: Words of dictionary coverage: so many whole words of a public vocabulary, the commonest first, from this length on.
DICTIONARY_SIZE, DICTIONARY_LETTERS = 8_000, 4
#: What people write where a secret would stand, and common words; these are also found inside runs of letters.
WORDS = (
    "password passwd secret token example sample dummy test fake demo your placeholder change changeme insert here default admin user name "
    "value string null none true false undefined config settings local host domain client server service application database table field "
    "the and for with from this that have was are not you all can had her one our out day get has him his how man new now old see two way "
    "who boy did its let put say she too use time about water word there each which their will other many then them these some would make "
    "like into look more write number people over know than call first may down side been find long part module package index version build "
    "release master branch feature commit object class method function return import static public private final image icon style script"
).split()
SPEAKS_FOR = r"(?i)password|passwd|pwd|secret|token|api.?key|access.?key|credential|auth|bearer|login"
SPEAKS_AGAINST = r"(?i)example|sample|dummy|placeholder|your|changeme|sha-?\d|md5|checksum|digest|commit|revision|uuid|integrity|fingerprint|xxx|test"
PATHS = r"(?i)https?:/|www\.|/[a-z0-9_.-]+/|\\\\|\.(?:png|jpg|js|css|html|py|java|md|txt)(?![0-9A-Za-z_])"

FEATURES = (
    "length", "transitions", "digits", "uppers", "lowers", "symbols", "distinct", "coverage", "dictionary", "longest_run", "hexadecimal", "sequence",
    "for_before", "against_before", "against_after", "against_inside", "path_before", "path_inside", "test_path", "known_form",
)


def dictionary(path: str | None = None) -> list[str]:
    """Whole words of a public vocabulary in order of rank: DICTIONARY_SIZE of them, of ASCII letters alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as source:
        ranked = json.load(source)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in sorted(ranked, key=ranked.get) if w.endswith("</w>"))
    return [w for w in words if len(w) >= DICTIONARY_LETTERS and w.isascii() and w.isalpha()][:DICTIONARY_SIZE]


def _running(values: Column) -> Column:
    """Running sums of an array of whole numbers, by doubling: n log n steps, where gathering them one by one takes n squared."""
    doublings = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(
        doublings, values.cast("array<bigint>"), lambda acc, d: F.transform(acc, lambda x, i: x + F.when(i >= d, F.get(acc, i - d)).otherwise(F.lit(0).cast("bigint")))
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``id, path, start, kind, before, value, after``: every place where a pattern matches, a row per place.

    ``start`` counts characters from 0. Texts are scanned whole: patterns read a run of characters once, whatever its length, and
    many candidates of one text are split out in about linear time. Values come whole too; ``before`` and ``after`` are the AROUND
    characters on either side.
    """
    path = docs[path_col].cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(path, F.lit("")).alias("path"), docs[text_col].cast("string").alias("text")).where(F.col("text").rlike(ANY))
    clean = F.translate("text", OPEN + CLOSE, "  ")
    marked = rows.select("id", "path", F.split(F.regexp_replace(clean, ANY, f"{OPEN}$0{CLOSE}"), OPEN).alias("parts")).where(F.size("parts") > 1)
    parts = F.col("parts")
    # Each part but the first begins with a candidate and one closing mark.
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part, k: F.length(part) - F.when(k > 0, 1).otherwise(0))
    found = F.transform(
        F.slice(parts, 2, F.size(parts)),
        lambda part, k: F.struct(
            F.substring_index(part, CLOSE, 1).alias("match"),
            F.substring(F.substring_index(part, CLOSE, -1), 1, AROUND).alias("after"),
            F.substring(F.substring_index(F.get(parts, k), CLOSE, -1), -AROUND, AROUND).alias("before"),
        ),
    )
    split_out = marked.select("id", "path", F.explode(F.arrays_zip(found.alias("c"), _running(lengths).alias("at"))).alias("z")).select(
        "id", "path", F.col("z.c.match").alias("match"), F.col("z.c.before").alias("before"), F.col("z.c.after").alias("after"), F.col("z.at").alias("at")
    )
    match = F.col("match")
    kind = F.lit("high_entropy")
    for name, pattern in reversed(list(PATTERNS.items())):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    lead = F.regexp_extract(match, f"^{LEAD}", 0)
    return (
        split_out.withColumn("kind", kind)
        .withColumn("lead", F.when(F.col("kind") == "assignment", lead).otherwise(F.lit("")))
        .select(
            "id", "path", (F.col("at") + F.length("lead")).cast("long").alias("start"), "kind",
            F.concat("before", "lead").alias("before"), F.substring(match, F.length("lead") + 1, 1 << 30).alias("value"), "after",
        )
    )


def feature_columns(words: list[str]) -> dict[str, Column]:
    """The features of FEATURES over value, before, after, path and kind, as numbers; each reads the value once."""
    value, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    share = lambda pattern: (size - F.length(F.regexp_replace(value, pattern, ""))) / size
    flag = lambda column: column.cast("double")
    fixed = "|".join(sorted(WORDS, key=len, reverse=True))
    letters = F.transform(F.split(value, ""), F.ascii)
    kinds = F.transform(letters, lambda c: F.when(c.between(48, 57), 0).when(c.between(65, 90), 1).when(c.between(97, 122), 2).otherwise(3))

    def steps(values: Column, of) -> Column:
        """``of`` two neighbours, for all neighbours."""
        rest = F.greatest(F.size(values) - 1, F.lit(0))
        return F.zip_with(F.slice(values, 1, rest), F.slice(values, 2, rest), of)

    count = lambda marks: F.size(F.filter(marks, lambda m: m))
    # Places before which the letter changes, and both ends: the longest run is the widest gap.
    changes = F.concat(
        F.array(F.lit(0)), F.filter(F.transform(steps(letters, lambda a, b: a != b), lambda m, i: F.when(m, i + 1).otherwise(0)), lambda i: i > 0), F.array(F.length("value"))
    )
    runs = F.filter(F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]++"), lambda w: F.length(w) >= DICTIONARY_LETTERS)
    known = F.filter(runs, lambda w: w.isin(words)) if words else F.slice(runs, 1, 0)
    return {
        "length": size.cast("double"),
        "transitions": count(steps(kinds, lambda a, b: a != b)) / size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^0-9A-Za-z]"),
        "distinct": F.size(F.array_distinct(letters)) / F.least(size, F.lit(40)),
        "coverage": (size - F.length(F.regexp_replace(F.lower(value), f"(?:{fixed})", ""))) / size,
        "dictionary": F.length(F.array_join(known, "")) / size,
        "longest_run": F.coalesce(F.array_max(steps(changes, lambda a, b: b - a)), F.lit(0)) / size,
        "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "sequence": count(steps(letters, lambda a, b: b - a == 1)) / size,
        "for_before": flag(F.col("before").rlike(SPEAKS_FOR)),
        "against_before": flag(F.substring("before", -NEAR, NEAR).rlike(SPEAKS_AGAINST)),
        "against_after": flag(F.col("after").rlike(SPEAKS_AGAINST)),
        "against_inside": flag(value.rlike(SPEAKS_AGAINST)),
        "path_before": flag(F.col("before").rlike(PATHS)),
        "path_inside": flag(value.rlike("/.*/")),
        "test_path": flag(F.col("path").rlike("(?i)test|example|sample|fixture|docs?/")),
        "known_form": flag(~F.col("kind").isin("assignment", "high_entropy")),
    }


def with_features(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """The candidates with an array ``x`` of their features; ``words`` are the dictionary. The generator keeps the optimizer from
    repeating the feature expressions at every comparison of the forest."""
    columns = feature_columns(dictionary() if words is None else words)
    x = F.array(*[columns[name].cast("double") for name in FEATURES])
    return found.select("*", F.explode(F.array(x)).alias("x"))


def labelled_findings(count: int = 4000, seed: int = 7) -> list[dict]:
    """Findings with their labels: true secrets of each kind, and what looks like them and isn't."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    prose = ["as the", "is in", "and then", "on it", "of these", "we saw", "und der", "de la", "que los", "dans une"]
    names = ["password", "token", "secret", "api_key", "access_key", "passwd"]
    out = []
    for _ in range(count):
        before, after, path = rng.choice(prose) + " ", " " + rng.choice(prose), f"src{rng.randrange(20)}"
        if rng.random() < 0.15:  # words that speak against a value stand near true ones too
            before = rng.choice(["mail a@example.com ", "the test ", "see your "]) + rng.choice(prose) + " " + before
        true = rng.random() < 0.5
        assign = f"{rng.choice(names)}{rng.choice(['=', ' = ', ': ', '=\"'])}"
        if true:
            form = rng.randrange(8)
            kind, value = [
                ("private_key", "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----"),
                ("aws_key", "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
                ("github_token", "ghp_" + of(alnum, 36)),
                ("assignment", of("0123456789abcdef", rng.choice([16, 18, 24, 32, 40, 64]))),
                ("assignment", of(alnum + "!@#%^&*", rng.randrange(8, 33))),
                ("stripe_key", "sk_live_" + of(alnum, 24)),
                ("high_entropy", of(alnum + "+/", 40)),
                ("web_token", f"eyJ{of(alnum, 20)}.eyJ{of(alnum, 40)}.{of(alnum, 43)}"),
            ][form]
            if kind == "assignment":
                before += assign
            elif kind == "high_entropy":
                before += rng.choice(["secret key ", "credential ", "auth token "])
        else:
            form = rng.randrange(10)
            words = [rng.choice(WORDS) for _ in range(6)]
            kind, value = [
                ("assignment", rng.choice(["your_", "my_", "<insert_", "example_", "changeme_"]) + "_".join(words[:2])),
                ("assignment", rng.choice(["x", "*", "0", "a"]) * rng.randrange(8, 30)),
                ("assignment", rng.choice(["".join(words[:3]), "${" + words[0].upper() + "_" + words[1].upper() + "}", words[0] + "." + words[1] + "()", "os.environ[" + words[2]])),
                ("high_entropy", of("0123456789abcdef", rng.choice([32, 40, 64]))),
                ("high_entropy", "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))),
                ("high_entropy", "/".join(words[:4]) + str(rng.randrange(1000))),
                ("high_entropy", "_".join(words[:5]) + str(rng.randrange(100))),
                ("assignment", "12345678" + of("0123456789", rng.randrange(0, 4))),
                ("aws_key", "AKIA" + rng.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEEXAMPLE00"])),
                ("high_entropy", of("0123456789", rng.randrange(24, 40))),
            ][form]
            if kind == "assignment":
                before += assign
            elif form in (3, 4):
                before += rng.choice(["sha256 ", "commit ", "md5 checksum ", "uuid ", "revision ", "digest: "])
            if rng.random() < 0.3:
                path = rng.choice(["tests/fixtures", "docs/example", "samples/"])
        out.append({"path": path, "kind": kind, "before": before, "value": value, "after": after, "label": int(true)})
    return out


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1 and its share of true findings."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    share: list[float]


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 5) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, level: int) -> int:
        number = len(tree.feature)
        for values, value in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.share, float(y[rows].mean()))):
            values.append(value)
        best = None
        if level < depth and 0 < y[rows].mean() < 1:
            for f in sorted(rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 1)), replace=False)):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, up = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(order))
                a, b = up[:-1] / n, (up[-1] - up[:-1]) / (len(order) - n)
                impurity = n * a * (1 - a) + (len(order) - n) * b * (1 - b)
                ok = (v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least)
                if ok.any():
                    k = int(np.flatnonzero(ok)[np.argmin(impurity[ok])])
                    if best is None or impurity[k] < best[0]:
                        best = impurity[k], int(f), float((v[k] + v[k + 1]) / 2)
        if best:
            _, tree.feature[number], tree.cut[number] = best
            low = x[rows, tree.feature[number]] <= tree.cut[number]
            tree.left[number] = node(rows[low], level + 1)
            tree.right[number] = node(rows[~low], level + 1)
        return number

    node(rng.integers(0, len(x), len(x)), 0)
    return tree


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 7, seed: int = 3) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [grow_tree(x, y, rng, depth) for _ in range(trees)]


def forest_score(forest: list[Tree], x: Column) -> Column:
    """Mean share of the leaves that the features reach. The trees are one constant of arrays, so the expression is as
    small as a single step of a walk, whatever the forest's size."""
    shape = "array<struct<feature:array<int>,cut:array<double>,left:array<int>,right:array<int>,share:array<double>>>"
    trees = F.from_json(F.lit(json.dumps([vars(tree) for tree in forest])), shape)
    deepest = max((_depth(tree) for tree in forest), default=0)

    def step(tree: Column, at: Column) -> Column:
        feature = F.get(tree["feature"], at)
        return F.when(feature < 0, at).when(F.get(x, feature) <= F.get(tree["cut"], at), F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))

    leaf = lambda tree: F.aggregate(F.sequence(F.lit(0), F.lit(deepest)), F.lit(0), lambda at, _: step(tree, at))
    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + F.get(tree["share"], leaf(tree))) / max(len(forest), 1)


def _depth(tree: Tree, at: int = 0) -> int:
    return 0 if tree.feature[at] < 0 else 1 + max(_depth(tree, tree.left[at]), _depth(tree, tree.right[at]))


def train_forest(spark: SparkSession, findings: list[dict] | None = None) -> list[Tree]:
    """The forest of the labelled findings, whose features come from the same expressions as those of candidates."""
    findings = labelled_findings() if findings is None else findings
    shape = "array<struct<path:string,kind:string,before:string,value:string,after:string,label:int>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings)), shape)).alias("r")).select("r.*")
    rows = with_features(table).select("x", "label").collect()
    return grow_forest(np.array([r["x"] for r in rows], float), np.array([r["label"] for r in rows], float))


def scan_secrets(docs: DataFrame, forest: list[Tree] | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``id, start, kind, value, score, is_secret``: every candidate, with the forest's score.

    Null and empty texts have no candidates. Repeated rows are scanned each, null ids pass through, an empty
    table gives an empty result, other columns are ignored; without a path column paths are empty. A place has one
    candidate, that of the first kind that matches there; candidates don't overlap.
    """
    forest = train_forest(docs.sparkSession) if forest is None else forest
    scored = with_features(candidates(docs, id_col, text_col, path_col)).withColumn("score", forest_score(forest, F.col("x")))
    return scored.select(F.col("id").alias(id_col), "start", "kind", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents; values only as their hashes."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "kind", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
