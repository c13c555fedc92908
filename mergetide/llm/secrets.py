"""Secret scans whose false positives a random forest removes (DataFrame and SQL functions only).

A pattern finds candidates (long runs with a digit, values after ``=``, ``:`` or a hint word, passwords in addresses); splitting the text by the same
pattern gives what stands around each.  A forest trained on labelled findings judges a candidate by its
length, character transitions, dictionary coverage, path and neighbouring words.  The trained trees become one
SQL expression, so scanning is a projection: no shuffle, no Python, a text's candidates stay in its row.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: In this order: the password of an address; a quoted value and a bare one after ``=`` or ``:``; a value after a hint word; a
#: long run with a digit.  A bare value ends where the next name and value begin.  Short lookbehinds first, as they rule most places out.
CANDIDATE = (
    r"""(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@"']{3,}+(?=@)"""
    r"""|(?<=["'])(?<=[=:]>?\s{0,8}["'])[^\s"']{6,}+"""
    r"""|(?<=[=:>\s])(?<=[=:]>?\s{0,8})(?!//)(?:(?![&;,]\w{1,40}[=:])[^\s"'=:>]|(?<=[^\s=:>])[=:>](?!//)){6,}+"""
    r"""|(?<=\s)(?<=\b(?i:passw(?:or)?d|pwd|passphrase|token|secret|bearer|credentials?|api_?key|key|auth)\s{1,2})[^\s"'=:][^\s"'=:]{5,}+"""
    r"""|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"""
)
#: Characters of the text before and after a candidate that are looked at.
BEFORE, AFTER = 60, 30
TREES, DEPTH, SEED, FINDINGS, THRESHOLD = 20, 6, 7, 1600, 0.5
MASK = "[SECRET]"

# Words of identifiers and prose, hints of a secret and of harmless values.
DICTIONARY = (
    "access account action address admin agent alpha array asset async attribute author background base before beta block body border bucket buffer build "
    "button cache call change channel check child class client cloud code color column command comment common component config connection container content "
    "context control count create data database date debug default delete detail device dialog directory display document domain driver element email "
    "enable encode engine entry error event example exception export factory feature field file filter folder format frame from function get global group "
    "handler header height helper here host image import index info input instance interface internal item json key label language layer layout length level "
    "library line link list load local location login main manager master message method model module month name network node note number object offset "
    "option order output package page panel param parent password path pattern payload person placeholder plugin point policy port position post prefix process product profile "
    "project property provider proxy public query queue random range read record region release remote render replace report request resource response "
    "result return role root router row sample schema screen script search secret section select send server service session set setting shared simple site size "
    "source stack start state static status storage stream string style submit summary support switch system table target task template test text theme thread time title "
    "token tool total tree type update upload user util value vector version video view visit warning web widget width window word work write your"
)
HINTS = r"(?i)(key|token|secret|passw|pwd|passphrase|auth|credential|bearer|private)[^\n]{0,24}$|://[^\s/:@]{0,64}:$"
HARMLESS = r"(?i)\b(example|sample|dummy|placeholder|sha-?\d*|commit|checksum|md5|uuid|guid|hash|revision|digest|version|isbn|order|invoice|phone|card|etag|build|image|file|path|integrity|changeme)\b"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ)"
FEATURES = ("length", "transitions", "digits", "distinct", "dictionary", "path", "hint", "harmless", "assigned", "hexadecimal", "known", "run")


def features(candidate: Column, before: Column, after: Column) -> Column:
    """The array of FEATURES of one candidate."""
    n = F.length(candidate).cast("double")
    classes = candidate
    for pattern, to in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")):
        classes = F.regexp_replace(classes, pattern, to)
    words = "|".join(sorted(DICTIONARY.split(), key=lambda x: (-len(x), x)))
    yes = lambda text, pattern: F.when(text.rlike(pattern), 1.0).otherwise(0.0)
    return F.array(
        n,
        (F.length(classes) - 1) / F.greatest(n - 1, F.lit(1.0)),
        F.length(F.regexp_replace(candidate, "[^0-9]", "")) / n,
        F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(64.0)),
        1 - F.length(F.regexp_replace(F.lower(candidate), words, "")) / n,
        n - F.length(F.translate(candidate, "/\\.", "")) + yes(before, r"[/\\.@#?&]$"),
        yes(before, HINTS),
        yes(F.concat(before, F.lit(" "), after), HARMLESS),
        yes(before, r"[=:]>?\s{0,8}[\"']?$"),
        yes(candidate, "^[0-9a-fA-F]+$"),
        yes(candidate, KNOWN),
        yes(F.lower(candidate), r"(.)\1{4}|1234567|abcdef[^0-9]"),
    )


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, secret or not): findings as reviewers label them, made by rule."""
    r = random.Random(seed)
    words = DICTIONARY.split()
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k - 1)) + r.choice("0123456789")
    some = lambda k: [r.choice(words) for _ in range(k)]
    letters = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if r.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz", k=k))
    spoken = lambda: "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s"]) for _ in range(r.randint(3, 5))) + r.choice(["", "ing", "ed", ",", "."])
    short = lambda: r.choice([lambda: mixed(r.randint(7, 12)), lambda: mixed(r.randint(5, 7)) + r.choice("!#$%*^") + mixed(r.randint(3, 5)), lambda: spoken().rstrip(",.")[:8] + str(r.randint(1, 9999)) + letters(r.randint(0, 3)).lower()])()
    code = lambda: r.choice([lambda: ".".join(some(2)) + "_".join(some(2)) + r.choice(["()", "();", "(user)"]), lambda: "${" + "_".join(some(2)).upper() + "}", lambda: "<" + "_".join(some(2)) + ">", lambda: r.choice("*x.-") * r.randint(6, 12), lambda: "_".join(some(2)), lambda: r.choice(words).title() + r.choice(words).title()])()
    out = []
    for i in range(n):
        lead = " ".join(some(r.randint(0, 5))) + r.choice(["", "\n", " "])
        tail = r.choice(['"', "", "'", "\n"]) + " " + " ".join(some(r.randint(0, 3)))
        if i % 2:
            value = r.choice([lambda: hexes(r.choice([32, 40, 48, 64])), lambda: mixed(r.randint(20, 48)), lambda: mixed(r.randint(10, 19)), lambda: "AKIA" + mixed(16).upper(), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(40), lambda: mixed(30) + "/" + mixed(9) + "+" + mixed(6) + "=="])()
            hint = r.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "auth_token", "SECRET_KEY", "access-key", "client_secret", "private_key"])
            before = lead + hint + r.choice([' = "', '="', ": '", "=", ": ", ' := "', '": "']) if r.random() < 0.85 else lead + r.choice(["Authorization: Bearer ", "credentials ", "auth "])
            if value.startswith(("AKIA", "ghp_", "sk-")) and r.random() < 0.4:
                before = lead
            if r.random() < 0.2 and not value.startswith(("AKIA", "ghp_", "sk-")):
                value, before = value.upper(), before.upper()
            known = value.startswith(("AKIA", "ghp_", "sk-"))
            if i % 8 == 1 and not known:  # bare values
                value, before = r.choice([short, short, lambda: letters(r.randint(16, 32))])(), lead + r.choice(["DB_PASSWORD=", "password: ", "passwd=", "pwd: ", "api_key=", "token: ", "secret=", "password ", "AUTH_TOKEN=", "password=", "client_secret: "])
            elif i % 16 == 3 and not known:  # addresses
                value, before, tail = short(), lead + r.choice(["postgres", "https", "mysql", "redis", "amqp", "ftp"]) + "://" + r.choice([*some(1), "u", ""]) + ":", f"@{r.choice(words)}/{r.choice(words)}"
            out.append((value, before, tail, 1))
        else:
            value, before = r.choice([
                lambda: (hexes(40), lead + r.choice(["commit ", "revision ", "sha1: ", "Merge commit "])),
                lambda: ("-".join(map(hexes, (8, 4, 4, 4, 12))), lead + r.choice(["uuid=", "id: ", "guid ", ""])),
                lambda: (hexes(32), lead + r.choice(["md5 ", "checksum: ", "hash = \"", "etag: \""])),
                lambda: ("/".join(some(r.randint(3, 6))) + str(r.randint(1, 99)), lead + r.choice(["/", "path ", "https://www.", "file = \"/"])),
                lambda: ("_".join(some(r.randint(2, 5))) + str(r.randint(1, 2024)), lead + r.choice(["", "def ", "key = \"", "token: "])),
                lambda: ("".join(x.title() for x in some(r.randint(3, 5))) + str(r.randint(1, 9)), lead),
                lambda: ("-".join(["your", *some(r.randint(2, 3)), "here", "123"]), lead + r.choice(['api_key = "', 'token = "', "password: '"])),
                lambda: (r.choice(["x", "0", "X", "a"]) * r.randint(16, 30) + "1", lead + r.choice(['token = "', "key=", ""])),
                lambda: ("".join(r.choices("0123456789", k=r.randint(16, 20))), lead + r.choice(["card ", "order ", "", "phone "])),
                lambda: (f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}", lead),
                lambda: (mixed(43) + "=", lead + r.choice(["integrity=\"sha256-", "digest ", "image base64 "])),
                lambda: ("".join(some(2)), lead + r.choice(['password = "', "secret: '", 'key="'])),
                lambda: (r.choice(["https://", "http://www."]) + "/".join(some(3)), lead + r.choice(['href="', 'url = "', 'src: "'])),
            ])()
            if i % 8 == 2:  # bare values: prose, code and what no hint stands before
                named = lead + r.choice(["password: ", "token = ", "key: ", "secret=", "the key ", "secret ", "auth: ", "token ", "password = "])
                plain = lead + r.choice(["note", "see", "at 10", "width", "id", "x", *some(2)]) + r.choice([": ", "=", ":", " = "])
                value, before = r.choice([lambda: (spoken(), named), lambda: (r.choice(words) + r.choice(words), named), lambda: (code(), named), lambda: (spoken(), plain), lambda: (code(), plain), lambda: (short(), plain), lambda: (f"{r.randint(10, 59)}:{r.randint(10, 59)}:{r.randint(10, 59)}", plain)])()
            out.append((value, before, tail, 0))
    return [(v, b[-BEFORE:], a[:AFTER], y) for v, b, a, y in out]


def _tree(lines: list[str]) -> str:
    """A tree of the model's printed form as SQL over the array ``x``; takes its lines from the front."""
    line = lines.pop(0)
    if line.startswith("Predict: "):
        return line[9:]
    feature, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree(lines)
    lines.pop(0)
    return f"CASE WHEN x[{feature}] <= {bound}D THEN {yes}D ELSE {_tree(lines)}D END".replace("ENDD", "END")


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | DataFrame | None = None) -> str:
    """The forest as SQL over the feature array ``x``: the share of trees that take a candidate for a secret.

    ``findings``: candidate, before, after, secret (0 or 1), by default :func:`labelled_findings`.
    """
    if not isinstance(findings, DataFrame):
        findings = spark.createDataFrame(findings or labelled_findings(), "candidate string, before string, after string, secret int")
    rows = findings.select(array_to_vector(features(F.col("candidate"), F.col("before"), F.col("after"))).alias("features"), F.col("secret").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="sqrt").fit(rows.coalesce(1))
    trees, lines = [], [x.strip() for x in model.toDebugString.splitlines()]
    for i, x in enumerate(lines):
        if x.startswith("Tree "):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("Tree ")), len(lines))
            trees.append(_tree([y for y in lines[i + 1 : end] if y]))
    return f"({' + '.join(f'({t})' for t in trees)}) / {len(trees)}D"


def scan_columns(docs: DataFrame, forest: str) -> DataFrame:
    """Adds ``_mt_pieces``, the text between candidates, and ``_mt_found``, an array of (candidate, score); both null without a candidate."""
    text = docs["text"]
    out = docs.withColumn("_mt_all", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    out = out.withColumn("_mt_pieces", F.when(F.size("_mt_all") > 0, F.split(F.col("text"), CANDIDATE, -1)))
    here = F.transform(F.col("_mt_all"), lambda c, i: F.struct(c.alias("candidate"), F.right(F.get("_mt_pieces", i), F.lit(BEFORE)).alias("before"), F.left(F.get("_mt_pieces", i + 1), F.lit(AFTER)).alias("after")))
    out = out.withColumn("_mt_here", F.when(F.col("_mt_pieces").isNotNull(), here))
    out = out.withColumn("_mt_x", F.transform("_mt_here", lambda c: features(c["candidate"], c["before"], c["after"])))
    score = F.expr(f"transform(_mt_x, x -> {forest})")
    return out.withColumn("_mt_found", F.arrays_zip(F.col("_mt_all").alias("candidate"), score.alias("score"))).drop("_mt_all", "_mt_here", "_mt_x")


def scan(docs: DataFrame, forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ordinal, length, candidate, score, is_secret: a row for each candidate in each text.

    ``ordinal`` counts the candidates of a text from 0; ``score`` is the share of trees that vote for a secret.
    Null and empty texts have no candidates; rows that repeat an id give their candidates each.  An empty
    table gives an empty table.
    """
    found = scan_columns(docs.select("doc_id", "text"), forest or train(docs.sparkSession))
    # the outer form, as a plain explode filters by the array's size first and so finds candidates twice
    rows = found.select("doc_id", F.posexplode_outer("_mt_found").alias("ordinal", "x")).where("x is not null")
    return rows.select("doc_id", "ordinal", F.length("x.candidate").cast("long").alias("length"), "x.candidate", "x.score", (F.col("x.score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, forest: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret replaced by ``MASK``, and ``n_chars`` counted anew where a text has changed."""
    out = scan_columns(docs, forest or train(docs.sparkSession))
    keep = F.transform("_mt_found", lambda x: F.when(x["score"] >= threshold, F.lit(MASK)).otherwise(x["candidate"]))
    text = F.array_join(F.zip_with("_mt_pieces", keep, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    secret = F.exists("_mt_found", lambda x: x["score"] >= threshold)
    out = out.withColumn("text", F.when(secret, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(secret, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
