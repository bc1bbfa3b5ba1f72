"""Secret scan with a random forest that removes false positives.

DataFrame functions only: long runs of key characters with a digit, and what is
assigned to a name like "password" (any length, any signs but blanks and
quotes), are candidates.  A text is cut at them once, so that each has its own
place and neighbours.  Each candidate gets its length,
character transitions, distinct characters, dictionary coverage, known
prefixes, what the words before and after it say, and what the document's path
says.  A random forest over these, trained on a small table of labelled
findings that a rule makes (:func:`labelled_findings`), drops the false ones.

Findings carry the secret's SHA-256, never the secret.

Defined results: null and empty texts have no findings; a null path says
nothing; repeated rows are scanned like any other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refract.llm.common import read

#: A candidate: at least 16 key characters in a run (dots inside), with a digit.
RUN = r"[A-Za-z0-9+/_\-][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9+/_\-]={0,2}"
#: Words that tell what a neighbouring token is.
SECRET_WORDS = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential|key"
#: An assignment to one of these, and a value that follows it (looked at only
#: behind a separator, because looking back is slow).
ASSIGN = rf"(?i:(?:(?<![A-Za-z])(?:key|auth)|{SECRET_WORDS.removesuffix('|key').replace('auth|', '')})[\"'`]?[ \t]{{0,3}}(?::=|=>|==?|:)[ \t]{{0,3}})"
VALUE = (rf"(?:(?<=[\"'`])(?<={ASSIGN}[\"'`])[^\s\"'`]+(?=[\"'`])"
         rf"|(?<=[=:> \t])(?<={ASSIGN})[^\s\"'`,;<>&=]+={{0,2}})")
CANDIDATE = f"(?:{VALUE}|{RUN})"
#: Code points on each side in which neighbours are looked for; inside a word
#: without blanks they end at these signs.
NEAR = 200
FIELD = r",;{}()&|<>\[\]"
BEFORE = rf"(?:\S+\s+){{0,3}}[^\s{FIELD}]*[{FIELD}\"'`]*$"
AFTER = rf"^[^\s{FIELD}]*[{FIELD}\"'`.]*(?:\s+\S+){{0,2}}"
OTHER_WORDS = "commit|sha1|sha256|sha|md5|checksum|digest|hash|uuid|guid|revision|rev|build|version|id|etag|integrity|fingerprint"
TEST_PATHS = "test|example|sample|fixture|mock|docs?|demo"
#: Beginnings of issued keys.
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|ya29|eyJ|SG[.]|npm_|pypi-"
#: Words that fill placeholders and identifiers.
DICTIONARY = """example sample test dummy changeme placeholder your insert here password secret token key value string
user name file path config service client server request response handler manager factory default abstract
interface controller component module library index data type class function method object array number
version release build license copyright apache commons http https www html json image upload download
content public private static const error message button container section header footer""".split()

FEATURES = ["length", "transitions", "distinct", "digits", "uppers", "hexes", "dictionary", "slashes", "prefix", "uuid", "ascending",
            "before_secret", "before_other", "after_other", "path_test", "assigned", "named", "signs", "word", "code"]
TREES, DEPTH, FEATURE_SHARE = 30, 8, 0.5
THRESHOLD = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``id``, ``path``, ``start`` (code points), ``token``, ``before`` (up to
    three words and what precedes the token in its own field), ``after``."""
    d = docs.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path") if path_col else F.lit(None).cast("string").alias("path"),
                    F.col(text_col).alias("text"))
    d = d.where(F.col("text").rlike(f"{RUN}|{ASSIGN}"))
    # the slow pattern where something is assigned only
    found = F.when(F.col("text").rlike(ASSIGN), F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), 1)).otherwise(
        F.regexp_extract_all("text", F.lit(f"({RUN})"), 1))
    parts = F.when(F.col("text").rlike(ASSIGN), F.split("text", CANDIDATE, -1)).otherwise(F.split("text", RUN, -1))
    d = d.withColumn("tokens", found).where(F.size("tokens") > 0).withColumn("parts", parts)
    # ends of the parts before each token, for all tokens at once
    sizes = F.zip_with("parts", "tokens", lambda p, t: F.struct(F.length(p).alias("p"), F.coalesce(F.length(t), F.lit(0)).alias("t")))
    d = d.withColumn("sizes", sizes).select("id", "path", "tokens", "parts", "sizes", F.posexplode("tokens").alias("at", "token"))
    start = F.aggregate(F.slice("sizes", 1, F.col("at")), F.lit(0).cast("long"), lambda n, z: n + z["p"] + z["t"])
    part = lambda i: F.coalesce(F.get("parts", F.col("at") + i), F.lit(""))
    token = lambda i: F.coalesce(F.get("tokens", F.col("at") + i), F.lit(""))
    d = d.where(F.col("token").rlike("[0-9]") & (F.length("token") >= 16) | F.right(part(0), F.lit(NEAR)).rlike(f"{ASSIGN}[\"'`]?$")
                | (F.length(part(0)) < NEAR) & F.concat(token(-1), part(0)).rlike(f"{ASSIGN}[\"'`]?$"))
    return d.select("id", "path", (start + F.length(part(0))).alias("start"), "token",
                    F.regexp_extract(F.right(F.concat(F.right(part(-1), F.lit(NEAR)), token(-1), part(0)), F.lit(NEAR)), BEFORE, 0).alias("before"),
                    F.regexp_extract(F.left(F.concat(part(1), token(1), F.left(part(2), F.lit(NEAR))), F.lit(NEAR)), AFTER, 0).alias("after"))


def featured(c: DataFrame) -> DataFrame:
    """Candidates with the columns of :data:`FEATURES`."""
    t, n = F.col("token"), F.length("token").cast("double")
    low = F.lower(t)
    says = lambda col, words: F.coalesce(F.lower(col).rlike(rf"(^|[^a-z])({words})([^a-z]|$)"), F.lit(False)).cast("double")
    gone = F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    return c.withColumns({
        "length": n,
        "transitions": count("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])") / n,
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.sqrt(n),
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "hexes": count("[0-9a-fA-F]") / n,
        "dictionary": 1 - gone / n,
        "slashes": count("[/_\\-]") / n,
        "prefix": t.rlike(f"^({PREFIXES})").cast("double"),
        "uuid": t.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "ascending": low.rlike("0123456|1234567|abcdefg|(.)\\1{4}").cast("double"),
        "before_secret": says(F.col("before"), SECRET_WORDS),
        "before_other": says(F.col("before"), OTHER_WORDS),
        "after_other": says(F.col("after"), OTHER_WORDS),
        "path_test": says(F.col("path"), TEST_PATHS),
        "named": F.coalesce(F.col("before").rlike(f"{ASSIGN}[\"'`]?$"), F.lit(False)).cast("double"),
        "signs": count("[^A-Za-z0-9+/_.=-]") / n,
        "word": t.rlike("^[^A-Za-z0-9]*([A-Z]?[a-z]+|[A-Z]+)([_./-]([A-Z]?[a-z]+|[A-Z]+))*[^A-Za-z0-9]*$").cast("double"),
        "code": t.rlike("^[$%{<\\[(*]|[a-zA-Z0-9_][(\\[]|::|[$][{]|^[A-Za-z_]+([.][A-Za-z_]+)+").cast("double"),
        "assigned": F.coalesce(F.col("before").rlike("[:=]\\s*[\"'`]?$"), F.lit(False)).cast("double"),
    })


def labelled_findings(each: int = 60, seed: int = 7) -> list[dict]:
    """The labelled table: ``each`` findings of each kind, made by a rule."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth", "TOKEN", "Secret", "private_key"]
    plain = ["the", "of", "and", "with", "from", "see", "note", "que", "der", "les", "para"]
    dirs = ["src0", "src/main", "app/settings", "crawl/7", "web", "src12"]
    said = lambda: " ".join(r.choice(plain) for _ in range(2))
    out = []

    def add(y, token, before, after=None, path=None):
        out.append({"token": token, "before": before, "after": after if after is not None else '" ' + said(), "path": path or r.choice(dirs), "y": float(y)})

    for _ in range(each):
        sep = r.choice([" = \"", "=\"", ": '", " = ", ": "])
        for n in (32, 40, 48, 64):
            add(1, some(hexes, n), said() + " " + r.choice(names) + sep)
        add(1, some(hexes.upper(), r.choice([32, 40, 64])), said() + " " + r.choice(names) + sep)
        add(1, some(alnum + "+/", r.randint(24, 60)) + r.choice(["", "=", "=="]), said() + " " + r.choice(names) + sep)
        add(1, r.choice(["AKIA", "ASIA"]) + some(alnum[:26] + "234567", 16), r.choice([said(), said() + " " + r.choice(names) + sep]))
        add(1, r.choice(["ghp_", "gho_", "sk-", "glpat-", "npm_"]) + some(alnum, r.randint(24, 40)), r.choice([said(), said() + " " + r.choice(names) + sep]))
        add(0, some(hexes, r.choice([40, 64])), said() + " " + r.choice(["commit", "sha256", "checksum", "md5", "revision", "digest", "hash"]) + r.choice([" ", ": ", " = \""]))
        add(0, "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)), said() + " " + r.choice(["id", "uuid", "request", "the"]) + r.choice([" ", ": ", " = \""]))
        add(0, "_".join(r.choice(DICTIONARY) for _ in range(3)) + str(r.randint(1, 99)), said() + r.choice(["", " " + r.choice(names) + sep]))
        add(0, "".join(r.choice(DICTIONARY).title() for _ in range(3)) + str(r.randint(1, 9)), said())
        add(0, "/".join(r.choice(DICTIONARY) for _ in range(4)) + "/" + str(r.randint(1, 9999)), said() + r.choice([" ", " http://"]))
        add(0, r.choice(["xxxxxxxxxxxxxxxx", "0123456789abcdef0123456789abcdef", "1234567890123456", "AAAAAAAAAAAAAAAA"]) + str(r.randint(1, 9)), said() + " " + r.choice(names) + sep)
        add(0, some("0123456789", r.randint(16, 20)), said() + r.choice(["", " id", " number", " build"]) + " ")
        add(0, some(r.choice([hexes, alnum]), r.choice([32, 40, 64])), said() + " " + r.choice(names) + sep,
            path=r.choice(["tests/fixtures", "docs/example", "sample/demo"]))
        add(0, "-".join(some("abcdefghijklmnopqrstuvwxyz", r.randint(4, 9)) for _ in range(3)) + "-" + str(r.randint(1, 99)), said())
        # short and odd values of assignments
        set_to = said() + " " + r.choice(["password", "passwd", "pwd", "secret", "PASSWORD", "db_password", "token", "auth"]) + sep
        add(1, some(alnum, r.randint(7, 15)) + str(r.randint(0, 99)), set_to)
        add(1, some(alnum, r.randint(3, 6)) + r.choice("!@#$%^*") + some(alnum + "!@#$%^*", r.randint(4, 9)), set_to)
        add(1, some(alnum[:52], r.randint(20, 48)), set_to)
        add(1, r.choice(["SG.", "ya29.", "eyJ"]) + some(alnum + "_-", 22) + "." + some(alnum + "_-", r.randint(30, 43)), r.choice([said(), set_to]))
        add(0, some("abcdefghijklmnopqrstuvwxyz", r.randint(1, 12)) + r.choice(["", "", ".", "!"]), set_to)
        add(0, some("abcdefghijklmnopqrstuvwxyz", r.randint(2, 9)).title() + r.choice(["", "."]), set_to)
        add(0, r.choice(["None", "null", "true", "false", "changeme", "xxxxxxxx", "********", "password", "secret", "NULL", "12345", "0", "test123"]), set_to)
        add(0, r.choice(["os.environ", "config.get(", "${", "getenv(", "user.", "self._", "{{", "<"]) + some("abcdefghijklmnopqrstuvwxyz", r.randint(3, 9)), set_to)
        add(0, "www." + some("abcdefghijklmnopqrstuvwxyz", r.randint(4, 9)) + "." + r.choice(["com", "org"]) + "/" + r.choice(DICTIONARY) + "/" + str(r.randint(1, 9999)), said() + " ")
    return out


def train(spark: SparkSession, findings: list[dict] | None = None, seed: int = 7) -> RandomForestClassificationModel:
    rows = F.from_json(F.lit(json.dumps(labelled_findings() if findings is None else findings)),
                       "array<struct<token string, before string, after string, path string, y double>>")
    x = featured(spark.range(1).select(F.inline(rows)))
    return (RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH,
                                   featureSubsetStrategy=str(FEATURE_SHARE), seed=seed)
            .fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(x.select("y", *FEATURES))))


def scored(c: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Candidates with ``score``, the forest's share for a true finding."""
    x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(featured(c))
    score: Column = vector_to_array("probability")[1]
    return model.transform(x).withColumn("score", score).select(*c.columns, "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         threshold: float = THRESHOLD, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """The findings that stay: ``id``, ``path``, ``start``, ``token``,
    ``before``, ``after``, ``score``."""
    model = model or train(docs.sparkSession)
    return scored(candidates(docs, id_col, text_col, path_col), model).where(F.col("score") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "start", F.length("token").cast("long").alias("length"),
        F.sha2(F.col("token"), 256).alias("token_sha256"), F.round("score", 6).alias("score"))
