"""Secret scans: candidates by pattern, false positives removed by a random forest, with DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, without

#: A run of 16 or more of these signs with a digit in it, that no such sign precedes.
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])[A-Za-z0-9+/_=.-]{16,}+"
#: Words behind which an assigned or quoted value is a candidate whatever its length from 5 signs on.
ANNOUNCED = r"secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|credentials?"
#: The rarer kinds: blocks of private keys, passwords in URLs, and announced values.
RARE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[^-]{0,20000}+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?<=://[^\s:/@]{1,40}:)[^\s:/@]{3,64}(?=@)"
    rf"|(?<=(?i:{ANNOUNCED})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)[^\s\"',;<>()\[\]]{{5,128}}+"
)
#: Texts without any of these in lower case are searched for CANDIDATE alone.
HINTS = ("secret", "token", "passw", "passphrase", "pwd", "api", "access", "credential", "private key", "://")
#: Letters of context to either side.
CONTEXT = 48
MARK = "[SECRET]"

#: Frequent parts of words, for the share of a candidate that a dictionary covers.
DICTIONARY = (
    "tion|ment|ness|able|ing|the|and|that|with|from|this|have|for|not|are|was|user|name|file|path|test|data|value|model|config|version|release|build|"
    "index|table|report|image|page|item|list|info|form|view|code|example|sample|placeholder|your|here|http|www|com|org|html|json|que|les|des|une|pour|"
    "der|die|das|und|ein|sch|keit|heit|ung|ver|los|las|para|con|cion|mente|dad|er|en|re|an|on|es|th|in|or|le|ch|ou|ai|as|os|al|ar"
)
#: Words near a candidate that speak for a secret, and against one.
FOR = r"secret|token|passw|passphrase|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|signing"
AGAINST = r"commit|sha-?1|sha-?256|md5|checksum|digest|etag|revision|uuid|guid|example|sample|dummy|placeholder|version|build|order|invoice|phone|card|isbn|issn|doi|http|www"
PATHS = r"test|example|fixture|sample|doc|lock"

FEATURES = (
    "length", "digits", "upper", "lower", "other", "transitions", "distinct", "hex", "vowels", "coverage",
    "near_for", "near_against", "assigned", "quoted", "path", "announced", "pem", "url", "dummy",
)
#: Values that stand in a secret's place without being one.
DUMMY = r"^(?:none|null|nil|true|false|required|optional|string|str|value|changeme|change_me|example|sample|test|todo|password|passwd|secret|token|placeholder|unset|empty|env|os\.environ|getenv|process\.env|self|your.*|my.*|xx+.*|\*+|\.+|[$%{].*)"


def share(c: Column, pattern: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.greatest(F.length(c), F.lit(1))


def feature_columns(candidate: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    c, near = candidate, F.lower(F.concat(left, F.lit(" "), right))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return {
        "length": F.log1p(F.length(c).cast("double")),
        "digits": share(c, "[0-9]"),
        "upper": share(c, "[A-Z]"),
        "lower": share(c, "[a-z]"),
        "other": share(c, "[^A-Za-z0-9]"),
        "transitions": F.regexp_count(c, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / F.length(c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "vowels": share(F.lower(c), "[aeiou]"),
        "coverage": share(F.lower(c), DICTIONARY),
        "near_for": flag(near.rlike(FOR)),
        "near_against": flag(near.rlike(AGAINST)),
        "assigned": flag(left.rlike("[=:]\\s*[\"']?$")),
        "quoted": flag(left.rlike("[\"']$")),
        "path": flag(F.lower(path).rlike(PATHS)),
        "announced": flag(F.lower(left).rlike(f"(?:{ANNOUNCED})[\"']?\\s*[=:]\\s*[\"']?$")),
        "pem": flag(c.startswith("-----BEGIN")),
        "url": flag(left.rlike("://[^\\s:/@]+:$") & right.startswith("@")),
        "dummy": flag(F.lower(c).rlike(DUMMY)),
    }


def made_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """Labelled findings (candidate, left, right, path, is_secret) made by rule, for use where no real ones are given.

    Half are secrets: digests in hexadecimal, base 64 and mixed forms behind words that announce one, short passwords and
    phrases, keys in blocks, passwords in URLs. The others are digests behind words that announce a hash, version or order
    number, dotted and slashed names, long words with a number, dates, card numbers, and placeholders, also announced ones.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(f"{salt}_"), F.col("id").cast("string")), 256)
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(options))) + 1).cast("int"))
    word = lambda salt: pick(salt, "model", "table", "report", "there", "nation", "erthing", "onand", "schung", "dieverein", "ciones", "mente", "elleque", "thandwh", "release")
    mixed = F.regexp_replace(F.base64(F.unhex(h("b"))), "[=]+$", "")
    forms = F.array(F.substring(h("a"), 1, 40), F.substring(h("a"), 1, 32), h("a"), F.substring(mixed, 1, 40), F.concat(pick("p", "sk-", "ghp_", "AKIA", "xox-", "glpat-"), F.substring(F.regexp_replace(mixed, "[+/]", "x"), 1, 24)), F.upper(F.substring(h("c"), 1, 40)))
    form = F.element_at(forms, (F.pmod(F.xxhash64(F.lit("form"), "id"), F.lit(6)) + 1).cast("int"))
    number = F.pmod(F.xxhash64(F.lit("no"), "id"), F.lit(90_000)) + 10_000
    card = F.concat(*[F.substring(F.concat(number, number), k, 4) for k in (2, 1, 3, 4)])
    names = F.array(
        F.concat(word("w1"), F.lit("_"), word("w2"), F.lit("_"), number), F.concat(word("w1"), F.lit("."), word("w2"), F.lit("."), word("w3"), number),
        F.concat(word("w1"), word("w2"), word("w3"), number), F.concat(F.lit("/"), word("w1"), F.lit("/"), word("w2"), F.lit("/"), word("w3"), number),
        F.concat(F.lit("2024-01-"), number, F.lit("-"), number), F.concat(number, number, number, number), card, F.concat(F.lit("your_api_key_here_"), number), F.concat(F.lit("xxxxxxxxxxxxxxxx"), number),
        F.concat(word("w1"), F.lit("."), number, F.lit("@mail7."), word("w2"), F.lit(".com")), F.concat(number, F.lit("."), number, F.lit("."), number, F.lit("."), number),
    )
    name = F.element_at(names, (F.pmod(F.xxhash64(F.lit("name"), "id"), F.lit(11)) + 1).cast("int"))
    kind = F.pmod("id", F.lit(6))
    few = F.pmod(F.xxhash64(F.lit("few"), "id"), F.lit(900)) + 7
    base = F.regexp_replace(F.base64(F.unhex(F.concat(h("k"), h("l"), h("m")))), "[=\\s]", "")
    short = [
        (F.concat(word("s1"), few), None), (F.concat(word("s1"), word("s2"), word("s3")), None), (F.concat(F.initcap(word("s1")), pick("sign", "&", "!", "#", "%", "-", "_"), few), None),
        (F.concat(F.lit("xoxb-"), number, F.lit("-"), F.substring(F.regexp_replace(mixed, "[+/]", "y"), 1, 20)), None), (F.substring(h("e"), 1, 12), None),
        (F.concat(F.lit("-----BEGIN "), pick("pem", "", "RSA ", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), base, F.lit("\n-----END PRIVATE KEY-----")), pick("before", "", "key:\n", "file\n")),
        (F.concat(word("s1"), few), pick("db", "postgres://app:", "https://user1:", "mysql://root:", "redis://x:")),
    ]
    at = F.pmod(F.xxhash64(F.lit("short"), "id"), F.lit(len(short)))
    brief = F.element_at(F.array(*[v for v, _ in short]), (at + 1).cast("int"))
    dummy = pick("dummy", "none", "null", "true", "false", "required", "optional", "your_password", "your-token-here", "changeme", "example", "string", "os.environ", "getenv", "********", "xxxxxxxx", "placeholder", "password", "${TOKEN}")
    plain = pick("plain", "of the thing and ", "und die ver ", "que los ", "le on en ", "hation of here to the en ")
    announced = F.concat(plain, pick("for", 'token = "', "token: ", 'secret = "', "api_key=", "apikey: '", "password = ", "Authorization: Bearer ", 'private_key = "', 'auth_token="', "access-key ", 'credential: "'))
    hashed = F.concat(plain, pick("against", "commit ", "sha1: ", "sha256=", 'checksum = "', "md5 ", 'etag: "', "revision ", "uuid: ", 'digest = "', "example ", "build "))
    loose = F.concat(plain, pick("loose", "", "| ", "at ", "see ", "to ", '"', "in: "))
    return spark.range(n).select(
        F.when(kind == 2, name).when(kind == 4, brief).when(kind == 5, dummy).otherwise(form).alias("candidate"),
        F.when(kind.isin(0, 1, 5), announced).when(kind == 4, F.coalesce(*[F.when(at == k, left) for k, (_, left) in enumerate(short) if left is not None], announced)).when(kind == 3, hashed).otherwise(loose).alias("left"),
        F.when((kind == 4) & (at == len(short) - 1), "@db.local/x").otherwise(pick("right", '" the edsh', " of and", '"', " ", ", that")).alias("right"),
        F.when((kind.isin(2, 3)) & (F.pmod("id", F.lit(12)) < 4), pick("path", "tests/a.py", "docs/x.md", "poetry.lock")).otherwise(pick("src", "src1", "app/main.py", "src7")).alias("path"),
        kind.isin(0, 1, 4).cast("double").alias("is_secret"),
    )


def train(findings: DataFrame, trees: int = 16, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel:
    """A random forest on the features of labelled findings; rows without label or candidate are left out."""
    rows = findings.where("is_secret IS NOT NULL AND candidate IS NOT NULL").select(
        *[f.cast("double").alias(k) for k, f in feature_columns(F.col("candidate"), F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.coalesce("path", F.lit(""))).items()],
        F.col("is_secret").cast("double").alias("label"),
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def forest_score(model: RandomForestClassificationModel, features: dict[str, Column]) -> Column:
    """The forest's mean leaf probability as a plain expression, so that it can stand in any projection or lambda."""
    inputs = [features[k] for k in FEATURES]

    def walk(node) -> Column:  # noqa: ANN001  a node of the JVM's model
        if node.subtreeDepth() == 0:
            counts = node.impurityStats().stats()
            return F.lit(float(counts[1]) / max(1e-9, float(counts[0]) + float(counts[1])))
        split = node.split()
        return F.when(inputs[split.featureIndex()] <= float(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    roots = [t._call_java("rootNode") for t in model.trees]
    total = F.lit(0.0)
    for r in roots:
        total = total + walk(r)
    return total / F.lit(float(len(roots)))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """docs with n_candidates, n_secrets, secrets (array) and redacted, the text with each secret replaced.

    The texts between candidates give their context. No shuffle: all happens in one projection. Null texts have no
    candidates and a null redaction, empty ones an empty one; repeated rows get equal results. Columns of docs with
    these names are replaced; a missing path column counts as an empty path.
    """
    base = without(docs, "n_candidates", "n_secrets", "secrets", "redacted", "_found")
    text = F.col("text").cast("string")
    at = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    names = ("candidate", "left", "right", "path")

    def featured(x: Column) -> Column:
        return F.struct(*[f.cast("double").alias(k) for k, f in feature_columns(*(x[n] for n in names)).items()])

    def decide(x: Column) -> Column:
        """A struct of each candidate: the text before it, itself, and whether it is a secret."""

        def one(c: Column, i: Column) -> Column:
            left, right = F.element_at(x["parts"], i + 1), F.element_at(x["parts"], i + 2)
            context = F.struct(*[v.alias(n) for n, v in zip(names, (c, F.substring(left, -CONTEXT, CONTEXT), F.substring(right, 1, CONTEXT), at))])
            hit = bind(featured(context), lambda f: forest_score(model, {k: f[k] for k in FEATURES}) >= threshold)
            return F.struct(left.alias("before"), c.alias("candidate"), hit.alias("hit"))

        return F.struct(F.transform(x["cands"], one).alias("items"), F.element_at(x["parts"], -1).alias("rest"))

    pieces = lambda p: F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("cands"), F.split(text, p, -1).alias("parts"))
    hinted = F.array_contains(F.transform(F.array(*[F.lit(x) for x in HINTS]), lambda x: F.contains(F.lower(text), x)), True)
    every = f"{RARE}|{CANDIDATE}"
    cut_up = F.when(hinted & text.rlike(every), pieces(every)).when(~hinted & text.rlike(CANDIDATE), pieces(CANDIDATE))
    found = base.withColumn("_found", bind(cut_up, lambda x: F.when(x.isNotNull(), decide(x))))
    items, none = F.col("_found.items"), F.array().cast("array<string>")
    hits = F.filter(items, lambda x: x["hit"])
    redacted = F.concat(F.array_join(F.transform(items, lambda x: F.concat(x["before"], F.when(x["hit"], F.lit(MARK)).otherwise(x["candidate"]))), ""), F.col("_found.rest"))
    return found.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.coalesce(F.size(items), F.lit(0)).alias("n_candidates"),
        F.coalesce(F.size(hits), F.lit(0)).alias("n_secrets"),
        F.coalesce(F.transform(hits, lambda x: x["candidate"]), none).alias("secrets"),
        F.when(F.size(hits) > 0, redacted).otherwise(text).alias("redacted"),
    )


def redact(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """docs with secrets replaced in text and n_chars, where there is one, brought up to date."""
    done = scan_secrets(docs, model).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_secrets(docs: DataFrame) -> DataFrame:
    """Per document: how many candidates and secrets there are, the secrets' digests, and the digest of the redacted text."""
    done = scan_secrets(docs, train(made_findings(docs.sparkSession)))
    return done.select(
        "doc_id",
        "n_candidates",
        "n_secrets",
        F.array_join(F.transform("secrets", lambda s: F.substring(F.sha2(s, 256), 1, 16)), ",").alias("secret_digests"),
        F.sha2(F.col("redacted"), 256).alias("redacted_sha256"),
    )
