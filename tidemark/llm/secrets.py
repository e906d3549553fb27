"""Secret scanning with false-positive removal by a random forest, in DataFrame operations only.

One pattern names the candidates of a text: strings of known shapes, private key blocks, passwords within
URLs, values assigned to a telling name (of any alphabet), and any long run that mixes letters and
digits; none has an upper length. Each candidate, with the words around it and the path of its
document, becomes a row of features: length, changes of character class, variety, shares of digits and
signs, how much of it dictionary words cover, cue and placeholder words beside it, test-like paths. A
random forest trained from labelled findings separates secrets from look-alikes (checksums, ids,
placeholders, plain words, code, encoded data). The scan is one projection and an explode over each
text's candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a findings table that a fit uses at most (those with the least hashes).
MAX_FINDINGS = 100_000

# Words that a secret hardly holds, cues before one, words that mark a placeholder, test-like paths.
DICTIONARY = (
    "about", "access", "account", "action", "active", "address", "admin", "after", "again", "allow", "always", "answer", "apple", "array", "auto", "base", "because", "before", "bool", "book",
    "build", "button", "call", "change", "char", "check", "city", "class", "client", "close", "code", "color", "config", "connect", "const", "content", "context", "could", "count", "create",
    "data", "date", "debug", "default", "delete", "demo", "disabled", "document", "dummy", "element", "enabled", "end", "enter", "env", "error", "event", "every", "example", "export", "false",
    "field", "file", "first", "float", "form", "from", "function", "general", "get", "group", "hash", "have", "head", "here", "home", "host", "html", "http", "image", "import", "index", "info",
    "input", "install", "invalid", "item", "key", "label", "last", "length", "letter", "license", "line", "link", "list", "load", "local", "login", "long", "main", "manager", "message", "method",
    "missing", "module", "must", "name", "nation", "never", "none", "null", "number", "object", "open", "option", "optional", "order", "other", "output", "page", "param", "path", "people",
    "place", "please", "port", "print", "private", "process", "property", "public", "random", "read", "remote", "request", "required", "response", "result", "return", "sample", "save", "script",
    "section", "self", "send", "server", "service", "session", "should", "simple", "some", "source", "start", "state", "static", "station", "status", "string", "style", "system", "table",
    "test", "text", "their", "there", "thing", "this", "time", "title", "true", "type", "undefined", "update", "user", "valid", "value", "version", "water", "where", "will", "window", "with",
    "word", "work", "world", "write", "your",
)
CUES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "auth", "bearer", "credential", "private_key", "private-key")
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "change_me", "xxxx", "your_", "your-", "<", "todo", "redacted", "fake", "****", "${", "insert")
HASH_CUES = ("sha1", "sha256", "md5", "checksum", "commit", "digest", "etag", "uuid", "revision", "integrity")
TEST_PATHS = "(?i)(^|[/_.-])(tests?|spec|examples?|docs?|fixtures?|samples?|mocks?)([/_.-]|$)"

#: Known shapes (fixed values), and how private key blocks look.
SHAPES = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}"
KEY_BLOCK = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,8}(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"
_IN_URL = r"(://[^\s/@:]++:)([^\s/@]++)(?=@)"
_NAMED = r"""(?i:(?<![a-z])(?:%s))[0-9A-Za-z_-]{0,20}["']?\s{0,3}(?:=>|:=|[:=])\s{0,3}(?:(?i:bearer|basic)\s{1,3})?+["'`]?+""" % "|".join(CUES)
_VALUE = r"""[^\s"'`,;<>]{3,}[^\s"'`,;<>.)\]}]"""
_RUN = r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[0-9A-Za-z_+/-]{16,}+={0,2}"
#: Groups 1, 3, 5 and 6 hold a candidate, 2 and 4 what leads to one.
CANDIDATE = rf"((?<![0-9A-Za-z])(?:{SHAPES})|{KEY_BLOCK})|{_IN_URL}|({_NAMED})({_VALUE})|({_RUN})"
_MARK = "\u0001"
_NEAR = 64  # characters on either side that hold the neighbouring words
FEATURES = (
    "f_length", "f_changes", "f_variety", "f_digits", "f_upper", "f_signs", "f_hex", "f_words", "f_vowels", "f_shape", "f_block", "f_cue", "f_assigned", "f_in_url",
    "f_call", "f_placeholder", "f_hash_cue", "f_test_path",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(?i)(" + "|".join(r"\Q" + w + r"\E" for w in words) + ")").cast("double")


def features(found: DataFrame) -> DataFrame:
    """Adds the feature columns to rows of ``candidate, before, after, path``; nulls count as empty."""
    c = F.col("candidate")
    around = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    before = F.coalesce("before", F.lit(""))
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    classes = c
    for pattern, sign in (("[0-9]", "\u0002"), ("[A-Z]", "\u0003"), ("[a-z]", "\u0004"), ("[^\u0002-\u0004]", "\u0005")):
        classes = F.regexp_replace(classes, pattern, sign)
    runs = F.length(F.regexp_replace(classes, r"(.)\1++", "$1"))
    covered = F.length(c) - F.length(F.regexp_replace(F.lower(c), "(" + "|".join(DICTIONARY) + ")", ""))
    count = lambda pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return found.withColumns({
        "f_length": F.least(F.length(c), F.lit(10_000)).cast("double"),
        "f_changes": (runs - 1) / size,
        "f_variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0)),
        "f_digits": count("[0-9]") / size,
        "f_upper": count("[A-Z]") / size,
        "f_signs": count("[^0-9A-Za-z]") / size,
        "f_hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "f_words": covered / size,
        "f_vowels": count("[aeiouAEIOU]") / size,
        "f_shape": c.rlike("^(" + SHAPES + ")$").cast("double"),
        "f_block": c.startswith("-----BEGIN").cast("double"),
        "f_cue": _any(before, CUES),
        "f_assigned": before.rlike("[=:]\\s*((?i)(bearer|basic)\\s+)?[\"'`]?$").cast("double"),
        "f_in_url": before.rlike("://[^\\s/@:]+:$").cast("double"),
        "f_call": c.rlike(r"[(){}\[\]$]|^[A-Za-z_]+(\.[A-Za-z_]+)+$").cast("double"),
        "f_placeholder": _any(F.concat_ws(" ", around, c), PLACEHOLDERS),
        "f_hash_cue": _any(before, HASH_CUES),
        "f_test_path": F.coalesce(F.col("path"), F.lit("")).rlike(TEST_PATHS).cast("double"),
    })


def labelled_findings(spark: SparkSession, n: int = 4800, start: int = 0) -> DataFrame:
    """``(candidate, before, after, path, label)``: findings made by rule from the hashes of ``n`` numbers, label 1 a true secret.

    Half are secrets: random strings of the known shapes, key blocks, random values, passwords and letter
    runs assigned to a cue word, passwords within URLs. Half are look-alikes: checksums and ids after
    their cues, placeholders and masks, plain words and code assigned to a cue word, words joined with a
    number, paths, encoded data and random strings without a cue.
    """
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "")
    draw = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("int")
    pick = lambda options, k: F.element_at(F.array(*[F.lit(o) for o in options]), draw(k, len(options)) + 1)
    cut = lambda text, low, high, k: F.substring(text, F.lit(1), F.lit(low) + draw(k, high - low + 1))
    letters = lambda k: F.translate(h(k), "0123456789abcdef", "kqzmwxvjbtyhpgfl")
    word = lambda k: pick(DICTIONARY, k)
    cue = F.concat(pick(("", "", "my_", "DB_", "app."), "cp"), pick(CUES, "c"), pick(("=", " = \"", ": ", "=\"", ":", " = '", "\": \""), "e"))
    neutral = pick(("the", "key:", "id =", "of on", "aws_access_key_id=", "Authorization: Bearer ", "see "), "b")
    plain = pick(("src/main.py", "web", "src3", "app/config.yml", "notes.txt", ""), "o")
    password = F.concat(cut(F.concat(letters("p1"), F.lit("")), 2, 5, "p2"), F.upper(F.substring(letters("p3"), 1, 1)), draw("p4", 1000).cast("string"), pick(("", "!", "&", "#", "@x", "$z", "%", "x"), "p5"), cut(letters("p6"), 2, 6, "p7"))
    dressed = F.concat(F.translate(word("q1"), "aeo", "430"), pick(("", "&", "!", "_", "#"), "q2"), draw("q3", 100).cast("string"), pick(("", "!", "xyz", "q9", "secret", "key", "7"), "q4"))
    code = F.concat(pick(("process.env.", "os.environ.", "config.", "self.", "get_", "settings."), "g1"), word("g2"), pick(("", "()", "_token", "[0]"), "g3"))
    block = F.concat(F.lit("-----BEGIN "), pick(("", "RSA ", "EC ", "OPENSSH "), "k1"), F.lit("PRIVATE KEY-----\n"), cut(F.concat_ws("\n", *[b64(f"k{k}") for k in range(2, 14)]), 20, 500, "k1"), F.lit("\n-----END PRIVATE KEY-----"))
    blob = F.concat_ws("", *[b64(f"z{k}") for k in range(12)])
    joined = F.concat(word("w1"), pick(("-", "_", "", "/"), "j"), word("w2"), draw("w3", 1000).cast("string"), word("w4"), pick(("", "-", "/"), "j2"), word("w5"))
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 12))
    login = F.concat(pick(("postgres", "https", "mysql", "amqp", "ftp"), "l1"), F.lit("://"), pick(("app", "root", "admin", "svc"), "l2"), F.lit(":"))
    hashed = F.concat(pick(HASH_CUES, "d"), pick((" ", ": ", "="), "f"))
    bare = F.concat(pick(("page", "ref", "file", "see the", "id", "in", "class="), "r"), F.lit(" "))
    secrets = [
        (F.concat(F.lit("AKIA"), F.substring(F.regexp_replace(F.upper(b64("a")), "[^0-9A-Z]", "7"), 1, 16)), neutral), (F.concat(F.lit("ghp_"), F.substring(F.concat(b64("g"), b64("h")), 1, 36)), neutral),
        (cut(h("x"), 16, 64, "n1"), cue), (cut(b64("y"), 16, 40, "n2"), cue), (cut(F.concat_ws("", *[b64(f"y{k}") for k in range(6)]), 60, 240, "n3"), cue), (password, cue), (dressed, cue),
        (cut(letters("s"), 12, 32, "n4"), cue), (F.concat(F.lit("eyJ"), cut(b64("v1"), 12, 30, "n5"), F.lit("."), b64("v2"), F.lit("."), b64("v3")), neutral), (cut(b64("m"), 8, 20, "n6"), login), (password, login), (block, neutral),
    ]
    others = [
        (F.substring(h("s"), F.lit(1), pick((32, 40, 64), "n7")), hashed), (uuid, F.concat(pick(("uuid", "id", "request", "session id"), "d2"), F.lit(" "))), (F.concat(pick(("your_api_key_here_", "example_secret_", "xxxxxxxxxxxx", "changeme_password_", "insert-token-"), "y5"), draw("y6", 100).cast("string")), cue),
        (joined, bare), (cut(h("t"), 16, 64, "n8"), bare), (F.concat(word("x1"), F.lit("/"), word("x2"), F.lit("_"), draw("x3", 10000).cast("string"), word("x4")), bare), (word("o1"), cue), (code, cue),
        (pick(("********", "xxxxxxxx", "REDACTED", "None", "null", "true", "${SECRET}", "${TOKEN}", "changeme", "********************"), "o2"), cue), (cut(blob, 200, 480, "n9"), bare),
        (pick(("password", "pass", "PASSWORD", "secret", "your-password", "${PASSWORD}", "changeme"), "o3"), login), (F.concat(word("o4"), pick(("_", "-", " "), "j3"), word("o5")), cue),
    ]
    kinds = secrets + others
    plain_after = pick(("", "the", "and then", "for", ";"), "z")
    found = None
    for k, (candidate, before) in enumerate(kinds):  # one small projection a kind
        test_like = k == len(secrets) + 2
        row = [
            candidate.alias("candidate"), before.alias("before"), (F.lit("@db.host.net") if before is login else plain_after).alias("after"),
            (pick(("tests/a.py", "docs/readme.md", "src/main.py"), "v") if test_like else plain).alias("path"), F.lit(float(k < len(secrets))).alias("label"),
        ]
        part = spark.range(start + (k - start) % len(kinds), start + n, len(kinds), 1).select(*row)
        found = part if found is None else found.union(part)
    return found


def train(findings: DataFrame, trees: int = 24, depth: int = 9) -> RandomForestClassificationModel:
    """Fit on ``(candidate, before, after, path, label)``; rows with a null label or candidate are left out."""
    rows = features(findings.where("label is not null and candidate is not null").orderBy(F.xxhash64("candidate", "before"), "candidate", "before").limit(MAX_FINDINGS))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("vector", "label")
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(rows)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, candidate, before, after)`` of every candidate in every row.

    The text is cut at its candidates, so that the odd pieces are candidates and their neighbours
    hold the words around them.
    """
    whole = F.translate("text", _MARK, " ")
    pieces = F.split(F.regexp_replace(whole, CANDIDATE, f"$2$4{_MARK}$1$3$5$6{_MARK}"), _MARK)
    rows = docs.select("doc_id", F.col("source").alias("path"), pieces.alias("pieces")).where(F.size("pieces") > 2)
    at = lambda k: F.element_at("pieces", k)

    def one(k):
        before = F.regexp_extract(F.substring(at(k - 1), -_NEAR, _NEAR), r"((?:\S+\s+){0,2}\S*)$", 1)
        after = F.regexp_extract(F.substring(at(k + 1), 1, _NEAR), r"^(\S*\s*\S*)", 1)
        return F.struct(at(k).alias("candidate"), before.alias("before"), after.alias("after"))

    return rows.select("doc_id", "path", F.inline(F.transform(F.sequence(F.lit(2), F.size("pieces") - 1, F.lit(2)), one)))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, keep_rejected: bool = False) -> DataFrame:
    """One row per finding that the forest keeps: ``doc_id, kind, length, secret_sha256, cue, probability``.

    ``secret_sha256`` stands for the string itself, so the report holds no secret. A string that
    occurs several times in a text is found each time. ``keep_rejected`` also returns what the forest
    refuses, told apart by ``is_secret``. Null and empty texts have no findings; very long texts are
    scanned whole; a null ``source`` counts as an empty path; other columns are ignored; repeated rows
    repeat their findings; an empty table gives no rows.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(features(candidates(docs)))
    p = vector_to_array("probability")[1]
    c = F.col("candidate")
    kind = (
        F.when(F.col("f_block") > 0, "private_key").when(c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$"), "cloud_key").when(c.rlike("^gh[pousr]_"), "forge_token").when(c.rlike(r"^eyJ[^.]+\."), "web_token")
        .when(F.col("f_shape") > 0, "service_token").when(F.col("f_in_url") > 0, "url_password").when(F.col("f_cue") > 0, "assigned_value").otherwise("random_string")
    )
    found = model.transform(rows).select(
        "doc_id", kind.alias("kind"), F.length(c).alias("length"), F.sha2(c, 256).alias("secret_sha256"), (F.col("f_cue") > 0).alias("cue"),
        F.round(p, 6).alias("probability"), (p >= threshold).alias("is_secret"),
    )
    return found if keep_rejected else found.where("is_secret").drop("is_secret")
