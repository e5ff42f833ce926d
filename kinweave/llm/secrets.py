"""Secret scan: a random forest removes false positives among candidate tokens, with DataFrame functions only.

A candidate is a run of any marks but blanks, quotes, brackets, commas and semicolons, of any length: what follows `=` or `:`, and elsewhere
what holds a letter and a digit (there `=` and `:` end it). Full stops at its end don't belong to it. Its features are its length, its character
classes, the likelihood of its character pairs, how much of it a dictionary covers, signs of a path or address, and WORDS_BESIDE whole words on each side.
The dictionary and the likelihoods of pairs come from the words of all documents. The forest is trained on labelled findings (candidate, left, right,
label); where none are given, on a bundled set that is generated by rule, as the corpus has no labelled findings.

Defined cases: null and empty texts have no candidate and give no row. Repeated rows each give their rows. Candidates and the words beside them are never cut. An
empty corpus leaves the fixed words as the dictionary. Extra columns are ignored. A secret phrase with blanks is seen by its words alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

_END = r"\s\"'`<>(){}\[\],;"
#: After an assignment any value; elsewhere a run with a letter and a digit.
CANDIDATE = rf"(?<![^{_END}=:])(?:(?<=[=:] ?[\"'`]?)[^{_END}]++|(?=[^{_END}=:0-9]*+[0-9])(?=[^{_END}=:\p{{L}}]*+\p{{L}})[^{_END}=:]++)"
#: Whole words beside a candidate that count as its neighbours.
WORDS_BESIDE = 4
#: Words that the dictionary takes from the corpus: those that the most documents hold, in a table that is broadcast.
WORDS = 20_000
#: Words that the dictionary covers, and words beside a candidate that speak for or against a secret.
DICTIONARY = "about|access|account|admin|after|application|archive|assets|build|change|class|client|code|common|config|content|count|create|data|default|delete|demo|dev|doc|document|download|email|enter|error|example|false|field|file|from|function|get|group|handler|header|here|home|host|html|http|image|index|info|input|item|java|key|label|library|license|list|local|login|mail|main|manager|master|message|method|model|module|name|network|node|number|object|option|page|param|pass|password|path|placeholder|prod|profile|project|python|query|read|record|release|request|response|result|sample|script|secret|server|service|session|set|source|static|status|string|style|system|table|temp|test|text|time|title|token|true|type|update|upload|user|value|version|view|web|window|word|write|your"
FOR = "passw|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private"
AGAINST = "commit|checksum|sha1|sha256|md5|digest|uuid|guid|revision|version|etag|build|hash|example|integrity"
KNOWN = "^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-|AIza)"
FEATURES = ("length", "digits", "uppers", "marks", "transitions", "pairs", "variety", "vowels", "covered", "hex", "uuid", "known", "slashes", "dots", "path", "address", "assigned", "quoted", "for", "against")
#: Rows of the bundled labelled findings, and the forest.
FINDINGS = 6000
TREES, DEPTH, SEED = 40, 8, 7


@dataclass
class Lexicon:
    """words: a table of one column, WORDS and the fixed ones at most; pairs: the log-likelihood of each pair of characters, by 27 * first + second."""

    words: DataFrame
    pairs: list[float]


def _codes(c: Column) -> Column:
    """1 to 26 for the letters a to z of either case, 0 for any other character."""
    code = lambda x: F.ascii(x) - 96
    return F.transform(F.split(F.lower(c), ""), lambda x: F.when(code(x).between(1, 26), code(x)).otherwise(0))


def lexicon(docs: DataFrame, scratch: Scratch) -> Lexicon:
    """The words of three letters or more that the most texts hold, and the likelihoods of character pairs within them."""
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}+"), F.lit(0)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    fixed = docs.sparkSession.range(1, numPartitions=1).select(F.explode(F.split(F.lit(DICTIONARY), "[|]")).alias("word"), F.lit(1).cast("long").alias("n"))
    words = scratch.keep(held.orderBy(F.desc("n"), "word").limit(WORDS).unionByName(fixed).groupBy("word").agg(F.sum("n").alias("n")), "words")
    codes = words.select("n", _codes(F.col("word")).alias("c"))
    both = F.transform("c", lambda x, i: F.coalesce(F.get("c", i + 1), F.lit(0)) + x * 27)
    found = codes.select("n", F.explode(both).alias("pair")).groupBy("pair").agg(F.sum(F.sqrt("n")).alias("n")).collect()  # 729 at most
    count = [0.5] * 729
    for r in found:
        count[r["pair"]] += r["n"]
    return Lexicon(words.select("word"), [log(count[i] / sum(count[i // 27 * 27 : i // 27 * 27 + 27])) for i in range(729)])


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def featured(found: DataFrame, lex: Lexicon) -> DataFrame:
    """found has uid (its own for every row), candidate, left and right (the text beside it); adds FEATURES."""
    c, left, right = F.col("candidate"), F.lower("left"), F.lower("right")
    flag = lambda x: x.cast("double")
    piece = found.select("uid", F.explode(F.regexp_extract_all("candidate", F.lit(r"\p{Lu}?\p{Ll}++|\p{Lu}++"), F.lit(0))).alias("word")).withColumn("word", F.lower("word"))
    # a table of WORDS rows and the fixed ones: a bounded side
    known = piece.join(F.broadcast(lex.words), "word", "left_semi").groupBy("uid").agg(F.sum(F.length("word")).alias("known_letters"))
    table_ = F.array(*[F.lit(x) for x in lex.pairs])
    # pairs of letters only: digits and marks have features of their own
    within = F.filter(F.transform("codes", lambda x, i: F.when((x > 0) & (F.get("codes", i + 1) > 0), F.get(table_, x * 27 + F.get("codes", i + 1)))), lambda x: x.isNotNull())
    beside = found.join(known, "uid", "left").withColumn("codes", _codes(c)).withColumn("within", within)
    return beside.withColumns({
        "length": F.length(c).cast("double"),
        "digits": _share(c, "[0-9]"),
        "uppers": _share(c, r"\p{Lu}"),
        "marks": _share(c, r"[^\p{L}0-9+/_.-]"),
        "transitions": _share(c, "[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[^A-Za-z0-9](?=[A-Za-z0-9])"),
        "pairs": F.when(F.size("within") > 0, F.aggregate("within", F.lit(0.0), lambda a, x: a + x) / F.size("within")).otherwise(-3.3),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "vowels": _share(c, "[aeiouAEIOU]"),
        "covered": F.coalesce("known_letters", F.lit(0)) / F.length(c),
        "hex": flag(c.rlike("^([0-9a-f]++|[0-9A-F]++)$")),
        "uuid": flag(c.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")),
        "known": flag(c.rlike(KNOWN)),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"),
        "dots": F.regexp_count(c, F.lit("[.]")).cast("double"),
        "path": flag(left.rlike("(://|/|\\\\)$") | c.rlike("^/|^[.]?[A-Za-z0-9_-]++/|[.](js|css|html?|png|jpe?g|py|java|json|zip|tar|gz|so|dll)$")),
        "address": flag(left.rlike("@$") | right.rlike("^@") | c.rlike("^[A-Za-z0-9._-]++@[A-Za-z0-9-]++[.]|[.](com|org|net|io|de|fr|es)$")),
        "assigned": flag(left.rlike("[=:] ?[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$")),
        "for": flag(left.rlike(FOR)),
        "against": flag(left.rlike(AGAINST) | right.rlike("^[\"'`]? ?(" + AGAINST + ")")),
    }).drop("codes", "within", "known_letters")


def bundled_findings(spark, rows: int = FINDINGS) -> DataFrame:
    """uid, candidate, left, right and label of findings generated by rule; the same rows each time."""
    n = F.col("id")
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("int")
    sha = lambda salt: F.sha2(F.concat(n.cast("string"), F.lit(salt)), 256)
    of = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), pick(salt, len(xs)) + 1)
    base64 = F.regexp_replace(F.base64(F.unhex(sha("b"))), "=", "")
    upper32 = F.translate(F.upper(F.substring(base64, 1, 24)), "01/+", "KMQZ")
    mixed = F.regexp_replace(base64, "[+/]", "x")
    length = 16 + pick("len", 25)
    prose = of("w", "the ", "and it is in ", "with ", "of them ", "shall be ", "", "let us see ", "here ")
    pair = lambda c, left: F.struct(c.alias("c"), left.alias("l"))
    words = lambda salt: of(salt, "user", "config", "value", "update", "handler", "message", "version", "object", "profile", "default", "river", "winter", "apple", "garden", "silver", "monkey", "paper", "summer")
    mark = lambda salt: of(salt, "!", "@", "#", "$", "%", "&", "*", "?", "_", "-", "+")
    upper = lambda salt, k: F.substring(F.translate(F.upper(sha(salt)), "0123456789", "GHJKLMNPQR"), 1, k)
    secret = F.array(
        pair(F.substring(sha("1"), 1, 18), of("p1", "password=", "passwd: ", "pwd=", "password = \"")),
        pair(F.substr(sha("2"), F.lit(1), length), of("p2", "token = \"", "secret=", "api_key: '", "auth_token=", "client_secret = \"")),
        pair(F.concat(F.lit("AKIA"), F.substring(upper32, 1, 16)), of("p3", "", "", "aws_access_key_id = ", "key: ")),
        pair(F.substr(mixed, F.lit(1), length), of("p4", "apikey=", "access_key = \"", "Bearer ", "private_key: ", "credential=\"")),
        pair(F.concat(words("t"), mark("u"), words("v"), mark("x"), pick("y", 10000).cast("string")), of("p6", "password=", "passwd: ", "db_password: \"", "PWD=", "secret=")),
        pair(F.concat(words("t"), (joint := of("joint", "-", "-", ".", "_", "+")), words("v"), joint, words("ab"), F.when(pick("more", 2) == 0, F.concat(joint, words("ac"))).otherwise(pick("y", 1000).cast("string"))), of("p7", "passphrase: ", "password=", "secret: \"", "passwd=")),
        pair(F.concat(F.initcap(F.translate(words("t"), "aeo", "@30")), pick("ad", 100).cast("string"), mark("ae")), of("p8", "password=", "password is: ", "pw secret: ", "login password = \"")),
        pair(F.concat(F.substr(mixed, F.lit(1), 6 + pick("af", 8)), mark("ag"), F.substring(sha("ah"), 1, 3)), of("p9", "password=", "token: ", "secret = \"", "PASSWD=")),
        pair(F.concat(of("k", "ghp_", "sk_live_", "glpat-"), F.substring(mixed, 1, 30)), of("p5", "", "token=", "export KEY=", "\"")),
    )
    innocent = F.array(
        pair(F.substring(sha("3"), 1, 40), of("q1", "commit ", "revision ", "sha1: ", "etag: \"", "checksum ")),
        pair(sha("4"), of("q2", "sha256:", "digest=", "integrity=\"", "hash ")),
        pair(F.concat_ws("-", F.substring(sha("5"), 1, 8), F.substring(sha("5"), 9, 4), F.substring(sha("5"), 13, 4), F.substring(sha("5"), 17, 4), F.substring(sha("5"), 21, 12)), of("q3", "id=", "uuid: ", "request ", "\"")),
        pair(F.concat(words("a"), F.lit("/"), words("b"), F.lit("/"), words("c"), pick("d", 100).cast("string"), of("e", ".js", ".html", ".png", "", ".tar.gz")), of("q4", "/", "https://", "see ", "/static/", "src/")),
        pair(F.concat(F.lit("mail"), pick("f", 100).cast("string"), F.lit("."), words("g"), of("h", ".com", ".org", ".net")), of("q5", "john.doe@", "x.42@", "www.", "info@")),
        pair(F.concat(F.lit("v"), pick("i", 10).cast("string"), F.lit("."), pick("j", 30).cast("string"), of("k2", "-rc1-build", ".0-beta.", "-alpha-"), (2000000 + pick("l", 999999)).cast("string")), of("q6", "version ", "release ", "")),
        pair(F.concat(words("m"), F.initcap(words("n")), F.initcap(words("o")), pick("r", 10).cast("string")), of("q7", "", "call ", "token = ", "password=", "def ")),
        pair(F.concat(pick("ai", 10).cast("string"), upper("aj", 1), (100 + pick("ak", 900)).cast("string"), upper("al", 2), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**10)).cast("string"), 10, "0")), of("q9", "parcel ", "tracking: ", "shipment no ", "order ", "")),
        pair(F.concat(upper("am", 3), of("an", "-", ""), pick("ao", 100000).cast("string"), of("ap", "", "-A", "/2")), of("q10", "part ", "model: ", "article ", "flight ", "invoice: ", "")),
        pair(F.concat(pick("aq", 100).cast("string"), of("ar", "th", "st", "nd", "kg", "km", "x", "pm", "GB", "px")), of("q11", "", "the ", "size: ", "width=", "about ")),
        pair(words("as"), of("q12", "note: ", "colour=", "he said: ", "type: \"", "name=")),
        pair(F.concat(F.lit("20"), F.lpad(pick("at", 30).cast("string"), 2, "0"), F.lit("-0"), (1 + pick("au", 9)).cast("string"), F.lit("-1"), pick("av", 10).cast("string"), of("aw", "T10:00:00Z", "T23:59", "")), of("q13", "date: ", "since=", "at ", "created: ")),
        pair(F.concat(of("ax", "//", "//www.", "//api."), words("ay"), of("az", ".com/", ".org/", ".net/"), words("ba"), of("bb", "", "/1", "?id")), of("q14", "https:", "http:", "url: https:")),
        pair(F.concat(pick("bc", 1000).cast("string"), of("bd", "", "%", ".5", ":30")), of("q15", "port=", "count: ", "at ", "total: ")),
        pair(of("s", "your_password_here1", "example_token_12345", "changeme_example1", "placeholder-secret-1", "test_password_123"), of("q8", "password=", "token = \"", "secret: ")),
    )
    rows_ = spark.range(rows, numPartitions=1).withColumn("label", (n % 2).cast("double"))
    e = F.when(n % 2 == 1, F.element_at(secret, pick("kind", 9) + 1)).otherwise(F.element_at(innocent, pick("kind", 15) + 1))
    return rows_.withColumn("e", e).select(n.alias("uid"), F.col("e.c").alias("candidate"), F.concat(prose, F.col("e.l")).alias("left"), of("z", " and the", "\" in it", "", " here", "\n").alias("right"), "label")


def train(findings: DataFrame, lex: Lexicon) -> RandomForestClassificationModel:
    """findings has uid, candidate, left, right and label (1.0 a secret)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(findings, lex)).select("features", "label", "uid")
    # one order of rows, so that the forest's samples are the same each time
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.repartition(1).sortWithinPartitions("uid"))


def candidates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, doc_id, pos, candidate, left and right of every candidate of docs (doc_id and text), written once."""
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    parts = docs.select("doc_id", F.split("text", CANDIDATE, -1).alias("parts"), found.alias("found")).where(F.size("found") > 0)
    # what lies between two candidates is read by both, with the candidate before: the whole stays in proportion to the text
    first = lambda x: F.array_join(F.slice(F.split(x, r"(?<=\S)\s"), 1, WORDS_BESIDE), " ")
    padded = F.transform("parts", lambda x, i: F.concat(F.when(i > 0, F.coalesce(F.get("found", i - 1), F.lit(""))).otherwise(""), x))
    last = lambda x: F.array_join(F.reverse(F.slice(F.reverse(F.split(x, r"\s(?=\S)")), 1, WORDS_BESIDE)), " ")
    beside = F.transform("found", lambda c, i: F.struct(F.rtrim(c, F.lit(".")).alias("candidate"), last(F.get("padded", i)).alias("left"), first(F.get("parts", i + 1)).alias("right")))
    rows = parts.withColumn("padded", padded).select("doc_id", F.posexplode(beside).alias("pos", "e")).select("doc_id", "pos", "e.*").where(F.length("candidate") > 0)
    return scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()), "candidates")


def scan(docs: DataFrame, model: RandomForestClassificationModel, lex: Lexicon, scratch: Scratch) -> DataFrame:
    """The candidates with score (0 to 1) and secret (score of 0.5 or more)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(candidates(docs, scratch), lex))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "pos", "candidate", "left", "right", "score", (F.col("score") >= 0.5).alias("secret"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "secrets")
    lex = lexicon(docs, scratch)
    found = scan(docs, train(bundled_findings(spark), lex), lex, scratch)
    return found.select("doc_id", "pos", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")
