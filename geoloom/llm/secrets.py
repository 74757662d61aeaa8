"""Secret scans (operator 9).

Every run of LEAST key characters or more in a word is a candidate, several in one
word included, and so are dotted tokens (of three parts, or of two that begin as
web tokens do) and, from SHORT characters, what follows a keyword that is assigned
to, in the same word (JSON, XML, URLs) or in one of the two before.
A random forest over their length, character classes and transitions, entropy,
dictionary coverage, path and neighbouring words removes the false positives. It
is trained by Spark's own learner on labelled findings and compiled into nested
CASE expressions, so a scan is one projection: no user function, no shuffle.

The labelled findings are made here by rule (labelled_findings), FIT_ROWS of
them, that number being the bound of the training sample; a table of real ones
with the same columns can be given instead.

A candidate's own word is cut to a window: the last name (or the address) before
the value and the marks around it, so the fields of minified JSON are judged one
by one and a long word costs no more than its length.

Defined cases: null and empty texts have no findings; repeated rows have equal
findings; a value that occurs twice is found twice, by word position; a value
ends where a character that keys don't have stands; a null source is an empty path; texts are scanned whole; other columns pass through
(the added one has the prefix _s_, with more underscores
where a column has that).
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, apart, fenced, materialize, table

FIT_ROWS = 6000
TREES = 15
DEPTH = 6
MASK = "[SECRET]"

#: Fewest characters of a candidate, and of one that is assigned to a keyword.
LEAST, SHORT = 12, 4
#: Characters before a value in which its name is looked for.
WINDOW = 200
KEYWORDS = r"(?i)(pass(word|wd)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential|bearer)"
PLACEHOLDERS = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|test|fake|redacted|todo)"
PREFIX = r"(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk-|sk_live_|AIza|glpat-|npm_|hf_)"
PREFIXES = "^" + PREFIX
#: Keys of known shape, also behind a separator within a longer run.
KNOWN = rf"(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])|{PREFIX.replace('(', '(?:')}[A-Za-z0-9_-]{{16}})"
#: Possessive throughout, so that a run of any length is matched without recursion.
RUN = rf"(?:[A-Za-z0-9]|[+/_~$-](?!{KNOWN}))"
PADDING = r"(?:={1,2}(?![\"']?[A-Za-z0-9+/_~$=<{\[-]))?"
DOTTED = r"(?:eyJ[A-Za-z0-9_-]{5,}+(?:[.][A-Za-z0-9_-]{4,}+){1,4}|[A-Za-z0-9_-]{2,}+[.][A-Za-z0-9_-]{6,}+[.][A-Za-z0-9_-]{16,}+)"
ASSIGNED = rf"(?i:{KEYWORDS.removeprefix('(?i)').replace('(', '(?:')})[\"']{{0,2}}[ ]?[:=>]{{1,2}}[\"'`(]?"
LONG = rf"(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![A-Za-z0-9])|{DOTTED}|{RUN}{{{LEAST},}}+{PADDING})"
#: What is a candidate in a word, and in a word that is assigned to a keyword before it.
VALUE = rf"(?:{LONG}|(?<=[:=>\"'`(])(?<={ASSIGNED}){RUN}{{{SHORT},}}+{PADDING})"
FIRST_VALUE = rf"(?:{VALUE}|(?<=^[\"'`(\[{{<]{{0,3}}){RUN}{{{SHORT},}}+{PADDING})"
NAME = r"(?:(?:://|www[.])[^?&=#]*|[A-Za-z0-9_.-]*[^A-Za-z0-9_.-]*)$"
NOT_KEYS = r"(?i)(commit|sha|hash|md5|digest|uuid|id|version|order|phone|card|build|checksum|revision)"
PATHS = r"(?i)(test|example|doc|fixture|sample|mock)"

#: Parts of names and placeholders, found anywhere in a value.
PARTS = (
    "example sample test dummy key token secret password user name value data file path config server client "
    "version build release debug index table column number string object class function error message change"
).split()
#: Words of the dictionary: the commonest of this length or more in a public tokenizer's vocabulary, which must fill a run of letters.
DICTIONARY_WORDS, WORD_LETTERS = 4000, 5
#: Syllables of which invented words of labelled findings are made.
SYLLABLES = "ba ce di fo gu ha ji ko lu ma ne pi ro su ta ve wi xo yu za stra ment ing tion ous ble qui lor ven dar".split()


@functools.cache
def dictionary(path: str, words: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The first words of a vocabulary in merge order, which is about that of frequency."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    whole = [t[:-4] for t in sorted(ids, key=ids.__getitem__) if t.endswith("</w>") and len(t) >= WORD_LETTERS + 4 and t[:-4].isascii() and t[:-4].isalpha()]
    return tuple(whole[:words])


def words() -> tuple[str, ...]:
    import public_tokenizers

    return dictionary(public_tokenizers.path("word_bpe_49k.json"))


def features(c: Column) -> list[tuple[str, Column]]:
    """Numbers that describe a candidate (struct of word, value, before1, before2, after1, path)."""
    v = c["value"]
    n = F.length(v).cast("double")
    share = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    chars = F.array_distinct(F.split(v, ""))
    p = F.transform(chars, lambda ch: (n - F.length(F.replace(v, ch, F.lit("")))) / n)
    entropy = F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda t, x: t - x * F.log2(x))
    head = F.left(c["word"], F.position(v, c["word"]) - 1)
    near = F.concat_ws(" ", c["before2"], c["before1"], head)
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    runs = F.regexp_extract_all(v, F.lit(f"[A-Z]?[a-z]{{{WORD_LETTERS - 1},}}|[A-Z]{{{WORD_LETTERS},}}"), F.lit(0))
    return [
        ("length", n),
        ("digits", share("[0-9]")),
        ("upper", share("[A-Z]")),
        ("lower", share("[a-z]")),
        ("hex", flag(v.rlike("^[0-9a-fA-F]+$"))),
        ("only_digits", flag(v.rlike("^[0-9+/_~$-]+$"))),
        ("distinct", F.size(chars) / n),
        ("entropy", entropy),
        ("transitions", F.regexp_count(v, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n),
        ("vowel_pairs", F.regexp_count(F.lower(v), F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")) / n),
        ("runs", flag(v.rlike(r"(.)\1{3,}"))),
        ("sequence", flag(F.lower(v).rlike("1234|abcd|qwer|0000|9876"))),
        ("parts", (n - F.length(F.regexp_replace(F.lower(v), "|".join(PARTS), ""))) / n),
        ("dictionary", F.aggregate(F.filter(runs, lambda x: F.lower(x).isin(*words())), F.lit(0.0), lambda t, x: t + F.length(x)) / n),
        ("uuid", flag(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"))),
        ("separators", share("[^A-Za-z0-9]")),
        ("prefix", flag(v.rlike(PREFIXES))),
        ("keyword", flag(near.rlike(KEYWORDS))),
        ("assigned", flag(F.concat_ws(" ", c["before1"], head).rlike("[=:>]"))),
        ("not_key", flag(near.rlike(r"(?i)\b" + NOT_KEYS + r"\b"))),
        ("placeholder", flag(F.concat_ws(" ", near, v, c["after1"]).rlike(PLACEHOLDERS))),
        ("address", flag(c["word"].rlike("@|://|www[.]"))),
        ("login", flag(head.rlike("://[^/@:]*:$") & c["word"].rlike("@[^A-Za-z0-9]*$"))),
        ("dots", F.regexp_count(v, F.lit("[.]")).cast("double")),
        ("path", flag(c["path"].rlike(PATHS))),
    ]


def labelled_findings(spark: SparkSession, n: int = FIT_ROWS) -> DataFrame:
    """(candidate, label) by rule: keys of known shapes in their usual places, and what is mistaken for them."""
    h = lambda k: F.sha2(F.concat(F.lit(f"finding:{k}:"), F.col("id").cast("string")).cast("binary"), 256)
    pick = lambda k, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.conv(F.substring(h(k), 1, 4), 16, 10).cast("int") % len(words)) + 1)
    b64 = F.regexp_replace(F.regexp_replace(F.base64(F.unhex(h(1))), "=", ""), "\n", "")
    upper = F.upper(F.translate(F.conv(F.substring(h(2), 1, 15), 16, 36), "01", "Z7"))
    filler = lambda k: pick(k, ("the", "of", "and", "die", "les", "que", "in", "a", "de", "=", "value", "see", *words()[:400:20]))
    keyword = pick(30, ("password", "token", "secret", "api_key", "access_key", "auth", "PASSWORD", "apikey"))
    other = pick(31, ("commit", "sha", "version", "order", "id", "uuid", "checksum", "number", "the", "in", "von", "page"))
    quote = F.when(F.conv(F.substring(h(32), 1, 1), 16, 10).cast("int") % 2 == 0, F.lit('"')).otherwise(F.lit(""))
    size = F.conv(F.substring(h(33), 1, 2), 16, 10).cast("int")
    digits = F.regexp_replace(F.concat(h(3), h(4)), "[a-f]", "")
    syllable = lambda k: pick(50 + k, SYLLABLES)
    invented = F.concat(syllable(0), syllable(1), syllable(2), F.when(size % 2 == 0, syllable(3)).otherwise(""))
    word = F.when(size % 3 == 0, invented).otherwise(pick(34, words()[::50]))
    key16 = F.rpad(F.concat(upper, F.upper(F.translate(F.substring(h(5), 1, 20), "01", "QX"))), 16, "Q")
    rows = [
        (1, F.concat(F.lit("AKIA"), key16), F.lit(""), filler(6), filler(7)),
        (1, F.substring(h(8), 1, 40), F.concat(F.lit(""), quote), F.lit("="), keyword),
        (1, F.substring(h(8), F.lit(1), 16 + size % 25), F.concat(keyword, pick(35, ("=", ":")), quote), filler(6), filler(7)),
        (1, F.substring(b64, F.lit(1), 20 + size % 23), F.concat(quote), pick(36, ("=", ":", ":=")), keyword),
        (1, F.concat(pick(37, ("ghp_", "gho_", "npm_", "hf_", "glpat-")), F.substring(F.regexp_replace(b64, "[+/]", "a"), 1, 36)), F.lit(""), filler(6), filler(7)),
        (1, F.substring(b64, F.lit(1), 16 + size % 27), F.concat(keyword, pick(35, ("=", ":")), quote), filler(6), filler(7)),
        (0, F.substring(h(9), 1, 40), F.lit(""), other, filler(7)),
        (0, F.concat_ws("-", F.substring(h(9), 1, 8), F.substring(h(9), 9, 4), F.substring(h(9), 13, 4), F.substring(h(9), 17, 4), F.substring(h(9), 21, 12)), F.lit(""), other, filler(7)),
        (0, F.substring(digits, F.lit(1), 12 + size % 9), F.lit(""), filler(6), filler(7)),
        (0, F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4), F.substring(digits, 11, 2)), pick(38, ("", "+", "tel:")), filler(6), filler(7)),
        (0, F.concat(word, F.substring(digits, F.lit(1), 1 + size % 6)), F.lit(""), filler(6), filler(7)),
        (0, F.concat(F.lit("AKIA"), pick(39, ("IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXX1", "1234567890ABCDEF", "0000000000000000"))), F.lit(""), filler(6), filler(7)),
        (0, F.concat(pick(40, ("changeme", "yourpasswordhere", "examplepassword", "testsecretvalue", "dummytoken")), F.substring(digits, F.lit(1), 4 + size % 5)), F.concat(keyword, F.lit("=")), filler(6), filler(7)),
        (0, F.concat(pick(41, ("xxxxxxxxxxxxxxx", "aaaaaaaaaaaa", "000000000000000", "123456789012345")), F.substring(digits, 1, 1)), F.concat(keyword, F.lit("=")), filler(6), filler(7)),
        (0, F.concat(F.lit("com/"), word, F.lit("/"), F.substring(digits, F.lit(1), 2 + size % 9)), F.lit("https://www.site."), filler(6), filler(7)),
        (0, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2), F.lit("T"), F.substring(digits, 9, 2)), F.lit(""), filler(6), filler(7)),
    ]
    # of one word without blanks (JSON, XML, URLs), short, dotted, without digits
    none, short = F.lit(""), F.concat(F.substring(word, 1, 6), F.substring(digits, F.lit(1), 2 + size % 4))
    # Runs of letters are words of the dictionary run together, invented words, or letters at random.
    joined = F.concat(*[pick(60 + k, words()[k::60]) for k in range(5)])
    letters = F.when(size % 3 == 0, joined).when(size % 3 == 1, F.rpad(F.concat(*[pick(70 + k, SYLLABLES) for k in range(8)]), 26, "e")).otherwise(F.translate(h(10), "0123456789", "ouinthersa"))
    inside = F.concat(keyword, pick(44, ('":"', ">", '":', "=", "':'")))
    outside = F.concat(other, pick(44, ('":"', ">", '":', "=", "':'")))
    name = F.concat_ws("_", pick(45, ("aws", "client", "user", "github", "my")), pick(46, ("secret", "access", "session", "password", "account")), pick(47, ("key", "token", "name", "identifier", "value")))
    login = F.concat(F.lit("://"), pick(48, ("bob", "admin", "root", "app")), F.lit(":"))
    rows += [
        (1, F.substring(h(8), F.lit(1), 16 + size % 25), inside, none, none),
        (1, F.substring(b64, F.lit(1), 8 + size % 33), inside, none, none),
        (1, short, F.concat(keyword, pick(35, ("=", ":")), quote), filler(6), filler(7)),
        (1, short, inside, none, none),
        (1, short, quote, pick(36, ("=", ":", ":=")), keyword),
        (1, F.substring(b64, F.lit(1), 8 + size % 16), login, none, none),
        (1, short, login, none, none),
        (1, F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(b64, 1, 17)), F.concat(F.lit("eyJ"), F.substring(h(8), 1, 30)), F.substring(F.regexp_replace(b64, "[+/]", "_"), 1, 43)), pick(49, ("", '"', 'jwt":"', "Authorization:")), filler(6), filler(7)),
        (1, F.concat(F.lit("AKIA"), key16), outside, none, none),
        (0, F.substring(letters, F.lit(1), 12 + size % 14), pick(49, ("", '"', "(", "")), filler(6), filler(7)),
        (0, F.initcap(F.substring(letters, F.lit(1), 12 + size % 14)), none, filler(6), filler(7)),
        (0, F.substring(letters, F.lit(1), 4 + size % 12), quote, pick(36, ("=", ":", ":=")), keyword),
        (0, F.substring(letters, F.lit(1), 4 + size % 9), inside, none, none),
        (0, name, pick(49, ('{"', '"', "", "?")), filler(6), filler(7)),
        (0, F.substring(h(9), F.lit(1), 12 + size % 29), outside, none, none),
        (0, F.concat_ws("/", F.lit("src"), word, F.substring(letters, F.lit(1), 5 + size % 9)), pick(49, ("", "/", "://www.site.", "")), filler(6), filler(7)),
        (0, F.concat_ws(".", F.lit("www"), word, F.substring(letters, F.lit(1), 16 + size % 9)), pick(49, ("", "https://", "", "(")), filler(6), filler(7)),
        (0, F.concat(pick(40, ("changeme", "your", "example", "test", "dummy")), F.substring(digits, F.lit(1), 1 + size % 4)), inside, none, none),
    ]
    made = None
    for k, (label, value, head, before1, before2) in enumerate(rows):
        path = pick(43, ("src0", "src7", "web", "docs/readme", "tests/fixtures") if label == 0 else ("src0", "src7", "web", "src/main", "app"))
        own = F.struct(F.concat(head, value, F.when(F.endswith(head, F.lit(":")) & F.startswith(head, F.lit("://")), "@").otherwise("")).alias("word"), value.alias("value"), before1.alias("before1"), before2.alias("before2"), filler(42).alias("after1"), path.alias("path"))
        part = spark.range(k, n, len(rows), 1).select(own.alias("c"), F.lit(float(label)).alias("label"))
        part = part.where(f"length(c.value) >= {LEAST if k < 16 else SHORT}")
        made = part if made is None else made.unionByName(part)
    return made.coalesce(1)


def rated(candidates: Column, keep: list[str]) -> Column:
    """An array of candidates as structs of the fields to keep and the features."""
    return F.transform(candidates, lambda c: F.struct(*[c[k].alias(k) for k in keep], *[x.cast("double").alias(name) for name, x in features(c)]))


def compiled(node, names: list[str], c: Column) -> Column:
    """A fitted tree as nested CASE expressions; the value of a leaf is its share of secrets."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else 0.0)
    split = node.split()
    return F.when(c[names[split.featureIndex()]] <= float(split.threshold()), compiled(node.leftChild(), names, c)).otherwise(compiled(node.rightChild(), names, c))


class Forest:
    """Trees that give a candidate's probability of being a secret."""

    def __init__(self, findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        self.names = [name for name, _ in features(F.col("c"))]
        rows = materialize(findings.select("c", "label"), "findings")
        rows = materialize(rows.select(rated(F.array("c"), [])[0].alias("f"), "label").select("f.*", "label"), "features")
        rows = VectorAssembler(inputCols=self.names, outputCol="features").transform(rows).select("features", "label")
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)
        self.roots = [t._call_java("rootNode") for t in model.trees]

    def probability(self, c: Column) -> Column:
        total = F.lit(0.0)
        for root in self.roots:
            total = total + compiled(root, self.names, c)
        return total / len(self.roots)


def scan(docs: DataFrame, forest: Forest | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """docs with _s_findings: word_index, value, detector, probability, is_secret of each candidate."""
    forest = forest or Forest(labelled_findings(docs.sparkSession))
    return apart(docs, "_s_", lambda own: _scanned(own, forest, text, path))


def _scanned(docs: DataFrame, forest: Forest, text: str, path: str) -> DataFrame:
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.when(held.rlike(rf"[A-Za-z0-9+/_~$-]{{{LEAST}}}|[.]|{KEYWORDS}"), F.regexp_extract_all(held, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.select("*", words.alias("_s_words"), F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("_s_path"))
    word = lambda i: F.when(i < 1, F.lit("")).otherwise(F.coalesce(F.try_element_at("_s_words", F.greatest(i, F.lit(1))), F.lit("")))
    given = lambda i: word(i - 1).rlike("[:=>][\"'`(]*$") & F.concat_ws(" ", word(i - 2), word(i - 1)).rlike(ASSIGNED + "$")
    at = F.filter(
        F.when(F.size("_s_words") > 0, F.sequence(F.lit(1), F.size("_s_words"))).otherwise(F.array().cast("array<int>")),
        lambda i: (F.length(word(i)) >= SHORT) & (((F.length(word(i)) >= SHORT + 4) & word(i).rlike(VALUE)) | given(i)),
    )
    out = out.withColumn("_s_at", at)
    both = lambda w, pattern: F.struct(F.regexp_extract_all(w, F.lit(pattern), F.lit(0)).alias("values"), F.split(w, pattern, -1).alias("gaps"))
    cut = F.transform("_s_at", lambda i: F.struct(i.alias("i"), F.when(given(i), both(word(i), FIRST_VALUE)).otherwise(both(word(i), VALUE)).alias("cut")))
    out = out.withColumn("_s_cut", F.filter(cut, lambda x: F.size(x["cut"]["values"]) > 0))

    def placed(i: Column, values: Column, gaps: Column) -> Column:
        """The word's candidates: each value with what is before it (only as far as two gaps) and the marks after it."""
        gap = lambda k: F.element_at(gaps, k)
        before = lambda k: F.when(k > 1, F.concat(gap(k - 1), F.element_at(values, F.greatest(k - 1, F.lit(1))))).otherwise("")
        raw = F.transform(F.sequence(F.lit(1), F.size(values)), lambda k: F.struct(k.alias("k"), F.right(F.concat(before(k), gap(k)), F.lit(WINDOW)).alias("past")))
        named = F.transform(raw, lambda x: F.struct(x["k"].alias("k"), x["past"].alias("past"), F.regexp_extract(x["past"], NAME, 0).alias("head")))
        return F.transform(
            named,
            lambda x: F.struct(
                i.alias("word_index"), F.concat(x["head"], F.element_at(values, x["k"]), F.regexp_extract(gap(x["k"] + 1), "^[^A-Za-z0-9]{0,3}", 0)).alias("word"),
                F.element_at(values, x["k"]).alias("value"), F.when((x["k"] == 1) & (x["past"] == x["head"]), word(i - 1)).otherwise("").alias("before1"),
                F.when((x["k"] == 1) & (x["past"] == x["head"]), word(i - 2)).otherwise("").alias("before2"), word(i + 1).alias("after1"), F.col("_s_path").alias("path"),
            ),
        )

    out = out.withColumn("_s_found", F.flatten(F.transform("_s_cut", lambda x: placed(x["i"], x["cut"]["values"], x["cut"]["gaps"]))))
    out = out.withColumn("_s_rated", rated(F.col("_s_found"), ["word_index", "value"]))
    scored = F.transform("_s_rated", lambda f: F.struct(f["word_index"].alias("word_index"), f["value"].alias("value"), detector(f).alias("detector"), F.round(forest.probability(f), 6).alias("probability")))
    out = out.withColumn("_s_scored", scored)
    findings = F.transform("_s_scored", lambda f: F.struct(f["word_index"].alias("word_index"), f["value"].alias("value"), f["detector"].alias("detector"), f["probability"].alias("probability"), (f["probability"] >= 0.5).alias("is_secret")))
    return fenced(out.select(*[F.col(f"`{c}`") for c in docs.columns], findings.alias("_s_findings")), docs.columns)


def detector(f: Column) -> Column:
    return F.when(f["prefix"] == 1.0, "known_prefix").when((f["keyword"] == 1.0) & (f["assigned"] == 1.0), "assignment").otherwise("high_entropy")


def masked(text: str = "text", findings: str = "_s_findings") -> Column:
    """The text with every secret value replaced by MASK."""
    secrets = F.filter(F.col(f"`{findings}`"), lambda f: f["is_secret"])
    return F.aggregate(secrets, F.col(f"`{text}`"), lambda t, f: F.replace(t, f["value"], F.lit(MASK)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = scan(docs).select("doc_id", F.explode("_s_findings").alias("f"))
    return found.select("doc_id", "f.word_index", "f.detector", F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), F.length("f.value").alias("value_length"), "f.probability", "f.is_secret")
