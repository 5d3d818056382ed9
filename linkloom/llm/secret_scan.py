"""Operator 6, secret scans: DataFrame and SQL functions only.

Candidates are signed web tokens, passwords in addresses, long runs of key characters with a digit,
with the prefix of a known kind of key, or behind an assignment or a word that names secrets, and
values of any length and characters that are assigned to such a name. A random forest judges each by
length, character transitions, dictionary coverage, path and neighbouring words, and takes out false
positives. The forest in secret_forest.json was trained by secret_train.py from labelled findings; it
runs as nested CASE expressions, so scoring stays in the generated code of the scan.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import table

NAMES = "(?i:secret|token|passw|passphrase|pwd|key|auth|bearer|credential|private)"
# A cheap look at the character before comes first wherever a look further back follows.
CANDIDATE = (
    r"eyJ(?<![A-Za-z0-9+/_-]eyJ)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    r"|(?<=:)(?<=[a-z]://[^\s/:@]{1,64}:)[^\s/@\"'`<>]+(?=@)"
    r"|(?<![A-Za-z0-9+/_-])(?:(?:(?=[A-Za-z+/_-]*+[0-9])|(?=[A-Za-z+/_-]{16})(?!//)(?:(?<=[=:]\s{0,2}[\"']?)|(?<=" + NAMES + r"[^\n]{0,40})))[A-Za-z0-9+/_-]{16,}={0,2}"
    r"|(?:AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|xox[a-z]-)[A-Za-z0-9+/_-]{12,}={0,2}"
    r"|(?<=[=:\s\"'])(?:(?<=[=:]\s{0,2}[\"']?)(?<=" + NAMES + r"[A-Za-z0-9_ -]{0,24}[\"']?\s{0,2}:?[=:]\s{0,2}[\"']?)|(?<=[ \"'])(?<=(?i:passw(?:or)?d|passphrase|pwd|bearer) (?:is )?[\"']?))"
    r"(?!(?i:bearer|basic)\b)(?![=:]|//)[^\s\"'`<>,;]*[^\s\"'`<>,;.)])"
)
BEFORE, AFTER = 48, 24
STEP = 32
#: Frequent words inside names, paths and sample values; longer ones first.
DICTIONARY = "placeholder password example version default article content product service request account session profile picture sample secret public system update manager config report upload search change string number system image index value table class model theme style asset token order event group query state world hello media video local admin login build cache date page file name user data item list code test main text http html json type info page blog post shop view and for the net www com org key api img css app".split()
FEATURES = {
    "length": "least(char_length(c), 200) * 1.0",
    "transitions": "regexp_count(c, '(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])') / char_length(c)",
    "digits": "regexp_count(c, '[0-9]') / char_length(c)",
    "upper": "regexp_count(c, '[A-Z]') / char_length(c)",
    "marks": "regexp_count(c, '[+/_-]') / char_length(c)",
    "distinct": "size(array_distinct(split(c, ''))) / least(char_length(c), 40)",
    "dictionary": f"1 - char_length(regexp_replace(lower(c), '{'|'.join(DICTIONARY)}', '')) / char_length(c)",
    "hex": "CAST(c RLIKE '^[0-9a-f]+$' OR c RLIKE '^[0-9A-F]+$' AS DOUBLE)",
    "longest_run": "CAST(c RLIKE '(.)\\\\1{4}|01234|12345|abcdef' AS DOUBLE)",
    "path": "CAST(before RLIKE '[/.@]$|://[^ ]*$' OR after RLIKE '^[.][a-z]|^[/@]' AS DOUBLE)",
    "assigned": "CAST(before RLIKE '[=:]\\\\s{0,2}[\"\\']?$' OR before RLIKE '(?i)bearer $' AS DOUBLE)",
    "secret_word": "CAST(before RLIKE '(?i)secret|token|passw|api.?key|access.?key|auth|bearer|credential|private' AS DOUBLE)",
    "hash_word": "CAST(before RLIKE '(?i)sha\\\\d*|md5|commit|checksum|digest|uuid|etag|revision|hash|build|isbn|order|invoice|phone|iban' AS DOUBLE)",
    "quoted": "CAST(before RLIKE '[\"\\']$' AS DOUBLE)",
    "equals": "CAST(before RLIKE '=\\\\s{0,2}[\"\\']?$' AS DOUBLE)",
    "code": "CAST(c RLIKE '[.({$\\\\[][A-Za-z]|[)}]$' AS DOUBLE)",
    "state_word": "CAST(c RLIKE '(?i)^(none|null|nil|true|false|required|optional|string|hidden|missing|changed|expired|invalid|empty|unset|below|see|is|reset|redacted|[*x.-]+)$' AS DOUBLE)",
    "in_address": "CAST(before RLIKE '[a-z]://[^\\\\s/:@]*:$' AND after LIKE '@%' AS DOUBLE)",
    "signed": "CAST(c RLIKE '^eyJ[^.]+[.][^.]+[.]' AS DOUBLE)",
    "sample_word": "CAST(concat(right(before, 16), c) RLIKE '(?i)example|sample|dummy|placeholder|your|xxxx|test' AS DOUBLE)",
}


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each worked out once, however often it is used later."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def _sums(values: str, at: Column, n: int | Column) -> Column:
    return F.aggregate(F.slice(values, at + 1, F.lit(n) if isinstance(n, int) else n), F.lit(0).cast("long"), lambda a, x: a + x)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, c, before, after): each candidate with its place (code points) and neighbouring text.

    A text's matches are cut out in one pass and exploded with no more than their neighbourhood. Places
    are running sums over blocks of blocks of STEP matches, so time and memory grow with the text, not
    with its square.
    """
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    cut = _once(rows, between=F.split("text", CANDIDATE, -1), found=F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).drop("text")
    lengths = F.transform("found", lambda c, i: (F.char_length(F.get("between", i)) + F.char_length(c)).cast("long"))
    cut = _once(cut, n0=lengths)
    blocks = lambda values: F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(STEP)), lambda at: _sums(values, at, STEP))
    cut = _once(cut, n1=blocks("n0"))
    cut = _once(cut, n2=blocks("n1"))
    whole = lambda i, step: F.floor(i / step).cast("int")
    cut = _once(cut, s2=F.transform("n2", lambda _, i: _sums("n2", F.lit(0), i)))
    cut = _once(cut, s1=F.transform("n1", lambda _, i: F.get("s2", whole(i, STEP)) + _sums("n1", whole(i, STEP) * STEP, F.pmod(i, F.lit(STEP)))))

    # Text and matches in turn, each with no more of it than a neighbourhood takes; a match has a character at least.
    in_turn = lambda end, n: F.flatten(F.transform("between", lambda b, i: F.array(end(b, F.lit(n)), F.coalesce(end(F.get("found", i), F.lit(n)), F.lit("")))))
    cut = _once(cut, tails=in_turn(F.right, BEFORE), heads=in_turn(F.left, AFTER))

    def each(c: Column, i: Column) -> Column:
        start = F.get("s1", whole(i, STEP)) + _sums("n0", whole(i, STEP) * STEP, F.pmod(i, F.lit(STEP))) + F.char_length(F.get("between", i))
        first = F.greatest(F.lit(1), 2 * i + 1 - 2 * BEFORE)
        before = F.right(F.array_join(F.slice("tails", first, 2 * i + 2 - first), ""), F.lit(BEFORE))
        after = F.left(F.array_join(F.slice("heads", 2 * i + 3, F.lit(2 * AFTER)), ""), F.lit(AFTER))
        return F.struct(start.alias("start"), c.alias("c"), before.alias("before"), after.alias("after"))

    return cut.select("doc_id", F.inline(F.transform("found", each)))


def with_features(found: DataFrame) -> DataFrame:
    return found.select("*", *[F.expr(sql).cast("double").alias(f"f_{name}") for name, sql in FEATURES.items()])


def _tree(node: list | float) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    name, cut, low, high = node
    return F.when(F.col(f"f_{name}") <= cut, _tree(low)).otherwise(_tree(high))


def load_forest() -> list:
    return json.loads(Path(__file__).with_name("secret_forest.json").read_text())


def scan(docs: DataFrame, forest: list | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, n_chars, secret, before, score, is_secret) for each candidate in docs (doc_id, text).

    score is the mean over the trees, is_secret whether it reaches threshold. Null and empty texts
    have no candidates; whole texts of any length are read. Repeated rows give repeated findings; a null doc_id is
    carried along; further columns are not read; an empty table gives an empty result.
    """
    trees = forest or load_forest()
    score = reduce(lambda a, b: a + b, [_tree(t) for t in trees]) / len(trees)
    out = with_features(candidates(docs)).select("doc_id", "start", F.char_length("c").cast("long").alias("n_chars"), F.col("c").alias("secret"), "before", F.round(score, 6).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_chars, secret_sha256, score, is_secret of every candidate in every document."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_chars", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score", "is_secret")
