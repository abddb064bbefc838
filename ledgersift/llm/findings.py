"""Labelled findings for the secret scan: a documented table that Spark makes from rules, as no table given holds any.

A finding is a value in its context, labelled by how it was made and not by how it looks: secrets are random keys, tokens and
passwords; false positives are hashes, numbers, paths, names, placeholders and plain words, also behind key words. KINDS lists
them with their labels. Values come from digests of the row number, so the table is the same in each run. A quarter of the rows,
and all rows of the kinds marked unseen, are held out to measure the forest on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 8_000
#: Plain words that passwords, names and contexts are made of.
WORDS = (
    "the", "and", "with", "from", "this", "hunter", "dragon", "secret", "winter", "summer", "monkey", "orange", "letter", "server", "client", "value", "index",
    "report", "account", "customer", "session", "request", "handler", "manager", "factory", "service", "update", "number", "window", "button", "table", "user",
)
_KEY = ("password = \"", "passwd: ", "pwd='", "secret = \"", "client_secret: \"", "token = \"", "access_token=", "api_key = \"", "apikey: '", "key = \"", "auth_token = '", "credential: ", "bearer ", "Authorization: Bearer ")
_PROSE = ("see ", "", "about ", "the ", "in ", "use ", "with ", "- ", "(")
_SUM = ("commit ", "revision ", "sha1: ", "sha256:", "md5 ", "checksum = ", "digest: ", "hash ", "etag: \"")
_NUMBER = ("id: ", "order ", "invoice ", "no. ", "ref ", "phone ", "version ")
#: (kind, label, contexts, value in SQL, unseen). h: 64 random hex digits, m: random mixed letters and digits, a: random letters; w1, w2, w3: words; n: a number.
KINDS = (
    ("hex_key", 1, _KEY, "left(h, 32 + 8 * (n % 4))", False),
    ("mixed_key", 1, _KEY, "left(m, 20 + n % 25)", False),
    ("letters_key", 1, _KEY, "left(a, 16 + n % 30)", False),
    ("letters_then_hex", 1, _KEY, "concat(left(lower(a), 20 + n % 25), left(h, 16))", False),
    ("base64_key", 1, _KEY, "left(base64(unhex(concat(h, h))), 40 + n % 24)", False),
    ("short_key", 1, _KEY, "left(m, 8 + n % 8)", False),
    ("word_password", 1, _KEY[:5], "concat(w1, n % 1000, w2)", False),
    ("sign_password", 1, _KEY[:5], "concat(initcap(w1), '!', n % 1000, left(a, 2))", False),
    ("cloud_id", 1, _KEY + _PROSE, "concat('AKIA', upper(left(m, 16)))", False),
    ("forge_token", 1, _KEY + _PROSE, "concat('ghp_', left(m, 36))", False),
    ("pay_key", 1, _KEY + _PROSE, "concat('sk_live_', left(m, 24))", False),
    ("signed_token", 1, _KEY + _PROSE, "concat('eyJ', left(m, 20), '.eyJ', left(reverse(m), 30), '.', left(m, 43))", False),
    ("lab_token", 1, _KEY + _PROSE, "concat('glpat-', left(m, 20))", True),
    ("chat_token", 1, _KEY + _PROSE, "concat('xoxb-', n, '-', left(m, 24))", True),
    ("uuid", 0, _NUMBER + _PROSE, "concat_ws('-', left(h, 8), substring(h, 9, 4), substring(h, 13, 4), substring(h, 17, 4), substring(h, 21, 12))", False),
    ("sum", 0, _SUM, "left(h, 32 + 8 * (n % 5))", False),
    ("number", 0, _NUMBER + _PROSE, "rpad(conv(left(h, 12), 16, 10), 16 + n % 5, '7')", False),
    ("time", 0, _NUMBER + _PROSE, "concat('20', 10 + n % 15, '-0', 1 + n % 9, '-1', n % 9, 'T1', n % 9, '.', 10 + n % 50, '.', 10 + n % 49)", False),
    ("path", 0, _PROSE, "concat('/', w1, '/', w2, '/', w3, n % 100, '/', w1, '.py')", False),
    ("numbered_path", 0, _PROSE, "concat('/', w1, '/', left(m, 4 + n % 6), '/part-', n, '/', w2)", False),
    ("mail", 0, _PROSE, "concat(w1, '.', w2, n % 100, '@', w3, '.example.org')", False),
    ("site", 0, _PROSE, "concat('www.', w1, w2, '.com/', w3, '/', n)", False),
    ("video_site", 0, _PROSE, "concat('www.', w1, '.com/', w2, '/', left(m, 6 + n % 6))", False),
    ("camel_name", 0, _PROSE + _NUMBER, "concat(w1, initcap(w2), initcap(w3), initcap(w1))", False),
    ("snake_name", 0, _PROSE + _KEY, "concat_ws('_', w1, w2, w3, w2)", False),
    ("long_word", 0, _PROSE, "concat(w1, w2, w3, w1)", False),
    ("shouted_word", 0, _PROSE, "upper(concat(w1, w2, w3, w1))", False),
    ("placeholder", 0, _KEY, "element_at(array('your_api_key_here', 'changeme', 'xxxxxxxxxxxxxxxx', 'example', '<password>', 'None', 'null', 'true', 'required', 'string', '********', 'REPLACE_ME', '${TOKEN}', 'os.environ'), cast(1 + n % 14 as int))", False),
    ("plain_word", 0, _KEY, "w1", False),
    ("plain_words", 0, _KEY, "concat(w1, '.')", False),
    ("small_number", 0, _KEY, "cast(n % 10000 as string)", False),
    ("rule_line", 0, _PROSE, "repeat(element_at(array('-', '.', '_', '/', '+'), cast(1 + n % 5 as int)), cast(16 + n % 40 as int))", False),
    ("call", 0, _KEY, "concat('get', initcap(w1), '(', w2, ')')", False),
    ("dotted_name", 0, _PROSE, "concat_ws('.', w1, w2, w3, w1, w2)", True),
    ("hyphened_name", 0, _PROSE, "concat_ws('-', w1, w2, w3, w1, w2)", False),
)
_PATHS = ("src/app/config.py", "web", "notes.txt", "docs/example.md", "tests/fixtures/data.json", "forum", "crawl")


def labelled(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """doc_id, path, start, value, before, after, label, kind, held_out of ``rows`` findings, as many of each kind."""
    texts = lambda values: "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"
    pick = lambda values, k: f"element_at({values}, cast(1 + pmod(xxhash64(id, {k}), size({values})) as int))"
    words = texts(WORDS)
    mixed = "concat(base64(unhex(sha2(concat('m', id), 256))), base64(unhex(sha2(concat('n', id), 256))))"
    base = spark.range(rows).selectExpr(
        "id", f"cast(id % {len(KINDS)} as int) AS k", "sha2(concat('h', id), 256) AS h", f"regexp_replace({mixed}, '[^A-Za-z0-9]', '') AS m", f"regexp_replace(repeat({mixed}, 2), '[^A-Za-z]', '') AS a",
        f"{pick(words, 1)} AS w1", f"{pick(words, 2)} AS w2", f"{pick(words, 3)} AS w3", f"{pick(words, 4)} AS w4", "pmod(xxhash64(id, 5), 100000) AS n",
    )
    case = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {row}" for k, row in enumerate(i)) + " END"
    lead = case([pick(texts(x[2]), 6) for x in KINDS])
    made = base.selectExpr("*", f"{case([x[3] for x in KINDS])} AS value", f"{lead} AS lead", f"{case([repr(x[0]) for x in KINDS])} AS kind", f"{case([str(float(x[1])) for x in KINDS])} AS label", f"{case([str(x[4]).lower() for x in KINDS])} AS unseen")
    close = F.when(F.col("lead").endswith('"'), '"').when(F.col("lead").endswith("'"), "'").otherwise("")
    before = F.concat_ws(" ", "w4", "w2", "lead")
    return made.select(
        F.col("id").alias("doc_id"), F.expr(pick(texts(_PATHS), 7)).alias("path"), (F.length(before)).alias("start"), "value", before.alias("before"), F.concat(close, F.lit(" "), F.col("w3"), F.lit(" "), F.col("w1")).alias("after"),
        F.col("label").cast("double").alias("label"), "kind", (F.col("unseen") | (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0)).alias("held_out"),
    )
