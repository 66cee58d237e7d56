"""Quality rules: word statistics of each document, and lines that too many documents of one host share.

The host of a document is its source. A line is normalised (lower case, digits to 0, runs of white space to one space) and
hashed. For each host the distinct documents of every line hash are counted over the whole table; a line in more of them
than the host's limit is boilerplate and goes. A document that loses too many of its words to that is depleted and rejected.

Only DataFrame functions. A line travels as a host, a hash and a doc_id. Counting is in two steps, so that a line that
stands in a third of all documents is a partial count per task; the lines of a document are looked up in the table of boilerplate
lines, by a join whose hot keys are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: White space between words, as a class of regular expressions, and what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE + "+", " "), "^ | $", "")


def repeated_words(windows: Column) -> Column:
    """Words in windows that occur more than once, from the hashes of all windows in order (an array of longs)."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def alike(x: Column, k: Column, s: Column) -> Column:
        before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
        after = F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.when(before | after, x["i"])

    starts = F.transform(F.array(placed), lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: alike(x, k, s)), lambda i: i.isNotNull())))
    covered = F.transform(starts, lambda at: F.aggregate(
        F.transform(at, lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - F.get(at, k - 1)))), F.lit(0).cast("long"), lambda a, n: a + n))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(F.get(covered, F.lit(0)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of text (null: no words)."""
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    last = F.size("_words") - WINDOW
    df = df.withColumn("_windows", F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))))
    return df.select(
        *docs.columns, "n_words",
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
    )


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised line of a row of docs: host, doc_id, key, line_hash and n, the words in all its occurrences."""
    rows = docs.select("host", "doc_id", "key", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    rows = rows.select("host", "doc_id", "key", normalised(F.col("line")).alias("line")).where("line <> ''")
    return rows.select("host", "doc_id", "key", F.xxhash64("line").alias("line_hash"), F.regexp_count("line", F.lit("[^ ]+")).cast("long").alias("n"))


def boilerplate(lines: DataFrame, hosts: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(host, line_hash) of lines in more distinct documents of a host than max(least_docs, share of the host's documents)."""
    once = lines.select("host", "line_hash", "doc_id").distinct()
    counted = once.groupBy("host", "line_hash").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["h"])).where(F.col("docs") > share * F.col("all_docs")).select("host", "line_hash")


def apply_rules(docs: DataFrame, least_docs: int = 20, share: float = 0.002, keep_share: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20, salts: int = 16) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_boilerplate_words.

    A line is boilerplate if more distinct doc_id of one source have it than least_docs and than share of the source's.
    kept: not base_failed, and at least min_words words and keep_share of all words remain without boilerplate.
    A null text has no words and fails; null sources are a host of their own; rows with one doc_id count once; repeated rows get
    the same result each. Other columns of docs are ignored.
    """
    # The hashes of a row's text and host tell rows with one doc_id apart.
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("host"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text", "host"))
    stats = statistics(base).drop("text")
    lines = materialize(lines_of(base))
    hosts = base.groupBy(F.col("host").alias("h")).agg(F.countDistinct("doc_id").alias("all_docs"))
    common = materialize(boilerplate(lines, hosts, least_docs, share))
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = lines.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")).withColumnRenamed("host", "_host")
    found = found.join(salted, (found["line_hash"] == salted["line_hash"]) & found["_host"].eqNullSafe(salted["host"]) & (found["salt"] == salted["salt"]), "left_semi")
    # A repeated row has its lines as often as it stands in the table.
    lost = found.groupBy("key").agg(F.sum("n").alias("lost"))
    times = base.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    lost = lost.join(times, "key", "left").select("key", F.expr("lost div coalesce(times, 1)").alias("lost"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return stats.join(lost, "key", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= keep_share * F.col("n_words"))).alias("kept"), F.coalesce("lost", F.lit(0)).cast("long").alias("n_boilerplate_words"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source AS host FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(len(words) - 4)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 5], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(5)) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, host, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
      FROM (SELECT doc_id, host, unnest(lines) AS x FROM w)),
n AS (SELECT host, line, count(DISTINCT doc_id) AS docs FROM l GROUP BY host, line),
h AS (SELECT host, count(DISTINCT doc_id) AS all_docs FROM d GROUP BY host),
b AS (SELECT n.host, n.line FROM n JOIN h ON n.host IS NOT DISTINCT FROM h.host WHERE docs > 20 AND docs > 0.002 * all_docs),
lost AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS lost FROM l JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.lost, 0) AS lost
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - lost >= 10 AND n_words - lost >= 0.5 * n_words AS kept,
       CAST(lost AS BIGINT) AS n_boilerplate_words
FROM s
"""
