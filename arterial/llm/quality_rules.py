"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs without ASCII white space. The base counts are exact; the verdict comes from THRESHOLDS, a row of which
is (measure, least, most). A document is kept if it passes the base rule and every measure lies within its bounds.

n_repeat_words counts the words covered by 3-word windows that occur at least twice. The windows' 64-bit hashes are
sorted with their places inside the row, so equal ones become neighbours: n log n in a text's words, without a shuffle.

Edge cases: null text has no words; a text without words has ratios of 0 and fails the base rule; rows are independent,
so repeated rows and a null doc_id are taken as they are; a text of any length is one row's work; extra columns are
ignored, whatever their names; an empty table gives no rows. Of a language that STOP_WORDS doesn't cover, texts can fail
the least share of stop words: that is the rule's verdict, not a lost row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Marks that may follow a word.
MARKS = ".,;:!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Short function words of the languages at hand; texts of any language hold some.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "by", "on", "are", "this", "a", "as", "at", "from",
              "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "pas", "au", "sur",
              "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "als",
              "el", "los", "del", "se", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "y", "es", "e", "o"]
#: (measure, least, most)
THRESHOLDS = [
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", 0.0, 0.4),
    ("stop_ratio", 0.1, 0.95),
    ("capital_ratio", 0.0, 0.6),
    ("dup_line_ratio", 0.0, 0.5),
]


def _let(value, body):
    """body(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words):
    """Words of 3-word windows found at least twice."""
    n = F.size(words)
    windows = F.transform(F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c")),
                          lambda z: F.xxhash64(z["a"], z["b"], z["c"]))

    def count(w):
        def flagged(s):
            m = F.size(s)
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])))
            places = F.array_sort(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("t"), F.lit(-3).alias("e"))
            return F.aggregate(places, start, lambda acc, p: F.struct((acc["t"] + F.lit(3) - F.greatest(F.lit(0), acc["e"] + 3 - p)).cast("int").alias("t"), p.alias("e")), lambda acc: acc["t"])

        marked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(marked, flagged))

    return F.when(n < 4, F.lit(0)).otherwise(_let(F.slice(windows, 1, F.greatest(n - 2, F.lit(0))), count))


def measures(text):
    """name: Column of every count and ratio, from the text column."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    bare = F.translate(text, SPACES, "")
    return {
        "words": words, "lines": lines,
        "word_chars": F.length(bare),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
    }


def rules(docs, id_col: str = "doc_id", text_col: str = "text", thresholds=None):
    """One row per document: base counts, measures and the verdict."""
    thresholds = THRESHOLDS if thresholds is None else thresholds
    m = measures(F.col("text"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def stop(w):
        return F.lower(F.rtrim(w, F.lit(MARKS))).isin(*sorted(set(STOP_WORDS)))

    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id",
        _let(m["words"], lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).cast("long").alias("n_repeat_words"),
                                           F.size(F.filter(w, stop)).cast("long").alias("n_stop_words"))).alias("w"),
        _let(m["lines"], lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        m["word_chars"].cast("long").alias("word_chars"),
        m["n_symbols"].cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
    )

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)

    wide = counted.select("doc_id", F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols", F.col("l.n_dup_lines").alias("n_dup_lines"),
                          F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("l.n_lines").alias("n_lines"), F.col("w.n_stop_words").alias("n_stop_words"), "n_capitals")
    c = F.col
    named = {
        "mean_word_chars": ratio(c("word_chars"), c("n_words")), "symbol_ratio": ratio(c("n_symbols"), c("n_words")),
        "stop_ratio": ratio(c("n_stop_words"), c("n_words")), "capital_ratio": ratio(c("n_capitals"), c("word_chars")),
        "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
    }
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"))
    passes = F.lit(True)
    for name, least, most in thresholds:
        passes = passes & named[name].between(least, most)
    return wide.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & passes).alias("kept"), "n_lines", "n_stop_words", "n_capitals")


def oracle_sql(table: str = "documents") -> str:
    """The same projection as DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    named = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop_words", "n_words"),
             "capital_ratio": ("n_capitals", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines")}
    passes = " AND ".join(f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END) BETWEEN {least} AND {most}"
                          for name, least, most in THRESHOLDS for a, b in [named[name]])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: lower(rtrim(x, '{MARKS}')) IN ({stops}))) AS n_stop_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {passes}) AS kept FROM f
"""
