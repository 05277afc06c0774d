"""Line-first quality rules, in SQL functions only.

Every line is judged by itself; failing lines are removed, then a document goes that lost too much of its text.
A line fails when it
- equals an earlier line of the document (repeat),
- has over 3 of the characters #*$%&|<> for 10 words (symbols), or separators |, », ›, • or · for a third of its words (navigation),
- has three words or more, all of whose letters are capitals, or exclamation marks for over 3 of 10 words (shouting),
- has one or two words and does not end as a sentence does (menu entries),
- has over 40 words and no punctuation at all,
- has up to 20 words and one of the BOILERPLATE phrases.
Lines without a word count for nothing. kept: not base_failed, and the lines left hold 70 % of the words or more.

Null or empty text: all counts 0, base_failed (fewer than 20 words), not kept, empty clean_text. Null ids stay, repeated
rows each give a row, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import free_name

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SYMBOLS, SEPARATORS = "#*$%&|<>", "|»›•·"
#: Phrases of page furniture.
BOILERPLATE = ["all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy", "use cookies", "enable javascript", "click here", "sign in", "log in", "subscribe now", "read more", "lorem ipsum"]
MIN_KEPT_PERCENT, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 70, 20, 30, 8


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def removed(text: Column, chars: str) -> Column:
    """How many characters of `chars` the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_passes(line: Column) -> Column:
    def judged(n: Column) -> Column:
        menu = (n <= 2) & ~line.rlike(r"""[.!?…:;"'”»)\]。！？][\x20\x09-\x0D]*$""")
        shouting = (10 * removed(line, "!") > 3 * n) & (n > 3) | (n >= 3) & (F.upper(line) == line) & (F.lower(line) != line)
        bare = (n > 40) & ~line.rlike("[.,;:!?…。，、！？]")
        furniture = (n <= 20) & F.lower(line).rlike("|".join(BOILERPLATE))
        return ~((10 * removed(line, SYMBOLS) > 3 * n) | (3 * removed(line, SEPARATORS) >= n) & (removed(line, SEPARATORS) > 1) | menu | shouting | bare | furniture)

    return let(F.regexp_count(line, F.lit(WORD)), judged)


def repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce((F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | F.lit(False), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == F.get(s, k)["h"], F.lit(False)))
            starts = F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(windows), marked))

    def hashed(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))), covered)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def judgement(text_col: str) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept, n_words_kept, clean_text as a struct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = let(F.array_remove(F.split(text, GAP), ""), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))

    def by_line(lines: Column) -> Column:
        return let(
            F.array_distinct(lines),
            lambda once: let(
                F.filter(once, line_passes),
                lambda left: F.struct(
                    (F.size(lines) - F.size(once)).cast("long").alias("n_dup_lines"),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.size(left).cast("long").alias("n_lines_kept"),
                    F.aggregate(left, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD))).cast("long").alias("n_words_kept"),
                    F.when(F.size(left) == F.size(lines), text).otherwise(F.array_join(left, "\n")).alias("clean_text"),
                ),
            ),
        )

    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), by_line)
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")
    return F.struct(counts.alias("w"), lines.alias("l"), chars.alias("word_chars"), removed(text, SYMBOLS).cast("long").alias("n_symbols"))


def verdicts(n_words: Column, n_repeat_words: Column, n_words_kept: Column) -> tuple[Column, Column]:
    """base_failed and kept."""
    failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)
    return failed, ~failed & (100 * n_words_kept >= MIN_KEPT_PERCENT * n_words)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_kept, n_words_kept, clean_text, base_failed, kept."""
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), judgement(text_col).alias("j")).select("doc_id", "j.w.n_words", "j.word_chars", "j.n_symbols", "j.l.n_dup_lines", "j.w.n_repeat_words", "j.l.n_lines", "j.l.n_lines_kept", "j.l.n_words_kept", "j.l.clean_text")
    failed, kept = verdicts(F.col("n_words"), F.col("n_repeat_words"), F.col("n_words_kept"))
    return flat.withColumns({"base_failed": failed, "kept": kept})


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, without their failing lines; all columns as they came."""
    j = free_name(docs, "judged")
    judged = docs.withColumn(j, judgement(text_col))
    kept = verdicts(F.col(f"{j}.w.n_words"), F.col(f"{j}.w.n_repeat_words"), F.col(f"{j}.l.n_words_kept"))[1]
    return judged.where(kept).select(*[F.col(f"{j}.l.clean_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: The same for DuckDB.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
windows AS (SELECT r, i, array_to_string(words[i : i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)),
judged AS (SELECT r, k, n, line, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup,
  length(line) - length(translate(line, '{SYMBOLS}', '')) AS sym, length(line) - length(translate(line, '{SEPARATORS}', '')) AS sep, length(line) - length(replace(line, '!', '')) AS bang
  FROM lines WHERE n > 0),
kept_lines AS (SELECT r, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN dup OR 10 * sym > 3 * n OR (3 * sep >= n AND sep > 1)
    OR (n <= 2 AND NOT regexp_matches(line, '[.!?…:;"''”»)\]。！？][\x20\x09-\x0D]*$'))
    OR (10 * bang > 3 * n AND n > 3) OR (n >= 3 AND upper(line) = line AND lower(line) <> line)
    OR (n > 40 AND NOT regexp_matches(line, '[.,;:!?…。，、！？]'))
    OR (n <= 20 AND regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')) THEN 0 ELSE n END) AS n_words_kept FROM judged GROUP BY r),
base AS (SELECT d.doc_id, len(w.words) AS n_words, length(translate(d.text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) AS word_chars,
  length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS n_symbols, coalesce(k.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words, coalesce(k.n_words_kept, 0) AS n_words_kept
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN kept_lines k USING (r)),
judgement AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_words_kept >= {MIN_KEPT_PERCENT} * n_words AS kept FROM judgement
"""
