"""Quality rules by distribution divergence (native DataFrame functions only).

A document's character-class and common-word histograms are compared with those of its language by the
Jensen-Shannon distance. The language references are medians over groups of sources of the groups' mean histograms.
Only distinct texts that pass the base rules count, each the same, so neither rejected rows nor copies nor a very
long text nor a single hot source shifts them. They are still taken from the judged corpus: a language whose rows
come from one or two sources (or a table without sources) is compared with little but itself.

Defined results: a null text counts as empty; an empty or short text (fewer than ``min_words`` words) fails the
base rule; a language without a word list, or a null one, is compared within the class "other". Repeated rows are
judged alike, extra columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, land, let

# Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht",
           "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}
CLASSES = ["upper", "letter", "digit", "space", "punctuation", "other"]
# Sources are dealt to so many groups, so that sources of a row or two do not each have a vote.
SOURCE_GROUPS = 64
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Largest accepted Jensen-Shannon distances (base 2, so 0 to 1).
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.28
# A shorter text may lack common words by chance.
MIN_WORDS_FOR_COMMON = 100


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the same text.

    Windows are compared by 64-bit hashes inside one row: sorted with their positions, equal neighbours are the
    repeated ones, and the union of their 3-word spans is counted. No row leaves its task.
    """
    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hit = let(pairs, lambda s: F.filter(s, lambda x, k: (
            (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))))
        at = F.sort_array(F.transform(hit, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        done = F.aggregate(at, start, lambda a, p: F.struct(
            (p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")))
        return done["n"]

    counted = let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))))
    return counted.cast("long")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def class_histogram(text: Column) -> Column:
    """Shares of the character classes, in the order of CLASSES."""
    def left(t, pattern, body):
        return let(F.struct(F.length(t).alias("n"), _without(t, pattern).alias("rest")), body)

    def shares(n, upper, letters, digits, space, punct):
        parts = [upper, letters - upper, digits, space, punct, n - letters - digits - space - punct]
        return F.array(*[F.when(n > 0, p / n).otherwise(F.lit(0.0)) for p in parts])

    # Letters go first: the later passes then read only the few characters between the words.
    upper = F.length(text) - F.length(_without(text, r"\p{Lu}+"))
    return let(upper, lambda up: left(text, r"\p{L}+", lambda a: left(a["rest"], r"\s+", lambda b: left(
        b["rest"], r"\p{N}+", lambda c: left(c["rest"], r"[.,;:!?'\"()\-]+", lambda d: shares(
            a["n"], up, a["n"] - b["n"], c["n"] - d["n"], b["n"] - c["n"], d["n"] - F.length(d["rest"])))))))


def word_histogram(words: Column, language: Column) -> Column:
    """Shares of the language's common words (exact lower-case tokens) among all words, then the share of all others."""
    def shares(ws):
        def of(common):
            found = F.filter(ws, lambda w: w.isin(*common))
            counts = let(found, lambda f: F.concat(
                F.array(*[F.size(f) - F.size(F.array_remove(f, w)) for w in common]), F.array(F.size(ws) - F.size(f))))
            return F.transform(counts, lambda c: c / F.greatest(F.size(ws), F.lit(1)))
        out = of(sorted({w for common in COMMON_WORDS.values() for w in common}))
        for name, common in COMMON_WORDS.items():
            out = F.when(language == name, of(common)).otherwise(out)
        return out
    return let(words, shares)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence, base 2) of two histograms of equal length; null
    when one of them is null or has no mass."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def divergence(a, b):
        parts = F.zip_with(a, b, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
        return F.sqrt(F.greatest(total(parts), F.lit(0.0)))

    def scaled(x, s):
        return F.transform(x, lambda v: v / s)

    return let(p, lambda a: let(q, lambda b: let(F.struct(total(a).alias("s"), total(b).alias("t")), lambda u: F.when(
        (u["s"] > 0) & (u["t"] > 0), divergence(scaled(a, u["s"]), scaled(b, u["t"]))))))


def _vector(fold, col: str, length: int) -> Column:
    return F.array(*[fold(F.get(col, F.lit(i))) for i in range(length)])


def quality_features(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str | None = "lang",
                     min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                     source_col: str | None = "source") -> DataFrame:
    """One narrow pass over the texts: the columns ``carry``, the base counts and both histograms of every row."""
    lang = F.col(lang_col) if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    source = F.col(source_col) if source_col and source_col in docs.columns else F.lit(None).cast("string")
    text, words = F.col("__q_text"), F.col("__q_words")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__q_row"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("__q_text"),
                    F.coalesce(F.when(lang.isin(*COMMON_WORDS), lang), F.lit("other")).alias("__q_lang"),
                    F.pmod(F.xxhash64(source), F.lit(SOURCE_GROUPS)).alias("__q_group"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    d = d.withColumn("__q_words", words_of(text)).select(
        "__q_row", "__q_lang", "__q_group", F.xxhash64(text).alias("__q_print"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        repeated_window_words(words).alias("n_repeat_words"),
        class_histogram(text).alias("__q_classes"), word_histogram(words, F.col("__q_lang")).alias("__q_common"))
    return d.withColumn("base_failed", (F.col("n_words") < min_words)
                        | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))


def language_references(features: DataFrame) -> DataFrame:
    """Reference histograms per language, each share the median over the groups of sources of its mean over the
    distinct texts that pass the base rules; one row for each word list at most and one for "other"."""
    longest = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1
    distinct = features.where(~F.col("base_failed")).groupBy("__q_lang", "__q_group", "__q_print").agg(
        F.first("__q_classes").alias("c"), F.first("__q_common").alias("w"))
    means = distinct.groupBy("__q_lang", "__q_group").agg(
        _vector(F.avg, "c", len(CLASSES)).alias("c"), _vector(F.avg, "w", longest).alias("w"))
    out = means.groupBy("__q_lang").agg(_vector(F.median, "c", len(CLASSES)).alias("__q_ref_c"),
                                        _vector(F.median, "w", longest).alias("w"))
    return out.select("__q_lang", "__q_ref_c", F.filter("w", lambda x: x.isNotNull()).alias("__q_ref_w"))


def quality_rules(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text",
                  lang_col: str | None = "lang", min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT, max_class_distance: float = MAX_CLASS_DISTANCE,
                  max_word_distance: float = MAX_WORD_DISTANCE,
                  min_words_for_common: int = MIN_WORDS_FOR_COMMON, source_col: str | None = "source") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept), one row per input row; ``row`` is a struct of the columns ``carry`` (default: all), so
    that no column name can clash.

    The features are landed once: the references need all of them before the first verdict. The references have at
    most five rows (one per word list, and "other"), which is why they are broadcast.
    """
    features = land(quality_features(docs, carry or docs.columns, text_col, lang_col, min_words, max_repeat_percent,
                                     source_col), "quality")
    d = features.join(F.broadcast(language_references(features)), "__q_lang", "left")
    judged = ~F.col("base_failed")
    d = d.withColumns({
        "class_distance": F.when(judged, jensen_shannon(F.col("__q_classes"), F.col("__q_ref_c"))),
        "word_distance": F.when(judged & (F.col("n_words") >= min_words_for_common), jensen_shannon(F.col("__q_common"), F.col("__q_ref_w"))),
    })
    fits = (F.coalesce(F.col("class_distance") <= max_class_distance, F.lit(True))
            & F.coalesce(F.col("word_distance") <= max_word_distance, F.lit(True)))
    return d.select(F.col("__q_row").alias("row"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "class_distance", "word_distance", (judged & fits).alias("kept"))
