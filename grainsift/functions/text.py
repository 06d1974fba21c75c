"""Measures of a text as plain column expressions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grainsift.functions import fixed_values as fixed

# plain letters first: they are told apart fastest
WORD = r"[a-z0-9_\p{L}\p{N}]"
_VOWEL = f"[{fixed.VOWELS}]"
_OTHER = rf"[bcdfghjklmnpqrstvwxz0-9_[\p{{L}}\p{{N}}&&[^{fixed.VOWELS}]]]"
_NO_WORD_BEFORE = rf"(?<!{WORD})"
_NO_WORD_AFTER = rf"(?!{WORD})"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD}+)"), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


def sentence_count(text: Column) -> Column:
    """Pieces between full stops, exclamation and question marks that hold more than white space."""
    return F.regexp_count(text, F.lit(r"(?U)[^.!?\s][^.!?]*"))


def syllable_count(text: Column) -> Column:
    """Syllables of all words of the text.

    Every run of vowels is one syllable. A word whose final ``e`` ends a second or later run
    has one less, a word without vowels has one. Three counts over the text give the sum, with
    no array of words.
    """
    low = F.lower(text)
    runs = F.regexp_count(low, F.lit(f"{_VOWEL}+"))
    silent = F.regexp_count(low, F.lit(f"{_VOWEL}{_OTHER}++{_VOWEL}*e{_NO_WORD_AFTER}"))
    voiceless = F.regexp_count(low, F.lit(f"{_NO_WORD_BEFORE}{_OTHER}++{_NO_WORD_AFTER}"))
    return runs - silent + voiceless


def reading_ease(text: Column) -> Column:
    n_words = word_count(text).cast("double")
    n_sentences = sentence_count(text).cast("double")
    score = (F.lit(fixed.FLESCH_BASE)
             - F.lit(fixed.FLESCH_WORDS) * n_words / F.nullif(n_sentences, F.lit(0.0))
             - F.lit(fixed.FLESCH_SYLLABLES) * syllable_count(text) / F.nullif(n_words, F.lit(0.0)))
    return F.when(score.isNotNull(),
                  F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))


def language(text: Column) -> Column:
    """Language with most distinct stopwords in the text; ties go to the first language."""
    found = F.array_distinct(F.split(F.lower(text), r"[^a-z0-9_\p{L}\p{N}]+"))
    scores = {lang: F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in ws])))
              for lang, ws in fixed.STOPWORDS.items()}
    best = F.greatest(*scores.values())
    label = F.when(text.isNull(), F.lit(None)).when(best == 0, F.lit("other"))
    for lang, score in scores.items():
        label = label.when(score == best, F.lit(lang))
    return label


def has_encoding_issue(text: Column, ignore_ws: bool = False) -> Column:
    """Replacement character or control character anywhere in the text."""
    controls = r"\x00-\x08\x0B\x0C\x0E-\x1F" if ignore_ws else r"\x00-\x1F"
    return text.rlike(rf"[{controls}\x7F-\x9F\x{{FFFD}}]")


def tokens(text: Column) -> Column:
    """Distinct pieces between white space."""
    return F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def row_tokens(columns: list[Column], lower: bool) -> Column:
    """Distinct white-space pieces of several text columns taken together."""
    joined = F.concat_ws(" ", *columns)
    return tokens(F.lower(joined) if lower else joined)
