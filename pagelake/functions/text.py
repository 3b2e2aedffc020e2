"""Text measures; lengths in UTF-8 bytes where thresholds are, classes as Unicode has them.

What is measured word by word (words, syllables, language) is one Arrow function: each distinct word of a batch of texts is looked at once, which nested
native functions with a pattern a word can't do. All else is native.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP_WORDS = {
    "en": """world without with will which while where when what was water under through this think thing they these
    there their them the that than such still some should people place over out our one not into her has have had great
    for first every during could can but between before because been are and all after about your you would""",
    "fr": """être vous voir très tout tous toujours temps sur son ses sans quelque quand premier pour plus petit
    peut personne pendant parce nuit nous même monde mais leur jour jamais ils homme grand femme faites faire fait entre
    encore elle donc deux dans comme chose chez chaque cette bien avoir avec autre aussi alors ainsi""",
    "de": """über zur zum worden wird wir wie werden wenn viel und soll sind sie sich seine sein schon sagen oder
    noch nicht neue nach mit mir klein kann jetzt ist immer ihrer ihre haben hat groß ganz gegen für erste einen eine
    ein durch dieses dieser diese die des der den dem dass das dann bis bei aus auf auch anderer alle aber""",
    "es": """vida una también todos todo tiempo tener sus siempre ser que primero porque por poder país pero parte para
    otro nunca mundo mujer muy más mismo lugar los las hombre hasta han hacer gran forma este estar esta eso esa era
    entre entonces durante donde día después desde del cuando con como casa cada años ahora agua""",
}
STOP_WORDS = {k: sorted(v.split()) for k, v in STOP_WORDS.items()}
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normalise(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, _WS + "+", " "))


def collapse_newlines(text: Column) -> Column:
    """At most two line breaks in a row, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"^{_WS}+|{_WS}+\z", "")


def strip_tags(html: Column) -> Column:
    """What stands outside < and >, normalised; an unclosed < takes all that follows."""
    return normalise(F.replace(F.regexp_replace(html, r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit("")))


_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split takes these for white space
_LETTER = regex.compile(r"\p{Alphabetic}")
_EDGES = regex.compile(r"^\P{Alphabetic}+|\P{Alphabetic}+\Z")
_ENDS = regex.compile("[.!?。！？]")
_VOWELS = regex.compile("[aeiouy]+")
_LE = regex.compile(r"[^aeiouy]le\Z")
_LANGUAGES = ("en", "fr", "de", "es")
_KNOWN = 100_000


def _syllables(word: str) -> int:
    if not word:
        return 0
    if len(word.encode()) <= 3:
        return 1
    n = len(_VOWELS.findall(word))
    n += bool(_LE.search(word)) - (n > 1 and word.endswith("e"))
    return max(n - (n > 1 and word.endswith(("es", "ed"))), 1)


class _Words:
    """Facts of words: (holds a letter, syllables, whether each language lists it), for at most _KNOWN at a time."""

    def __init__(self):
        self.listed = {k: frozenset(v) for k, v in STOP_WORDS.items()}
        self.known: dict[str, tuple] = {}

    def fact(self, word: str) -> tuple:
        bare = (word if word.isalpha() else _EDGES.sub("", word)).lower()
        found = tuple(bare in self.listed[k] for k in _LANGUAGES) if len(bare.encode()) > 2 else ()
        if len(self.known) >= _KNOWN:
            self.known = {}
        fact = self.known[word] = (_LETTER.search(word) is not None, _syllables(bare), found if any(found) else None)
        return fact

    def measures(self, text: str | None) -> tuple:
        text = text or ""
        words = Counter(filter(None, _SPACES.split(text)) if _SEPARATORS.search(text) else text.split())
        lettered = syllables = 0
        hits = [0, 0, 0, 0]
        known = self.known.get
        for w, n in words.items():
            has, s, found = known(w) or self.fact(w)
            lettered += has * n
            syllables += s * n
            if found:
                for k in range(4):
                    hits[k] += found[k] * n
        # of equals the later one
        best = max(range(4), key=lambda k: (hits[k], k))
        return words.total(), lettered, max(len(_ENDS.findall(text)), 1), syllables, _LANGUAGES[best] if hits[best] else None


_COUNTS = ("tokens", "words", "sentences", "syllables")


@F.arrow_udf(T.StructType([*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("language", T.StringType())]))
def _measured(text: pa.Array) -> pa.Array:
    words = _Words()
    rows = list(zip(*(words.measures(t.as_py()) for t in text))) or [()] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [*_COUNTS, "language"])


def measures(text: Column) -> Column:
    """Struct tokens, words, sentences, syllables, language; take it as a column of its own before using its fields."""
    return _measured(text.cast("string"))


def count_words(text: Column) -> Column:
    """Words that hold a letter."""
    return measures(text)["words"]


def count_sentences(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?。！？]")), F.lit(1)).cast("long")


def count_syllables(text: Column) -> Column:
    return measures(text)["syllables"]


def reading_ease(m: Column) -> Column:
    """Flesch reading ease of a measures column, 0 to 100."""
    a, b = m["words"].cast("double") / m["sentences"], m["syllables"].cast("double") / F.nullif(m["words"], F.lit(0))
    score = F.lit(206.835) - F.lit(1.015) * a - F.lit(84.6) * b
    return F.when(m["words"] == 0, 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)))


def grade(m: Column) -> Column:
    """Flesch-Kincaid grade of a measures column, at least 0."""
    a, b = m["words"].cast("double") / m["sentences"], m["syllables"].cast("double") / F.nullif(m["words"], F.lit(0))
    value = F.lit(0.39) * a + F.lit(11.8) * b - F.lit(15.59)
    return F.when(m["words"] == 0, 0.0).otherwise(F.greatest(value, F.lit(0.0)))


def flesch_reading_ease(text: Column) -> Column:
    return reading_ease(measures(text))


def flesch_kincaid_grade(text: Column) -> Column:
    return grade(measures(text))


def detect_language(text: Column) -> Column:
    """The language whose frequent words stand most often in a text; a later one of en, fr, de, es wins a tie."""
    return measures(text)["language"]


def clean_text(text: Column) -> Column:
    """Without control characters other than white space."""
    return F.regexp_replace(text, r"[\p{Cntrl}&&[^\s\x{85}]]", "")


def truncate_text(text: Column, most: int) -> Column:
    """Texts of more than ``most`` bytes cut to most - 3 characters and an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, 1, max(most - 3, 0)), F.lit("..."))).otherwise(text)


def text_content(raw: Column, readability: bool = False) -> Column:
    """Record of a page's text: cleaned text, counts, language, reading time."""
    cleaned = strip_tags(raw)
    words = count_words(cleaned)
    score = F.when(words > 0, flesch_reading_ease(cleaned)) if readability else F.lit(None).cast("double")
    return F.when(
        raw.isNotNull(),
        F.struct(
            raw.alias("raw_text"), cleaned.alias("cleaned_text"), words.alias("word_count"),
            F.char_length(cleaned).cast("long").alias("char_count"), detect_language(cleaned).alias("language"),
            score.alias("readability_score"), F.when(words > 0, words / F.lit(225.0)).alias("reading_time_minutes"),
        ),
    )


def is_substantial(text: Column) -> Column:
    """At least fifty white-space-separated words."""
    return measures(text)["tokens"] >= 50
