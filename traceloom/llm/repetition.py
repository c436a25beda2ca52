"""Repetition inside a single document (problem 9): a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.binding import let
from traceloom.operators.shared import spread

# The white space between words, the letters that are lowered, the scripts written without spaces.
SPACE = "[ \t\n\r]+"
EDGE = " \t\n\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# Common function words (in Chinese and Japanese, characters) of the languages that the corpus declares.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "for", "it", "on", "this", "not", "from", "when"),
    "de": ("der", "die", "das", "und", "zu", "in", "nicht", "ist", "den", "mit", "von", "für", "auf", "ein", "eine", "wenn", "im", "bei"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "pour", "dans", "que", "est", "pas", "sur", "avec", "au"),
    "es": ("el", "la", "los", "de", "y", "que", "en", "un", "una", "por", "con", "para", "no", "es", "se", "del", "al", "las"),
    "ru": ("и", "в", "не", "на", "с", "что", "по", "для", "из", "к", "при", "если", "от", "это", "как", "или", "без", "до"),
    "zh": ("的", "了", "是", "在", "和", "不", "有", "中", "时", "为", "当", "与", "以", "对", "从", "到", "个", "这"),
    "ja": ("の", "を", "に", "は", "が", "と", "で", "た", "し", "て", "な", "も", "る", "す", "い", "か", "ら", "れ"),
}

WINDOW = 5
#: Windows of texts in scripts without spaces, whose units are characters.
WIDE_WINDOW = 10


@dataclass(frozen=True)
class Threshold:
    """One row of the table: a document breaks the rule if ``metric`` is under ``low``, over ``high``, or not below ``below``."""

    rule: str
    metric: str
    low: float | None = None
    high: float | None = None
    below: float | None = None

    def broken(self, value: Column) -> Column:
        sides = [(value < F.lit(self.low), self.low), (value > F.lit(self.high), self.high), (value >= F.lit(self.below), self.below)]
        out = F.lit(False)
        for test, bound in sides:
            if bound is not None:
                out = out | test
        return out


#: Words and windows of the repetition case; the driver's cases are the documents that keep the first rule and break the second.
REPEATED = (Threshold("long_enough", "n_words", low=20), Threshold("repeated_windows", "window_share", below=0.4))

#: Bounds of ordinary prose and code. Repeated shares are shares of the text's characters, except those of windows.
QUALITY = (
    Threshold("length", "n_units", low=20, high=100_000),
    Threshold("unit_length", "mean_unit_chars", low=1, high=12),
    Threshold("symbols", "symbol_ratio", high=0.35),
    Threshold("stop_words", "stop_words", low=1),
    Threshold("repeated_lines", "line_chars", high=0.3),
    Threshold("repeated_paragraphs", "paragraph_chars", high=0.3),
    Threshold("repeated_sentences", "sentence_chars", high=0.3),
    Threshold("repeated_words", "window_share", below=0.4),
    Threshold("repeated_units", "unit_share", below=0.4),
    Threshold("repeated", "repeated_share", below=0.4),
)


def _share(units: Column) -> Column:
    """One minus distinct units by units; 0 without units."""
    return let(
        units,
        lambda u: F.when(F.size(u) == 0, F.lit(0.0)).otherwise(
            1 - F.size(F.array_distinct(u)).cast("double") / F.size(u).cast("double")
        ),
    )


def _chars(units: Column) -> Column:
    return F.aggregate(units, F.lit(0), lambda a, x: a + F.length(x)).cast("double")


def _char_share(units: Column) -> Column:
    """The share of the units' characters that lie in a unit which occurred before; 0 without units."""
    return let(units, lambda u: F.when(F.size(u) == 0, F.lit(0.0)).otherwise(1 - _chars(F.array_distinct(u)) / _chars(u)))


def _parts(text: Column, cut: str) -> Column:
    return F.filter(F.transform(F.split(text, cut), lambda p: F.btrim(p, F.lit(EDGE))), lambda p: p != "")


def _windows(units: Column, width: Column) -> Column:
    """Runs of ``width`` units; none of a shorter text. Units hold no space, so joining by one keeps different runs different."""
    starts = F.sequence(F.lit(1), F.size(units) - width + 1)
    joined = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(units, i, width)))
    return F.when(F.size(units) >= width, joined).otherwise(F.array().cast("array<string>"))


def _unit_share(text: Column, units: Column) -> Column:
    unspaced = F.length(F.regexp_replace(text, f"[^{UNSPACED}]+", ""))
    width = F.when(unspaced * 2 >= F.size(units), WIDE_WINDOW).otherwise(WINDOW)
    return _share(let(width, lambda n: _windows(units, n)))


def _known_words(units: Column) -> Column:
    lowered = F.transform(units, F.lower)
    return let(lowered, lambda u: F.greatest(*(F.size(F.array_intersect(u, F.array(*map(F.lit, words)))) for words in STOP_WORDS.values())))


#: What measures are taken of: the words of TESTDATA's case; units, which are words and, in scripts without spaces, characters;
#: and lines, paragraphs and sentences, trimmed, empty ones left out.
PARTS = {
    "words": lambda t: F.filter(F.split(F.translate(t, UPPER, LOWER), SPACE), lambda w: w != ""),
    "units": lambda t: F.regexp_extract_all(t, F.lit(f"[{UNSPACED}]|[^{EDGE}{UNSPACED}]+"), F.lit(0)),
    "lines": lambda t: _parts(t, "\r\n|\n|\r"),
    "paragraphs": lambda t: _parts(t, "(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)"),
    "sentences": lambda t: _parts(t, "[.!?。！？]+|\n"),
}

#: Measures that a table can name, with the parts they need, from the text (t) and its parts (p).
MEASURES = {
    "n_chars": ((), lambda t, p: F.length(t)),
    "n_words": (("words",), lambda t, p: F.size(p["words"])),
    "n_units": (("units",), lambda t, p: F.size(p["units"])),
    "mean_unit_chars": (("units",), lambda t, p: F.when(F.size(p["units"]) == 0, F.lit(0.0)).otherwise(_chars(p["units"]) / F.size(p["units"]).cast("double"))),
    "symbol_ratio": ((), lambda t, p: F.when(F.length(t) == 0, F.lit(0.0)).otherwise(
        F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{EDGE}]", "")).cast("double") / F.length(t).cast("double")
    )),
    "stop_words": (("units",), lambda t, p: _known_words(p["units"])),
    "line_share": (("lines",), lambda t, p: _share(p["lines"])),
    "paragraph_share": (("paragraphs",), lambda t, p: _share(p["paragraphs"])),
    "sentence_share": (("sentences",), lambda t, p: _share(p["sentences"])),
    "window_share": (("words",), lambda t, p: _share(_windows(p["words"], F.lit(WINDOW)))),
    "line_chars": (("lines",), lambda t, p: _char_share(p["lines"])),
    "paragraph_chars": (("paragraphs",), lambda t, p: _char_share(p["paragraphs"])),
    "sentence_chars": (("sentences",), lambda t, p: _char_share(p["sentences"])),
    "unit_share": (("units",), lambda t, p: _unit_share(t, p["units"])),
}
#: The one share of a document, whatever the unit that is repeated: the largest of these.
ANY_UNIT = ("line_chars", "paragraph_chars", "sentence_chars", "unit_share")


def measure(docs: DataFrame, rules: tuple[Threshold, ...] = QUALITY, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Measures and broken rules of every document: the table becomes one projection over one scan, without
    user function or shuffle by key.

    Returns ``id_col``, one column per measure in ``rules`` and ``broken`` (names of the rules that the document breaks,
    in the table's order). Shares of lines, paragraphs and sentences ending in ``_chars`` are shares of their characters
    that repeat an earlier one, those of windows are one minus distinct windows by windows; ``repeated_share`` is the
    largest of ``ANY_UNIT``. Windows are five words, or ten characters where a text is mostly in a script without spaces.
    Null, empty and blank texts have share 0 and no words. Every input row gives a row, also copies and null ids; further
    columns are left out, so their names can't clash.
    """
    names = list(dict.fromkeys(r.metric for r in rules))
    plain = list(dict.fromkeys(m for n in names for m in (ANY_UNIT if n == "repeated_share" else (n,))))
    parts = list(dict.fromkeys(p for n in plain for p in MEASURES[n][0]))

    def judge(t: Column) -> Column:
        taken = F.struct(*(PARTS[n](t).alias(n) for n in parts)) if parts else F.struct(F.lit(0).alias("none"))
        measured = let(taken, lambda p: F.struct(*(MEASURES[n][1](t, p).alias(n) for n in plain)))

        def rated(m: Column) -> Column:
            value = lambda n: F.greatest(*(m[x] for x in ANY_UNIT)) if n == "repeated_share" else m[n]
            broken = F.array_compact(F.array(*(F.when(r.broken(value(r.metric).cast("double")), F.lit(r.rule)) for r in rules)))
            return F.struct(*(value(n).alias(n) for n in names), broken.alias("broken"))

        return let(measured, rated)

    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")))
    judged = rows.select("_id", let(F.coalesce(F.col("_text"), F.lit("")), judge).alias("_m"))
    return judged.select(F.col("_id").alias(id_col), *(F.col(f"_m.{n}").alias(n) for n in names), F.col("_m.broken").alias("broken"))


def repeated_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``share`` of the documents of at least 20 words whose five-word windows repeat by 0.4 or more (``REPEATED``)."""
    rows = measure(docs, REPEATED)
    hit = F.array_contains("broken", "repeated_windows") & ~F.array_contains("broken", "long_enough")
    return rows.where(hit).select("doc_id", F.col("window_share").alias("share"))
