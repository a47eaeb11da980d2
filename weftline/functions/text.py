"""Column functions that normalise and compare texts.

Everything here stays in the JVM.  Character classes are written out, as Java's
``\\w`` and ``\\d`` are ASCII while texts hold Latin and Devanagari.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9ऀ-ॿ]+"
DEVANAGARI = "[ऀ-ॿ]"
#: Function words that carry no fact; a caller may pass another set.
STOPWORDS = tuple(sorted({"a", "an", "and", "are", "at", "be", "been", "by", "for", "in", "is", "of", "on", "or", "the", "to", "under", "was", "were", "with"}))
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = {w: 20 + 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
UNITS = {w: i for i, w in enumerate(_SMALL)} | _TENS | {"hundred": 100}
SCALES = {"thousand": 10**3, "lakh": 10**5, "lakhs": 10**5, "million": 10**6, "crore": 10**7, "crores": 10**7}
#: Numerals that the strict matcher folds one by one; thirteen, sixteen to nineteen, forty, fifty, seventy and eighty aren't among them.
STRICT_NUMERALS = {w: str(UNITS[w]) for w in (*_SMALL[1:13], "fourteen", "fifteen", "twenty", "thirty", "sixty", "ninety")}
_MARKS = "!?.:;,\"'“”‘’`_|/—–॥।#%*&=+><}{-"
PUNCT = "[\\\\\\[\\]" + _MARKS + "]"
PUNCT_AND_PARENS = "[\\\\\\[\\]()" + _MARKS + "]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and Devanagari, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def squeeze(text: str | Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"[\s ]+", " "))


def split_words(text: str | Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"[\s ]+"), lambda x: x != "")


def word_count(text: str | Column) -> Column:
    return F.size(split_words(text))


def row_words(title: str | Column, text: str | Column, overhead: int = 10) -> Column:
    """Words of a titled row in a prompt, its frame counted as ``overhead``."""
    return word_count(title) + word_count(text) + overhead


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def strict_normal(text: str | Column) -> Column:
    """Lower case, section sign spelled out, digit commas and punctuation gone, single numerals as digits."""
    t = F.replace(F.lower(_c(text)), F.lit("§"), F.lit(" section "))
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9])", "")
    t = squeeze(F.regexp_replace(t, PUNCT, " "))
    numerals = _map(STRICT_NUMERALS)
    # numerals stand between any non-word characters, parentheses too
    parts = F.regexp_extract_all(t, F.lit("([a-z0-9]+|[^a-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.element_at(numerals, w), w)), "")


def without_stopwords(normal: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.array_join(F.filter(split_words(normal), lambda w: ~w.isin(*stopwords)), " ")


def similarity_normal(text: str | Column) -> Column:
    """Lower case; everything but letters, digits and _ is a space."""
    return squeeze(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.struct(F.array_distinct(a).alias("x"), F.array_distinct(b).alias("y"))
    shared = lambda v: F.size(F.array_intersect(v["x"], v["y"]))
    ratio = lambda v: let(shared(v), lambda k: k / (F.size(v["x"]) + F.size(v["y"]) - k))
    return let(both, lambda v: F.when((F.size(v["x"]) == 0) | (F.size(v["y"]) == 0), F.lit(0.0)).otherwise(ratio(v)))


def reference_similarity(a: str | Column, b: str | Column) -> Column:
    words = lambda c: split_words(strict_normal(c))
    # equal texts are normalised once
    return F.when(_c(a) == _c(b), F.when(F.size(words(a)) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(jaccard(words(a), words(b)))


def fold_numerals(words: Column) -> Column:
    """Spelled numbers as digits: units, tens with a unit, and a scale after either.

    One pass that keeps the number being built: value, whether it may take a unit,
    and whether a scale may follow.
    """
    units, scales = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)]), F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, v)])
    none = F.lit(None).cast("decimal(38,0)")
    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("value"), F.lit(False).alias("tens"))

    def flush(s: Column) -> Column:
        return F.when(s["value"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["value"].cast("string")))

    def step(s: Column, w: Column) -> Column:
        digits = F.when(w.rlike("^[0-9]{1,30}$"), w.cast("decimal(38,0)"))
        unit = F.element_at(units, w).cast("decimal(38,0)")
        value = F.coalesce(unit, digits)
        scale = F.element_at(scales, w).cast("decimal(38,0)")
        joins_unit = s["tens"] & unit.between(1, 9)
        joins_scale = s["value"].isNotNull() & scale.isNotNull()
        tens = (value >= 20) & (value < 100) & (value % 10 == 0)
        keep = s["out"]
        return (
            F.when(joins_unit, F.struct(keep.alias("out"), (s["value"] + unit).cast("decimal(38,0)").alias("value"), F.lit(False).alias("tens")))
            .when(joins_scale, F.struct(F.array_append(keep, (s["value"] * scale).cast("decimal(38,0)").cast("string")).alias("out"), none.alias("value"), F.lit(False).alias("tens")))
            .when(value.isNotNull(), F.struct(flush(s).alias("out"), value.alias("value"), tens.alias("tens")))
            .otherwise(F.struct(F.array_append(flush(s), w).alias("out"), none.alias("value"), F.lit(False).alias("tens")))
        )

    return F.aggregate(words, start, step, flush)


def stem(word: Column) -> Column:
    """Strip one ASCII suffix, keeping three characters; the first that applies, in a fixed order."""
    n = F.length(word)

    def cut(suffix: str, keep: str = "") -> tuple[Column, Column]:
        return word.endswith(suffix) & (n - len(suffix) >= 3), F.concat(F.substring(word, F.lit(1), n - len(suffix)), F.lit(keep))

    out = F.when(~word.rlike(r"^[\x00-\x7f]*$") | word.rlike("^[0-9]+$") | (n <= 3), word)
    for suffix, keep in {"ies": "y", "ing": "", "edly": "", "ed": "", "es": ""}.items():
        out = out.when(*cut(suffix, keep))
    hit, value = cut("s")
    return out.when(hit & ~word.endswith("ss"), value).otherwise(word)


def graded_tokens(text: str | Column, stopwords: tuple[str, ...] = STOPWORDS, synonyms: dict[str, str] | None = None) -> Column:
    """Normalised, folded, stemmed and canonical tokens for graded fact matching."""
    t = F.replace(F.lower(_c(text)), F.lit("§"), F.lit(" section "))
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9])", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])rs(?:\.(?=[\p{L}\p{N}_])|(?![\p{L}\p{N}_]))", " rupees ")
    words = fold_numerals(split_words(F.regexp_replace(t, PUNCT_AND_PARENS, " ")))
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    same = _map(synonyms) if synonyms else None
    return F.transform(kept, lambda w: F.coalesce(F.element_at(same, stem(w)), stem(w)) if same is not None else stem(w))


def unit_vector(v: str | Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    c = _c(v)
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def hash_order(*parts: str | Column, seed: str = "") -> Column:
    """A key whose order is a seeded shuffle that every engine can repeat."""
    return F.sha2(F.concat(F.lit(seed), *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256)


def hash_fraction(*parts: str | Column, seed: str = "") -> Column:
    """A number in [0, 1) that follows from the parts."""
    return F.conv(F.substring(hash_order(*parts, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def percent(x: str | Column) -> Column:
    return F.format_string("%.1f%%", _c(x).cast("double") * 100)


def safe_name(x: str | Column) -> Column:
    return F.replace(_c(x), F.lit("/"), F.lit("__"))


def before_last(x: str | Column, mark: str) -> Column:
    """The part before the last ``mark``; all of it where there is none."""
    parts = F.split(_c(x), re.escape(mark))
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), mark)).otherwise(_c(x))
