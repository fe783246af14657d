"""Column functions on text. Word characters are letters, numbers and the underscore in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
S, NS = f"[{SPACE}]", f"[^{SPACE}]"
#: Links, as the lower-casing cleaners know them, and as those that keep case do.
URL = f"http{NS}+|www{NS}+"
LINK = rf"https?://{NS}+|www\.{NS}+"
#: Stop words of this package, used by the engine and its oracles.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had "
    "has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such "
    "than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()
#: Code point ranges of script classes 1 to 6.
SCRIPTS = {
    1: r"\x{0400}-\x{04FF}",
    2: r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}",
    3: r"\x{0600}-\x{06FF}",
    4: r"\x{0590}-\x{05FF}",
    5: r"\x{0E00}-\x{0E7F}",
    6: r"\x{0900}-\x{097F}",
}


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def squeeze(text: Column) -> Column:
    return _sub(_sub(text, f"{S}+", " "), "^ | $", "")


def clean_joined(text: Column, to: str = "") -> Column:
    """Lower case without links, mentions, hash signs and punctuation; what goes is replaced by `to`."""
    x = _sub(F.lower(F.coalesce(text, F.lit(""))), URL, to)
    x = _sub(_sub(x, f"@{W}+", to), f"#({W}+)", "$1")
    return squeeze(_sub(x, rf"[^\p{{L}}\p{{N}}_{SPACE}]", to))


def clean_spaced(text: Column) -> Column:
    return clean_joined(text, " ")


def clean_title(text: Column) -> Column:
    """Case kept; links, retweet marks, mentions and hash signs go, joined capitals are split, long repeats cut to two."""
    x = _sub(F.coalesce(text, F.lit("")), LINK, " ")
    x = _sub(x, f"(?i)^rt{S}+", "")
    x = _sub(_sub(x, f"@{W}+", " "), f"#({W}+)", "$1")
    x = _sub(x, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.substring(squeeze(_sub(x, r"(?d)(.)\1{2,}", "$1$1")), 1, 4000)


def clean_post(text: Column, keep_case: bool = True) -> Column:
    """As clean_title, also without character entities and ASCII punctuation."""
    x = _sub(F.coalesce(text, F.lit("")), LINK, " ")
    x = _sub(x, f"(?i)^rt{S}+", "")
    x = _sub(_sub(x, f"@{W}+", " "), f"#({W}+)", "$1")
    x = _sub(x, "(?<=[a-z0-9])(?=[A-Z])", " ")
    x = _sub(_sub(x, f"&{W}+;", " "), r"(?d)(.)\1{2,}", "$1$1")
    x = _sub(x, r"[!-/:-@\[-`{-~]", " ")
    return F.substring(squeeze(x if keep_case else F.lower(x)), 1, 4000)


def clean_hash(text: Column) -> Column:
    """For hashed features: lower case, without links, mentions and entities; word characters and CJK stay; cut at 1000."""
    x = _sub(F.coalesce(text, F.lit("")), LINK, " ")
    x = F.lower(_sub(x, f"@{W}+", " "))
    x = _sub(_sub(x, f"&{W}+;", " "), rf"[^\p{{L}}\p{{N}}_{SPACE}\x{{4E00}}-\x{{9FFF}}]", " ")
    return F.substring(squeeze(x), 1, 1000)


def analyzer_tokens(text: Column) -> Column:
    """Words of two characters and more of lower-cased text, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({W}{{2,}})"), 1)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def word_tokens(text: Column) -> Column:
    """Words that start with a letter, longer than two, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}[\p{L}\p{N}_'-]*)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def digest(*parts: Column) -> Column:
    """32 bits of a hash that every SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def with_bigrams(words: Column) -> Column:
    """words: a column of a table, not an expression, which would be worked out once for each mention."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams inside words that are padded with one space on each side."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, n))
        return F.when(F.length(w) >= n, cut).otherwise(F.array().cast("array<string>"))

    def short(w: Column) -> Column:
        """A padded word shorter than `low` counts once, whole."""
        return F.when(F.length(w) < low, F.array(w)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(short(w), *(grams(w, n) for n in range(low, high + 1)))))


def script_id(text: Column) -> Column:
    """The script class with most code points if they are an eighth of the text at least, else 0; lower classes win ties."""
    counts = {k: F.regexp_count(text, F.lit(f"[{r}]")) for k, r in SCRIPTS.items()}
    most = F.greatest(*counts.values())
    found = F.coalesce(*(F.when(c == most, k) for k, c in counts.items()))
    return F.when((most > 0) & (most * 8 >= F.length(text)), found).otherwise(0)


def prefix_key(text: Column, n: int = 14, least: int = 25) -> Column:
    """The first n words as a key; null if shorter than `least` characters."""
    key = F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")
    return F.when(F.length(key) >= least, key)
