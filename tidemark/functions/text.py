"""Column functions over text: tokens, identifiers, suffix stems, n-grams, markers, masks. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop-word lists and query patterns that results depend on.
STOP_WORDS = (
    "and or the a an in to of for with on at by from is it this that how where what does are which when why do can will be has have "
    "been being was were would could should may might must shall into through during before after above below between under over out off "
    "down up all each every both few more most other some such only own same than too very just also any"
).split()
SHORT_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
CONTENT_TYPES = {"video/mp4": ".mp4", "video/quicktime": ".mov", "video/x-matroska": ".mkv", "video/webm": ".webm", "video/x-msvideo": ".avi"}
CTX_START, CTX_END = "[CTX_START]", "[CTX_END]"


def raw_words(text: Column) -> Column:
    """What `tokens` chooses from: words of ASCII letters and digits, camel case and underscores split, lower case; at least one, which may be empty."""
    spaced = F.regexp_replace(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"), "_", " "), "[^a-zA-Z0-9]", " ")
    return F.split(F.lower(spaced), " +")


def is_token(word: Column, stop_words: list[str] = STOP_WORDS, min_chars: int = 3) -> Column:
    # the optimizer makes a hash set of the list
    return (F.length(word) >= min_chars) & ~word.isin(stop_words) if stop_words else F.length(word) >= min_chars


def tokens(text: Column, stop_words: list[str] = STOP_WORDS, min_chars: int = 3) -> Column:
    """The words of `raw_words` that are long enough and no stop words; order and repeats kept."""
    return F.filter(raw_words(text), lambda t: is_token(t, stop_words, min_chars))


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier, also at acronym ends, hyphens and dots; single characters are left out."""
    s = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.translate(s, "_-.", "   ")), "\\s+"), lambda w: F.length(w) > 1)


def word_runs(line: Column) -> Column:
    """Lower-case runs of ASCII word characters."""
    return F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9_]+"), 0)


def suffix_stem(word: Column, rules: str = "plain") -> Column:
    """First matching suffix rule: ies to y, es, s (not ss), ing, ed; ``tion`` adds -tion, ``e`` adds -tion and a final e of words above three letters."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    out = F.when(word.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(word.endswith("es"), cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1))
    out = out.when(word.endswith("ing"), cut(3)).when(word.endswith("ed"), cut(2))
    if rules in ("tion", "e"):
        out = out.when(word.endswith("tion"), cut(4))
    if rules == "e":
        out = out.when(word.endswith("e") & (n > 3), cut(1))
    return out.otherwise(word)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by underscores."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), "_")))


def gram_rows(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """(keep, n, gram): a row for each run of two and of three words, joined by underscores; compiled, where `ngrams` is interpreted word by word."""
    shifted = df.select(*keep, F.col(words).alias("tm_a")).where(F.size("tm_a") >= 2)
    shifted = shifted.select(*keep, F.explode(F.arrays_zip("tm_a", F.slice("tm_a", F.lit(2), F.size("tm_a")).alias("tm_b"), F.slice("tm_a", F.lit(3), F.size("tm_a")).alias("tm_c"))).alias("tm_z"))
    two = F.concat_ws("_", "tm_z.tm_a", "tm_z.tm_b")
    both = F.array(F.struct(F.lit(2).alias("n"), F.when(F.col("tm_z.tm_b").isNotNull(), two).alias("gram")), F.struct(F.lit(3).alias("n"), F.when(F.col("tm_z.tm_c").isNotNull(), F.concat_ws("_", two, "tm_z.tm_c")).alias("gram")))
    return shifted.select(*keep, F.inline(both)).where("gram is not null")


def clean_text(text: Column) -> Column:
    """Without show-more labels, white space collapsed, empty to null."""
    s = F.regexp_replace(F.regexp_replace(text, "(?i)see more|show less", ""), "[\\s\\u00A0]+", " ")
    return F.nullif(F.trim(s), F.lit(""))


def truncated(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def query_before_marker(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit(CTX_START), F.lit(1)))


def context_in_markers(text: Column) -> Column:
    return F.trim(F.split_part(F.split_part(text, F.lit(CTX_START), F.lit(2)), F.lit(CTX_END), F.lit(1)))


def has_secret_value(line: Column) -> Column:
    """A KEY=value line with a value that is not a comment."""
    return ~F.startswith(F.trim(line), F.lit("#")) & F.contains(line, F.lit("=")) & (F.length(F.trim(F.substr(line, F.instr(line, "=") + 1))) > 0)


def masked(line: Column) -> Column:
    return F.when(has_secret_value(line), F.concat(F.substring_index(line, "=", 1), F.lit("=***"))).otherwise(line)


def extension_of(content_type: Column) -> Column:
    """File extension of a content type, parameters ignored; null if it is not known."""
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.try_element_at(kinds, F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def file_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")


def slug_title(slug: Column) -> Column:
    """Words of a slug with capital first letters, the rest as it is."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def overlap_lines(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Lines two ranges share; null if a bound is (least and greatest skip nulls)."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1))


def score_rounded(score: Column, digits: int = 2) -> Column:
    return F.round(score, digits)


def size_kb(n_bytes: Column) -> Column:
    return F.round(n_bytes / 1024, 1)


# The patterns that validators accept. \p{Z} and U+FEFF complete the white space.
EMAIL = r"^[^\s\x0B\p{Z}\x{FEFF}@]+@[^\s\x0B\p{Z}\x{FEFF}@]+\.[^\s\x0B\p{Z}\x{FEFF}@]+\z"
USER_NAME = r"^[a-zA-Z0-9_]{3,20}\z"
PASSWORD = [r"^[^\n\r\x{2028}\x{2029}]{8,}\z", "[a-z]", "[A-Z]", "[0-9]"]
HTML_ESCAPES = [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
RETRY_STATUS, RETRY_CODES = [408, 429, 500, 502, 503, 504], ["ECONNRESET", "ETIMEDOUT"]


def valid_email(text: Column) -> Column:
    return F.rlike(text, F.lit(EMAIL))


def valid_user_name(text: Column) -> Column:
    return F.rlike(text, F.lit(USER_NAME))


def valid_password(text: Column) -> Column:
    """Eight code points or more on one line, with a lower-case letter, an upper-case one and a digit."""
    out = F.lit(True)
    for pattern in PASSWORD:
        out = out & F.rlike(text, F.lit(pattern))
    return out


def html_escaped(text: Column) -> Column:
    """Angle brackets and quotes as references; an ampersand stays."""
    for plain, reference in HTML_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def retryable(status: Column, code: Column) -> Column:
    """A status or an error code after which a call is worth another try; nulls are not."""
    return F.coalesce(status.isin(RETRY_STATUS), F.lit(False)) | F.coalesce(code.isin(RETRY_CODES), F.lit(False))
