"""Text as columns: keys, tokens, cleaners, bins. Built-in functions only, so Catalyst keeps them in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word.
TOKEN = r"[\p{L}\p{N}_]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def casefold(c: str | Column) -> Column:
    """Python's casefold for the scripts in use: lower case, and ß becomes ss."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def squash(c: str | Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def norm_key(c: str | Column) -> Column:
    """Key of the text up to case and white space."""
    return F.sha2(squash(casefold(c)), 256)


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(f"({TOKEN})"), F.lit(1))


def token_key(c: str | Column) -> Column:
    """Key of the text up to case, punctuation and white space."""
    return F.sha2(F.array_join(tokens(c), " "), 256)


def raw_key(c: str | Column) -> Column:
    return F.sha2(col(c), 256)


def salted(salt: str, c: str | Column) -> Column:
    """The deterministic random order of the package: SHA-256 of salt and id."""
    return F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256)


def pseudonym(salt: str, c: str | Column) -> Column:
    return F.substring(salted(salt, c), 1, 16)


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(\S+)"), F.lit(1))


def word_count(c: str | Column) -> Column:
    return F.size(words(c)).cast("long")


def length_bin(n: str | Column) -> Column:
    """Upper end of the length bin; null below 40 and above 640 words."""
    n = col(n)
    return F.when(n < 40, None).when(n <= 40, 40).when(n <= 80, 80).when(n <= 160, 160).when(n <= 320, 320).when(n <= 640, 640).cast("int")


# What counts as a link and as an e-mail address, and where sentences end.
PLAIN_LINK = r"https?://\S+"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SENTENCE_END = r"(?<=[.!?])\s+|\n\s*\n"


def redact(c: str | Column) -> Column:
    """Links become [URL], e-mail addresses [EMAIL]."""
    return F.regexp_replace(F.regexp_replace(col(c), PLAIN_LINK, "[URL]"), ADDRESS, "[EMAIL]")


def sentences(c: str | Column) -> Column:
    parts = F.split(col(c), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def word_prefix(c: str | Column, k: int) -> Column:
    """The first k words with their original white space between them."""
    return F.regexp_extract(col(c), rf"^\s*((?:\S+\s+){{0,{k - 1}}}\S+)", 1)


#: Fixed value: openings of a first line that announces the answer.
OPENINGS = r"^[*# ]*(?:Sure|Here|Abstract|Title|I'm happy to help|Certainly)"


def strip_preamble(c: str | Column) -> Column:
    """What follows the first closing think tag, without a first line that announces the answer if others follow; lower case, squashed."""
    c = col(c)
    after = F.when(F.contains(c, F.lit("</think>")), F.trim(F.split(c, "</think>", 2)[1])).otherwise(c)
    lines = F.filter(F.split(after, "\n"), lambda x: x.rlike(r"\S"))
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return squash(F.lower(F.when((F.size(lines) > 1) & lines[0].rlike(OPENINGS), rest).otherwise(after)))


#: Fixed value: section labels that an abstract loses (an introduction's label stays).
LABELS = "abstract|background|methods?|results?|conclusions?"


def drop_labels(c: str | Column) -> Column:
    """Without section labels, plain or bold, white space squashed, no spaces or hyphens at the ends."""
    plain = F.regexp_replace(col(c), rf"(?i)\*\*\s*(?:{LABELS})\s*\*\*\s*[:\-]?", "")
    return F.regexp_replace(squash(F.regexp_replace(plain, rf"(?i)\b(?:{LABELS})\s*:\s*", "")), r"^[ \-]+|[ \-]+$", "")


def clean_generated(c: str | Column) -> Column:
    """A generated abstract without its first title line and section labels."""
    text, line = F.trim(col(c)), r"(?im)^\s*(?:\*\*)?title\s*[:\-][^\n]*\n?"
    at, n = F.regexp_instr(text, F.lit(line)), F.length(F.regexp_extract(text, line, 0))
    return drop_labels(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + n, F.length(text)))).otherwise(text))


def split_fold_key(c: str | Column) -> Column:
    """Key of the text with white space squashed first and case folded then."""
    return F.sha2(casefold(squash(c)), 256)


def canonical_url(c: str | Column) -> Column:
    """https, lower-case host without www., no query, fragment or trailing slash."""
    host = F.regexp_replace(F.lower(F.regexp_extract(col(c), r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(col(c), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.concat(F.lit("https://"), host, path)


def trim_tail(c: str | Column, most: int = 300) -> Column:
    """A text that ends in no punctuation or closing quote loses what follows its last full stop, if that is at most `most` characters with the stop."""
    c = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    cut = F.regexp_extract(c, r"(?s)^(.*[.!?])", 1)
    return F.when(c.rlike('[.!?\u201d"]$'), c).when((F.length(cut) > 1) & (F.length(c) - F.length(cut) + 1 <= most), cut).otherwise(c)


def drop_heading(c: str | Column) -> Column:
    """Without a first line of at most 14 words and no terminal punctuation, if 250 words follow."""
    c = col(c)
    head, rest = F.split(c, "\n", 2)[0], F.get(F.split(c, "\n", 2), F.lit(1))
    return F.when((word_count(head) <= 14) & (word_count(rest) >= 250) & ~F.rtrim(head).rlike(r"[.!?]$"), rest).otherwise(c)


def footer_strip(c: str | Column, pattern: str, least_words: int = 450) -> Column:
    """Lines from the first that matches pattern on are cut, if least_words words remain before it."""
    lines = F.split(col(c), "\n")
    flags = F.transform(lines, lambda x: x.rlike(pattern))
    at = F.array_position(flags, True)
    kept = F.array_join(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), "\n")
    return F.when((at > 0) & (word_count(kept) >= least_words), kept).otherwise(col(c))


def boilerplate_votes(c: str | Column, phrases: list[str], within: int = 1800) -> Column:
    head = F.lower(F.substring(col(c), 1, within))
    out = F.lit(0)
    for p in phrases:
        out = out + F.when(F.instr(head, p) > 0, 1).otherwise(0)
    return out.cast("int")


def first_family(c: str | Column, table: list[tuple[str, str]], default: str = "other") -> Column:
    """Name of the first prefix in `table` that c starts with."""
    out = F.when(F.lit(False), F.lit(""))
    for prefix, name in table:
        out = out.when(F.lower(col(c)).startswith(prefix), name)
    return out.otherwise(default)


# What the vocabulary model's tokenizer takes for a link, a tag, a word and a numbered advisory.
LINK = r"https?://[^\s<>\"'`)\]}]+"
TAG = "<[a-z/!][^<>]*>"
VOCABULARY_WORD = "[a-z0-9_/-]*[a-z][a-z0-9_/-]*"
ADVISORY = r"^snyk-.+-\d{4,}$"


def vocabulary_tokens(c: str | Column) -> Column:
    """Links as [name-url] by the label before the last of their host, then dashes, then the words of the rest without tags; ids of advisories are masked."""
    t = F.lower(col(c))

    def link(u: Column) -> Column:
        host = F.split(F.element_at(F.split(F.split(F.split(u, "//", 2)[1], "/", 2)[0], "@"), -1), ":")[0]
        labels = F.filter(F.split(host, r"\."), lambda x: (x != "") & (x != "www"))
        name = F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).when(F.size(labels) == 1, F.try_element_at(labels, F.lit(1))).otherwise("link")
        return F.concat(F.lit("["), name, F.lit("-url]"))

    links = F.transform(F.regexp_extract_all(t, F.lit(f"({LINK})"), F.lit(1)), link)
    dashes = F.array_repeat(F.lit("—"), F.regexp_count(t, F.lit("—")).cast("int"))
    rest = F.regexp_replace(F.regexp_replace(t, LINK, " "), TAG, " ")
    found = F.transform(F.regexp_extract_all(rest, F.lit(f"({VOCABULARY_WORD})"), F.lit(1)), lambda w: F.regexp_replace(F.regexp_replace(w, "^[_/]+|[_/]+$", ""), "-+$", ""))
    masked = F.transform(F.filter(found, lambda w: w != ""), lambda w: F.when(w.rlike(ADVISORY), F.lit("[snyk-id]")).otherwise(w))
    return F.concat(links, dashes, masked)


def shingles(words_col: Column, width: int) -> Column:
    """MD5 of each run of `width` words; none for shorter texts."""
    n = F.size(words_col)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.md5(F.array_join(F.slice(words_col, i, F.lit(width)), " ")))).otherwise(F.array().cast("array<string>"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval for k of n."""
    n, k = n.cast("double"), k.cast("double")
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
