"""Text functions as Spark columns: they stay in the JVM.

Null texts give null; empty texts give empty arrays or strings, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a character class that Java and RE2 read alike.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: Words without content.
STOP_WORDS = (
    "the", "and", "that", "with", "from", "this", "for", "are", "was", "were", "has", "had", "have", "its", "his", "her", "their", "they", "them", "over", "into",
    "about", "also", "but", "not", "who", "which", "been", "than", "then", "there", "these", "those",
)


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(t: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c(t), rf"\A{WS}+|{WS}+\z", "")


def words_of(t: Column | str) -> Column:
    """The parts between white space."""
    return F.filter(F.split(c(t), f"{WS}+"), lambda w: w != "")


def word_count(t: Column | str) -> Column:
    return F.size(words_of(t))


def sentence_pieces(t: Column | str) -> Column:
    """The text cut behind '.', '!' and '?' where white space or the end follows; the pieces join to the text again."""
    return F.split(c(t), rf"(?<=[.!?])(?={WS}|\z)")


def sentences(t: Column | str) -> Column:
    """Trimmed, non-empty sentences. Abbreviations end a sentence; a mark inside a word or before a quotation mark does not."""
    return F.filter(F.transform(sentence_pieces(t), trim_ws), lambda s: s != "")


def alnum_words(t: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c(t)), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def is_number(w: Column) -> Column:
    return w.rlike("[0-9]")


def content_words(t: Column | str) -> Column:
    """The set of words of at least three characters or with a digit that are not stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(alnum_words(t), lambda w: ((F.char_length(w) >= 3) | is_number(w)) & ~w.isin(*STOP_WORDS))))


def numbers(t: Column | str) -> Column:
    """The content words that hold a digit."""
    return F.filter(content_words(t), is_number)


_QUOTED = r'"[^"]*("|\z)|“[^”]*(”|\z)'


def quotations(t: Column | str, least: int = 3) -> Column:
    """Spans of at least ``least`` words between straight or curly double marks, without the marks; an opening mark that is never closed swallows the rest."""
    found = F.regexp_extract_all(c(t), F.lit(_QUOTED), F.lit(0))
    closed = F.filter(found, lambda q: (F.char_length(q) > 1) & ((q.startswith('"') & q.endswith('"')) | (q.startswith("“") & q.endswith("”"))))
    inner = F.transform(closed, lambda q: F.substring(q, F.lit(2), F.char_length(q) - 2))
    return F.filter(inner, lambda q: word_count(q) >= least)


def stray_mark(t: Column | str) -> Column:
    """Whether a double quotation mark is left when all pairs are taken away."""
    return F.regexp_replace(c(t), r'"[^"]*"|“[^”]*”', "").rlike('["“”]')


def stray_mark_place(t: Column | str) -> Column:
    """The byte place of the first double quotation mark that no other closes or opens; null where there is none."""
    whole = F.regexp_extract(c(t), r'\A(?:[^"“”]++|"[^"]*+"|“[^”]*+”)*+', 0)
    return F.when(F.char_length(whole) < F.char_length(c(t)), F.octet_length(whole))


def normalise_claim(t: Column | str) -> Column:
    """What makes two wordings the same claim: white space collapsed, lower case."""
    return F.lower(trim_ws(F.regexp_replace(c(t), f"{WS}+", " ")))


def echo(t: Column | str, n: int = 80) -> Column:
    """At most ``n`` characters, with an ellipsis where cut."""
    return F.when(F.char_length(c(t)) > n, F.concat(F.left(c(t), F.lit(n)), F.lit("…"))).otherwise(c(t))


def names_prefix(title: Column | str, headings: Column | str) -> Column:
    """Title and headings, blank ones left out, each ended with one mark, joined with spaces and a space after; empty where there are none."""
    named = F.filter(F.transform(F.concat(F.array(c(title)), F.coalesce(c(headings), F.array().cast("array<string>"))), trim_ws), lambda n: n.isNotNull() & (n != ""))
    ended = F.transform(named, lambda n: F.when(n.rlike(r"[.!?]\z"), n).otherwise(F.concat(n, F.lit("."))))
    return F.when(F.size(ended) > 0, F.concat(F.array_join(ended, " "), F.lit(" "))).otherwise(F.lit(""))


def estimate_secs(t: Column | str, words_per_minute: int = 150) -> Column:
    return word_count(t) * F.lit(60.0) / words_per_minute


def strip_marks(t: Column | str) -> Column:
    """Without double quotation marks."""
    return F.translate(c(t), '"“”', "")


def normalise_text(t: Column | str) -> Column:
    """Byte order marks at the start and carriage returns taken away."""
    return F.replace(F.replace(F.regexp_replace(c(t), r"\A\x{FEFF}+", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def byte_slice(t: Column | str, start: Column, stop: Column) -> Column:
    """The text between two byte places; null where they are out of bounds or inside a character."""
    raw = F.encode(c(t), "utf-8")
    cut = raw.substr(start.cast("int") + 1, (stop - start).cast("int"))
    ok = (start >= 0) & (stop >= start) & (stop <= F.octet_length(raw)) & F.is_valid_utf8(cut)
    return F.when(ok, F.decode(cut, "utf-8"))


def fold_group(g: Column | str) -> Column:
    """A source group in one spelling: lower case, underscores as dashes; null stays null."""
    return F.replace(F.lower(trim_ws(g)), F.lit("_"), F.lit("-"))
