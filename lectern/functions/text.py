"""Column functions on texts: normalisation, counts, titles, names, labels, citations and quotations."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of apostrophe, small words of titles, junk titles and authors, markers of citations.
APOSTROPHES = "‘’‚‛′`"
SMALL_WORDS = "a an and as at by for from in of on or the to with".split()
JUNK_TITLE = r"(?i)^(untitled|microsoft word|document\d*|title|none|null)\b|\.(docx?|pdf|indd|tex|dvi|rtf|odt|qxd|p65)$"
JUNK_AUTHOR = r"(?i)^(user|admin|administrator|owner|unknown|author|anonymous|none|null|\d+)$"
CITATION_GROUP = r"\[((?:P\d+)(?:\s*[,;]\s*P\d+)*)\]"
PAGE_MENTION = r"(?i)\b(?:pp?\.|pages?)\s*[\divxlc]+(?:\s*[–-]\s*[\divxlc]+)?\b"
QUOTATION = r'[“"]([^“”"]{12,}?)[”"]'
CRUMB = " › "
#: Abbreviations that a name, a number or a reference follows.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Rev Hon Gov Sen Gen Col Capt Lt Sgt Mme Mlle Messrs Mt Fr Sr vs cf ca No Nos Vol Vols Ch Fig Figs pp e.g i.e viz".split()
#: Closing marks after a terminator; a full stop needs white space after it, other terminators of scripts without spaces don't.
CLOSING = "[\"'”’»)\\]」』）】]*"
STOP = rf"([.!?؟।]+{CLOSING}\s+|[。！？｡]+{CLOSING}\s*)"
GOES_ON = r"^[,:;–—，、：；-]"
LOWER_NEXT = r"^[^\p{L}.!?。！？؟।]*\p{Ll}"
FULL_STOP = rf"\.{CLOSING}$"
NAMED_NEXT = r"(?:^|[\s(\"'“‘«\[])(?:\p{Lu}|" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$"


def plain_spaces(c: Column) -> Column:
    """Exotic Unicode spaces as ordinary ones, so that every engine's ``\\s`` agrees afterwards."""
    return F.regexp_replace(c, r"[   -   　﻿]", " ")


@functools.cache
def _folds() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and marks, and these bases (Latin blocks, by rule)."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def fold_accents(c: Column) -> Column:
    source, target = _folds()
    return F.regexp_replace(F.translate(c, source, target), r"[̀-ͯ]", "")


def normalize_for_match(c: Column) -> Column:
    """Lower case, no accents, hyphenated line breaks rejoined, all but letters and digits as single spaces."""
    c = fold_accents(F.lower(c))
    c = F.translate(c, APOSTROPHES, "'" * len(APOSTROPHES))
    c = F.regexp_replace(c, r"(\p{L})-\s+(\p{L})", "$1$2")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def lead_excerpt(c: Column, words: int = 45) -> Column:
    """The first words, with " …" if there are more; a short text is itself."""
    parts = F.split(c, r"\s+")
    return F.when(F.size(parts) <= words, c).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(" …")))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def tidy_title(c: Column) -> Column:
    """One space between words, no final "." or ":", and all-capital titles in title case (not roman numerals)."""
    t = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "[.:]+$", "")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    shouting = (F.length(letters) > 3) & (letters == F.upper(letters)) & ~letters.rlike("^[IVXLCDM]+$")
    words = F.transform(F.split(F.lower(t), " "), lambda w, i: F.when(w.rlike("^[ivxlcdm]+[.,]?$"), F.upper(w)).when((i > 0) & w.isin(SMALL_WORDS), w).otherwise(capitalized(w)))
    return F.when(shouting, F.array_join(words, " ")).otherwise(t)


def metadata_from_file_name(c: Column) -> Column:
    """struct(title, author) from names like "Title by Author.pdf" or "hyphenated-title.pdf"."""
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"(.)\.[^.]*$", "$1"), r"[_\s]+", " "))
    by = r"(?i)^(.+?)\s+by\s+(.+)$"
    slug = base.rlike("[a-z]-[a-z]") & ~base.contains(" ")
    pretty = F.when(slug, F.replace(base, F.lit("-"), F.lit(" "))).otherwise(base)
    return F.struct(
        F.when(base.rlike(by), F.trim(F.regexp_extract(base, by, 1))).otherwise(capitalized(pretty)).alias("title"),
        F.when(base.rlike(by), F.trim(F.regexp_extract(base, by, 2))).alias("author"))


def embedding_text(title: Column, author: Column, chapter: Column, text: Column) -> Column:
    """"author, title — last chapter part", an empty line, the text; missing parts are left out."""
    none = lambda c: F.when(c != "", c)
    head = F.concat_ws(", ", none(author), none(title))
    leaf = F.element_at(F.split(none(chapter), CRUMB), -1)
    return F.concat(head, F.coalesce(F.concat(F.lit(" — "), none(leaf)), F.lit("")), F.lit("\n\n"), text)


def page_label(start: Column, end: Column, label_start: Column, label_end: Column) -> Column:
    a, b = F.coalesce(label_start, start.cast("string")), F.coalesce(label_end, end.cast("string"))
    return F.when(a == b, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("–"), b))


def chapter_leaf(c: Column) -> Column:
    """The last part of a chapter path, with its parent when it is six characters or less."""
    parts = F.split(F.when(c != "", c), CRUMB)
    leaf = F.element_at(parts, -1)
    return F.when((F.size(parts) > 1) & (F.length(leaf) <= 6), F.concat(F.get(parts, F.size(parts) - 2), F.lit(" · "), leaf)).otherwise(leaf)


def short_title(c: Column, longest: int = 34) -> Column:
    t = F.trim(F.get(F.split(c, "[:;—]"), F.lit(0)))
    t = capitalized(F.regexp_replace(t, r"(?i)^(a selection from|selections from|the complete|the collected)\s+(the\s+)?", ""))
    return F.when(F.length(t) > longest, F.concat(F.regexp_replace(F.substring(t, 1, longest), r"\s+\S*$", ""), F.lit("…"))).otherwise(t)


def extract_citations(c: Column) -> Column:
    """Passage ids of [P1], [P2, P3] and [P2; P3], in order."""
    groups = F.regexp_extract_all(c, F.lit(CITATION_GROUP), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*")))


def page_mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PAGE_MENTION), F.lit(0))


def extract_quotes(c: Column) -> Column:
    """Quoted spans of at least 12 characters and four words."""
    quotes = F.transform(F.regexp_extract_all(c, F.lit(QUOTATION), F.lit(1)), lambda q: F.trim(q))
    return F.filter(quotes, lambda q: F.size(F.split(q, r"\s+")) >= 4)


def link_citations(c: Column) -> Column:
    """Each cited id as a link of its own: [P1, P2] -> [P1](cite:P1)[P2](cite:P2)."""
    marked = F.regexp_replace(c, CITATION_GROUP, "\u0001$1\u0002")
    each = F.transform(F.split(marked, "[\u0001\u0002]"), lambda part, i: F.when(i % 2 == 1, F.regexp_replace(F.regexp_replace(part, r"\s*[,;]\s*", ""), r"(P\d+)", "[$1](cite:$1)")).otherwise(part))
    return F.array_join(each, "")


def quote_fragments(quote: Column) -> Column:
    """The normalised parts of a quotation between ellipses and [edits], those of two words and more."""
    parts = F.split(F.regexp_replace(quote, r"\[[^\]]*\]", "…"), r"\s*(?:\.\s?\.\s?\.|…)\s*")
    return F.filter(F.transform(parts, normalize_for_match), lambda f: F.size(F.split(f, " ")) >= 2)


def sentences(text: Column) -> Column:
    """A paragraph's sentences, after Unicode's rules for sentence boundaries (UAX 29), tailored by abbreviations and initials.

    A boundary may be after a run of terminators with its closing marks and white space (none is needed after an ideographic one). It is none where a comma, colon, semicolon
    or dash follows; nor, after a full stop, where the next letter is lower-case, or after an abbreviation that goes before a name or a single
    capital. Without white space a full stop ends nothing, so numbers and initials stay whole.
    """
    def ends(parts: Column) -> Column:
        def between(part: Column, i: Column) -> Column:
            after, bare = F.coalesce(F.get(parts, i + 1), F.lit("")), F.rtrim(F.translate(part, "\t\n\f\r", "    "))
            goes_on = after.rlike(GOES_ON) | (bare.rlike(FULL_STOP) & (after.rlike(LOWER_NEXT) | bare.rlike(NAMED_NEXT)))
            return F.concat(part, F.when(goes_on, "").otherwise("\u0001"))

        return F.split(F.array_join(F.transform(parts, between), ""), "\u0001")

    # the array of parts is named once for each of its uses, so it is bound first
    found = F.get(F.transform(F.array(F.split(F.regexp_replace(text, STOP, "$1\u0002"), "\u0002")), ends), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
