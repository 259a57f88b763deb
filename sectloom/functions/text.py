"""Text rules as column expressions: tokenizers, headings, cleaning, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English stopwords (the common public list) and extra words that carry no topic
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were "
    "be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn also may one two would could many much must back years way well down"
).split()

YEAR = "^(1[5-9][0-9]{2}|20[0-9]{2})$"
DECADE = "^(1[5-9][0-9]|20[0-9])0s$"


def tokenize(text: Column, stop: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Index and query tokens: lower-case runs of a-z and 0-9; a year from 1500 to 2099 becomes its decade;
    stopwords and words of up to two characters are dropped. Null text gives null."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: F.when(w.rlike(YEAR), F.concat(F.substring(w, 1, 3), F.lit("0s"))).otherwise(w))
    return F.filter(words, lambda w: w.rlike(DECADE) | ((F.length(w) > 2) & ~w.isin(list(stop))))


def gram_tokens(text: Column) -> Column:
    """Tokens that keep inner divisors, in canonical form: divisors vanish inside tokens with a digit
    (ABC-123 and abc123 are one), and stand as an apostrophe in words with one."""
    t = F.lower(F.translate(text, "’‘“”—– ", "''\"\"   "))
    found = F.regexp_extract_all(t, F.lit("([a-z0-9]+(?:[-_/.'][a-z0-9]+)*)"), 1)
    sep = "[-_/.'\\s]+"
    return F.transform(found, lambda w: F.when(w.rlike("[0-9]"), F.regexp_replace(w, sep, "")).when(w.contains("'"), F.regexp_replace(w, sep, "'")).otherwise(w))


def relation_tokens(text: Column) -> Column:
    """Words in order with case kept; a possessive 's stands alone."""
    return F.regexp_extract_all(F.regexp_replace(text, "['’]s\\b", " 's"), F.lit("('s|[A-Za-z0-9]+)"), 1)


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs between blank lines."""
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n"), lambda p: F.trim(p)), lambda p: p != "")


# fixed value: titles of reference lists, after numbering
REFERENCE = "(?i)^\\W*(?:[0-9ivx]+[.):]?\\s+|appendix\\s+\\w+[.:]?\\s+)?(?:selected\\s+|cited\\s+)?(?:references?(?:\\s+(?:list|cited|and\\s+notes))?|bibliography|works\\s+cited|literature\\s+cited|citations?|notes\\s+and\\s+references)\\W*$"


def is_reference(title: Column) -> Column:
    """True if a section title is a references phrase, numbering aside."""
    t = F.trim(F.regexp_replace(title, "^\\s*#{1,6}\\s+", ""))
    return F.coalesce(t.rlike(REFERENCE), F.lit(False))


def is_junk(text: Column) -> Column:
    """Debris: the marker latexi, no word character at all, or at least eight lettered lines of which nine in ten have up to two word characters."""
    n = F.filter(F.transform(F.split(text, "\\n"), lambda ln: F.length(F.regexp_replace(ln, "[^A-Za-z0-9_]", ""))), lambda k: k > 0)
    short = F.size(F.filter(n, lambda k: k <= 2))
    return text.contains("latexi") | (F.size(n) == 0) | ((F.size(n) >= 8) & (short >= 0.9 * F.size(n)))


def glyph_share(text: Column) -> Column:
    """Share of the characters other than white space that sit in font-glyph codes."""
    whole = F.length(F.regexp_replace(text, "\\s+", ""))
    rest = F.length(F.regexp_replace(F.regexp_replace(text, "(?i)glyph\\s*(?:<[^>]*>|&lt;.*?&gt;|\\[[^\\]]*\\])", ""), "\\s+", ""))
    return F.when(whole > 0, (whole - rest) / whole).otherwise(F.lit(0.0))


def heading_kind(title: Column) -> Column:
    """A heading without numbering and punctuation, in lower case."""
    x = F.regexp_replace(title, "^\\s*(?:[A-Za-z]\\.|\\d+(?:\\.\\d+)*\\.?|[IVX]+\\.)?\\s*", "")
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z ]", ""))


def index_text(text: Column) -> Column:
    """A section's text without the heading line it begins with."""
    return F.when(text.rlike("^[ \\t]*#[^\\n]*\\n"), F.regexp_replace(text, "^[ \\t]*#[^\\n]*\\n+", "")).otherwise(text)


def clean_lines(text: Column) -> Column:
    """Text without NULs, lines of inline image data and image placeholders."""
    lines = F.filter(F.split(F.translate(text, "\u0000", ""), "\\n"), lambda ln: ~ln.contains("data:image/") & ~F.trim(ln).rlike("^(<image>|!\\[[^\\]]*\\]\\([^)]*\\))$"))
    return F.array_join(lines, "\n")


def clip(text: Column, n: int) -> Column:
    """At most n characters, cut at a word end, with an ellipsis if anything is cut."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(head, "\\s+\\S*\\z", ""), F.lit("…")))


def bold_terms(text: Column, terms: list[str]) -> Column:
    """Known terms in bold, longer ones first."""
    alt = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)\\b({alt})\\b", "**$1**") if terms else text


def drop_term(text: Column, term: str) -> Column:
    """Text without a term as a whole word, in any case."""
    return F.regexp_replace(text, f"(?i)\\b{term}\\b", "")


def tidy(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def wiki_title(page: Column) -> Column:
    """The title between the first equals signs of a wikitext page, if the page begins with one."""
    t = F.trim(F.regexp_extract(F.substring(F.ltrim(page), 1, 200), "^=\\s*([^=]+)=", 1))
    return F.when(t != "", t)


# fixed value: stems of paper files, as id, version and methods extract
STEM = "^(\\d{4}_\\d{4,5}|[a-z\\-]+(?:\\.[A-Z]{2})?_\\d{7})(?:v(\\d+))?(_methods)?$"


def stem_key(stem: Column) -> Column:
    """Key of a file stem: the paper id without its version, a methods extract apart; other stems are their own key."""
    return F.when(stem.rlike(STEM), F.concat(F.regexp_extract(stem, STEM, 1), F.regexp_extract(stem, STEM, 3))).otherwise(stem)


def stem_version(stem: Column) -> Column:
    """Version of a file stem; 1 if it names none."""
    v = F.regexp_extract(stem, STEM, 2)
    return F.when(stem.rlike(STEM) & (v != ""), v.cast("int")).otherwise(F.lit(1))


def paper_id(doc_id: Column) -> Column:
    """A document id without its version."""
    return F.regexp_replace(doc_id, "v\\d+$", "")


def toon(value: Column) -> Column:
    """A scalar of a compact table format, quoted only where the format needs it."""
    need = (value == "") | (value != F.trim(value)) | value.isin("true", "false", "null") | value.rlike("^-?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$") | value.rlike("[:\",\\\\\\[\\]{}\\x00-\\x1f]") | value.startswith("-") | value.startswith("#")
    esc = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.when(need, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(value)
