"""Noise in text from scanned pages: broken words, misread letters, running headers and page numbers."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut, size_bound

# fixed values: how scanned letters are misread, as (read, really)
LETTERS = [("c", "e"), ("f", "t"), ("b", "h"), ("ri", "n"), ("cl", "d"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("d", "cl"), ("h", "b"), ("e", "c"), ("tn", "m")]
SIGNS = [("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("@", "a"), ("|", "l"), ("|", "i"), ("!", "i"), ("8", "b"), ("6", "b"), ("6", "g"), ("9", "g"), ("3", "e"), ("$", "s"), ("€", "e"), ("7", "t"), ("4", "a"), ("2", "z")]
#: Misreadings of one kind in a word that a hash difference is made for.
TIMES = 4
#: A misread word of letters is at most this share of its right form, and the form at least this frequent; for signs in a word any form that occurs twice will do.
RARE_SHARE, FREQUENT, MIN_LETTERS = 0.05, 15, 3
#: Corrections are broadcast up to this number of rows; with more the operator stops with an error.
MAX_BROADCAST = 3_000_000

WORD = re.compile(r"[@|!$€]?[^\W_]+(?:[@|!$€]+[^\W_]+)*[@|]?")
SIGN = re.compile(r"[0-9@|!$€]")
#: Any sign of hyphenation before a line end; furniture may stand between the parts of the word.
_BREAK = re.compile(r"([^\W\d_]+)([-‐‑¬\xad])[ \t]*\n((?:[ \t]*[^\n]*\n){0,4}?)[ \t]*([^\W\d_]+)")
_BROKEN_END = re.compile(r"[-‐‑¬\xad][ \t]*\n")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_PLAIN = re.compile(r"[^\W_]+")
_MISREAD = re.compile(r"[@|!$€]")
_SPACED = re.compile(r"(?<![\w@|!$€'’-])(?:[^\W\d_] ){3,}[^\W\d_](?![\w'’-])")

# fixed values: shapes of page numbers and running headers, each a whole line
_PAGE = re.compile(r"\s*(?:\[\s*\d{1,4}\s*\]|[-–—]\s*\d{1,4}\s*[-–—]|(?:p|pp|pg|page|seite)\.?\s*\d{1,4}(?:\s*(?:of|/|von)\s*\d{1,4})?|\d{1,4}|\|\s*\d{1,4}\s*\|)\s*", re.I)
_NUMBERED = re.compile(r"\s*(?:(\d{1,4})(?:\s{2,}|\s*\|\s*|\t)(\S.*?)|(\S.*?)(?:\s{2,}|\s*\|\s*|\t)(\d{1,4}))\s*")
_HEADER = [
    re.compile(r"\S[^\n]{2,60}?\s{1,3}[•·]\s{1,3}\S[^\n]{2,70}"),
    re.compile(r"(?:ch|chap|chapter)\.?\s+\d{1,3}[.:]?\s+\S[^\n]{2,70}", re.I),
    re.compile(r"(?:annals|journal|proceedings|transactions|bulletin|archives?|letters|review|studies)\b[^\n]{2,70}?\bvol\.?\s*\d+(?:\s*\(\d+\))?(?:,?\s*no\.?\s*\d+)?", re.I),
]
_CAPS = re.compile(r"(?=(?:[^\W\d_a-z]*[A-Z][^a-z]*){8})[A-Z][^a-z\n|{}\[\]<>=#*`]{7,80}")


#: Every line of furniture matches this: a number at an end, a dot between, a chapter, a volume, or no small letters.
_CANDIDATE = re.compile(r"^[\[|\-–—]?\s*\d|\d\s*[\]|\-–—)]?$|[•·]|^(?:ch|p|page|seite|chap|chapter)\b|\bvol\b|^(?-i:[^a-z]+)$", re.I)


def header_shape(line: str) -> bool:
    """A line that looks like a running page header: author and title about a dot, chapter and title, journal and volume, or a title in capitals."""
    x = line.strip()
    if not 8 <= len(x) <= 110 or x[-1] in ".!?,;" and not x.isupper():
        return False
    if any(p.fullmatch(x) for p in _HEADER):
        return True
    return bool(_CAPS.fullmatch(x)) and len(re.findall(r"[A-Z][A-Z-]+", x)) >= 3 and x[-1] not in ".!?"


def furniture(lines: list[str]) -> dict[int, tuple[bool, bool]]:
    """(is header, is page number) of each line that is page furniture. A bare number is a page number
    only if the lines next to it hold no bare number too (a list of numbers)."""
    out: dict[int, tuple[bool, bool]] = {}
    for i, ln in enumerate(lines):
        x = ln.strip()
        if not x or len(x) > 120 or not _CANDIDATE.search(x):
            continue
        m = _NUMBERED.fullmatch(ln)
        if _PAGE.fullmatch(x):
            out[i] = (False, True)
        elif m and header_shape(m.group(2) or m.group(3)):
            out[i] = (True, True)
        elif header_shape(x):
            out[i] = (True, False)
    bare = [i for i, (h, p) in out.items() if not h and lines[i].strip().isdigit()]
    near = {j for i in bare for j in (i - 1, i + 1) if j in bare}
    if len(lines) > 1:
        for i in near:
            del out[i]
        return out
    return {}


def breaks(text: str):
    """(match, left part, right part, sign) of words that may be broken over a line end."""
    if not _BROKEN_END.search(text):
        return
    for m in _BREAK.finditer(text):
        left, sign, between, right = m.groups()
        if between:
            mid = between.split("\n")[:-1]
            f = furniture(["x", *mid, "x"])
            if any(x.strip() and i + 1 not in f for i, x in enumerate(mid)):
                continue
        yield m, left, right, sign


def tokens(text: str) -> list[str]:
    """Words in lower case, with words broken over lines put together, and compounds also as a whole."""
    return (WORD if _MISREAD.search(text) else _PLAIN).findall(text.lower())


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of a column ``text``: words, hyphen compounds, and joined broken words marked with a leading '+'."""

    def count(it):
        for pdf in it:
            c: Counter = Counter()
            for x in pdf.text:
                gone = set()
                for _, a, b, sign in breaks(x):
                    c["+" + (a + b).lower()] += 1
                    gone.add(a.lower())
                    gone.add(b.lower())
                if gone:
                    c.update(w for w in tokens(x) if w not in gone)
                else:
                    c.update(tokens(x))
                if "-" in x:
                    for w in x.split():
                        if "-" in w:
                            c.update(v.lower() for v in _COMPOUND.findall(w))
            yield pd.DataFrame(list(c.items()), columns=["word", "n"])

    return texts.mapInPandas(count, "word string, n long").filter(F.length("word") <= 60).groupBy("word").agg(F.sum("n").alias("n"))


#: Powers are taken modulo this prime, so that every character's fits a long.
PRIME = 2**31 - 1


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers (modulo PRIME) of the characters' codes: equal for anagrams, and a
    replacement of letters changes it by a fixed amount wherever it happens."""
    def power(c: Column) -> Column:
        v = F.ascii(c).cast("long")
        return (v * v * v) % PRIME * ((v * v) % PRIME) % PRIME

    return F.aggregate(F.transform(F.split(word, ""), power), F.lit(0).cast("long"), lambda a, x: a + x)


def _power(x: str) -> int:
    return sum(pow(ord(c), 5, PRIME) for c in x)


def corrections(words: DataFrame) -> DataFrame:
    """(word, right, n, n_right, kind, strength): misread words and their right form.

    Rare words, with the hash difference of each confusion (up to TIMES of it) added, are joined to
    frequent words by anagram hash; a join row holds if undoing the confusion in both gives the same
    word. Of several forms the one with the strongest evidence, its frequency, ranks first.
    """
    spark = words.sparkSession
    w = words.filter(~F.col("word").startswith("+") & ~F.col("word").contains("-"))
    plain = w.filter(F.col("word").rlike(r"^\p{L}+$"))
    signs = w.filter(F.col("word").rlike(r"[0-9@|!$€]") & F.col("word").rlike(r"\p{L}") & (F.length("word") >= 3) & ~F.col("word").rlike(r"^[0-9a-f]{12,}$"))
    right = plain.filter(F.length("word") >= 3).select(F.col("word").alias("right"), F.col("n").alias("n_right"), anagram_hash(F.col("word")).alias("h"))
    rows = [(a, b, k, (_power(b) - _power(a)) * k, kind) for kind, pairs in (("letter", LETTERS), ("sign", SIGNS)) for a, b in pairs for k in range(1, TIMES + 1)]
    diff = spark.createDataFrame(rows, "a string, b string, k int, d long, kind string")

    def look(rare: DataFrame, kind: str, cond: Column, cand: DataFrame) -> DataFrame:
        pairs = diff.filter(F.col("kind") == kind)
        r = rare.select("word", "n", anagram_hash(F.col("word")).alias("hw"))
        grown = r.join(F.broadcast(pairs), (F.length("word") - F.length(F.expr("replace(word, a, '')"))) >= F.col("k") * F.length("a"))
        same = F.expr("replace(word, a, b)") == F.expr("replace(right, a, b)")
        j = grown.withColumn("h", F.col("hw") + F.col("d")).join(cand, "h").filter(same & (F.col("word") != F.col("right")) & cond)
        return j.select("word", "right", "n", "n_right", "kind")

    some = plain.filter((F.length("word") >= MIN_LETTERS))
    letter = look(some, "letter", F.col("n") <= RARE_SHARE * F.col("n_right"), right.filter(F.col("n_right") >= FREQUENT))
    sign = look(signs, "sign", (F.col("n_right") >= 2) & (F.col("n_right") >= F.col("n")), right)
    rank = Window.partitionBy("word").orderBy(F.col("n_right").desc(), "right")
    return letter.unionByName(sign).withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")


def broken_words(words: DataFrame) -> DataFrame:
    """(joined, whole, compound): joined forms of broken words with how often they occur unbroken."""
    j = words.filter(F.col("word").startswith("+")).select(F.expr("substring(word, 2)").alias("joined"))
    return j.join(words.select(F.col("word").alias("joined"), F.col("n").alias("whole")), "joined", "left").fillna(0, ["whole"])


class Repairer:
    """Finds and repairs the noise of a text, given the corrections and counts of compounds and joined words."""

    def __init__(self, right: dict[str, str], compounds: dict[str, int], whole: dict[str, int]):
        self.right, self.compounds, self.whole = right, compounds, whole

    def is_broken(self, a: str, b: str, sign: str) -> bool:
        """A hyphen at a line end belongs to a compound if the compound is more usual than the joined word."""
        if sign != "-":
            return True
        c = self.compounds.get(f"{a}-{b}".lower(), 0)
        return self.whole.get((a + b).lower(), 0) >= c

    def word(self, w: str) -> str:
        r = self.right.get(w.lower())
        if r is None:
            return w
        return r.upper() if w.isupper() and len(w) > 1 else r[0].upper() + r[1:] if w[:1].isupper() else r

    def repair(self, x: str) -> tuple[dict[str, int], str]:
        found: dict[str, int] = {}
        lines = x.split("\n")
        f = furniture(lines) if len(lines) > 1 else {}
        for h, p in f.values():
            if h:
                found["header"] = found.get("header", 0) + 1
            if p:
                found["page_no"] = found.get("page_no", 0) + 1
        kept = "\n".join(ln for i, ln in enumerate(lines) if i not in f) if f else x
        if f:
            kept = re.sub(r"(?<=[^\s.!?:;…”\"])\n{2,}(?=[a-z0-9(])", "\n", kept)

        def join(m: re.Match) -> str:
            left, sign, _, right = m.groups()
            if not self.is_broken(left, right, sign):
                return m.group()
            found["hyphen"] = found.get("hyphen", 0) + 1
            return left + right

        for _ in range(2 if _BROKEN_END.search(kept) else 0):
            kept = re.sub(r"([^\W\d_]+)([-‐‑¬\xad])[ \t]*\n()[ \t]*([^\W\d_]+)", join, kept)

        n = 0

        def close(m: re.Match) -> str:
            nonlocal n
            n += 1
            return m.group().replace(" ", "")

        words = tokens(kept)
        if len([w for w in words if len(w) == 1]) > 3:
            kept = _SPACED.sub(close, kept)

        def fix(m: re.Match) -> str:
            nonlocal n
            w = m.group()
            r = self.word(w)
            if r != w and kept[m.end() : m.end() + 1] not in ("_", ":") and kept[m.start() - 1 : m.start()] not in ("_", "{", "/", "\\"):
                n += 1
                return r
            return w

        if not self.right.keys().isdisjoint(words):
            kept = WORD.sub(fix, kept)
        if n:
            found["glyph"] = n
        if found:
            kept = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", kept) if found.keys() & {"hyphen", "header", "page_no"} else kept
        return found, kept


def repair_scans(tables: list[tuple[str, DataFrame]], key: str, text: str) -> DataFrame:
    """(source_table, key, hyphen, glyph, header, page_no, repaired) of every text that holds noise.

    Words of all tables are counted together; ranked corrections come from the anagram-hash join,
    hyphen evidence from counts of joined words and compounds, and edge lines are removed by shape.
    Corrections, compounds and joined words are broadcast after a check of their size. Null, empty
    and clean texts give no rows; each row is judged by itself.
    """
    kt = tables[0][1].schema[key].dataType.simpleString()
    all_ = None
    for name, df in tables:
        p = df.select(F.lit(name).alias("source_table"), F.col(key).alias("_k"), F.col(text).alias("text")).filter(F.length("text") > 0)
        all_ = p if all_ is None else all_.unionByName(p)
    spark = all_.sparkSession
    words = cut(count_words(all_.select("text")), "words")
    fix = cut(corrections(words), "fix")
    joined = broken_words(words)
    halves = cut(joined.filter("whole > 0").select(F.col("joined").alias("word"), F.col("whole").alias("n")).unionByName(words.filter(F.col("word").contains("-") & ~F.col("word").startswith("+")).filter("n > 1")), "hyphens")
    for t in (fix, halves):
        if not size_bound(t, MAX_BROADCAST):
            raise ValueError("evidence exceeds MAX_BROADCAST rows; raise it with the executors' memory")
    right = {r.word: r.right for r in fix.select("word", "right").toLocalIterator()}
    counts = {r.word: r.n for r in halves.toLocalIterator()}
    shared = spark.sparkContext.broadcast((right, counts))

    def work(it):
        right, counts = shared.value
        rep = Repairer(right, counts, counts)
        for pdf in it:
            out = []
            for s, k, x in zip(pdf.source_table, pdf._k, pdf.text):
                found, new = rep.repair(x)
                if found:
                    out.append((s, k, *(found.get(c, 0) for c in ("hyphen", "glyph", "header", "page_no")), new))
            yield pd.DataFrame(out, columns=["source_table", key, "hyphen", "glyph", "header", "page_no", "repaired"])

    return all_.mapInPandas(work, f"source_table string, {key} {kt}, hyphen int, glyph int, header int, page_no int, repaired string")
