"""Markup residue: finding HTML, Markdown, wiki and LaTeX, and turning it into clean text."""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut

# fixed values: element names of HTML that count as tags
TAGS = (
    "a abbr article aside b blockquote body br caption center cite code col dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li link main mark meta nav ol "
    "option p pre q ref s samp script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video nowiki math"
).split()
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "br", "hr", "dd", "dt", "body", "main", "header", "footer", "nav", "aside", "figure"}
CONTAINERS = {"div", "article", "section", "main", "body", "aside", "nav", "header", "footer"}
#: A host's path wins if it gathers at least this share of the best path's votes.
WIN_SHARE = 0.5

_TAG = r"/?(?:" + "|".join(TAGS) + r")(?:\s[^<>]*)?/?"
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_I = re.I
_P = re.M

#: (kind, pattern) of every piece of markup; the pieces of a text are all matches of all patterns.
PIECES: list[tuple[str, re.Pattern]] = [
    ("html", re.compile(rf"<{_TAG}>|<!--.*?-->|<!DOCTYPE[^>]*>", _I | re.S)),
    ("html", re.compile(rf"&lt;{_TAG}&gt;", _I)),
    ("markdown", re.compile(r"^ {0,3}#{1,6}[ \t]+\S", _P)),
    ("markdown", re.compile(r"^[^\n]*\S[^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*$", _P)),
    ("markdown", re.compile(r"(?<![\w*])\*\*(?=\S)(?:(?!\*\*|\n\n).)+?(?<=\S)\*\*(?![*])", re.S)),
    ("markdown", re.compile(r"(?<![\w*])\*(?=[^\s*])(?:(?!\*|\n\n).)+?(?<=[^\s*])\*(?![\w*])", re.S)),
    ("markdown", re.compile(r"(?<!\w)__(?=\S)(?:(?!__|\n\n).)+?(?<=\S)__(?!\w)", re.S)),
    ("markdown", re.compile(r"(?<![\w_])_(?=[^\s_])(?:(?!\n\n)[^_]|(?<=\w)_(?=\w))+?(?<=[^\s_])_(?![\w_])", re.S)),
    ("markdown", re.compile(r"~~(?=\S)(?:(?!~~|\n\n).)+?~~", re.S)),
    ("markdown", re.compile(r"^ {0,3}```", _P)),
    ("markdown", re.compile(r"(?<!`)`(?!`)(?:(?!\n\n)[^`])+`(?!`)", re.S)),
    ("markdown", re.compile(r"!?\[[^\[\]\n]*(?:\n[^\[\]\n]+)?\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")),
    ("markdown", re.compile(r"^ {0,3}>[ \t]+\S", _P)),
    ("markdown", re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", _P)),
    ("wiki", re.compile(r"'''?(?=[^\s'])(?:(?!'''?|\n\n).)+?'''?", re.S)),
    ("wiki", re.compile(r"\[\[[^\[\]\n]+(?:\n[^\[\]\n]+)?\]\]")),
    ("wiki", re.compile(r"\{\{[^{}]+\}\}")),
    ("wiki", re.compile(r"^(?:\{\||\|\}|\|-)", _P)),
    ("wiki", re.compile(r"^(={2,6})[ \t]*[^=\n]+?[ \t]*\1[ \t]*$", _P)),
    ("wiki", re.compile(r"\[https?://\S+ [^\]\n]+\]")),
    ("latex", re.compile(r"\\(?:begin|end)\{[^{}]*\}")),
    ("latex", re.compile(r"\\[A-Za-z]{2,}\*?(?=[^A-Za-z]|$)|\\[A-Z]\\ref|\\[()\[\]]|\\[A-Za-z]\{|\\[&%$#_]")),
    ("latex", re.compile(r"\$\$(?:(?!\n\n)[^$])+\$\$")),
    ("latex", re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?:(?!\n\n)[^$])*?(?<=[^\s$\\])\$(?![\d$])")),
]


#: Every piece holds one of these.
_MAYBE = re.compile(r"[<&#*_~`>{|\\$\[]|''|==|--")


def entities(text: str) -> list[str]:
    """Character entities of a text: numbers and names that HTML knows."""
    return [m.group() for m in _ENTITY.finditer(text) if m.group(1)[0] == "#" or m.group(1) + ";" in html5]


def pieces(text: str | None) -> dict[str, int]:
    """Number of pieces of markup by kind; empty if there is none."""
    out: dict[str, int] = {}
    if not text or not _MAYBE.search(text):
        return out
    for kind, p in PIECES:
        n = sum(1 for _ in p.finditer(text))
        if n:
            out[kind] = out.get(kind, 0) + n
    n = len(entities(text))
    if n:
        out["html"] = out.get("html", 0) + n
    return out


def path_step(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """A container's step in a generalised path: its tag and classes, digits and hashes generalised."""
    cls = next((v or "" for k, v in attrs if k == "class"), "")
    names = sorted(re.sub(r"\d+", "9", c) for c in cls.split())
    return tag + "".join("." + c for c in names[:3])


class Containers(HTMLParser):
    """Scores the containers of a page: text of the paragraphs directly in each, without the text of links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, str]] = [("", "")]
        self.links = 0
        self.scores: dict[str, float] = {}

    def handle_starttag(self, tag, attrs):
        if tag in CONTAINERS:
            self.path.append((tag, path_step(tag, attrs)))
        elif tag == "a":
            self.links += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in CONTAINERS:
            for i in range(len(self.path) - 1, 0, -1):
                if self.path[i][0] == tag:
                    del self.path[i:]
                    break

    def handle_data(self, data):
        n = len(data.strip())
        if n:
            k = "/".join(s for _, s in self.path)
            self.scores[k] = self.scores.get(k, 0.0) + (-n if self.links else n)


class Extractor(HTMLParser):
    """Text of a page with its structure, of the containers on the winning paths alone, if there are any."""

    def __init__(self, keep: set[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.keep, self.path, self.out = keep, [("", "")], []
        self.skip = 0
        self.pre = 0
        self.cells = 0

    def on(self) -> bool:
        return self.keep is None or "/".join(s for _, s in self.path) in self.keep

    def handle_starttag(self, tag, attrs):
        if tag in CONTAINERS:
            self.path.append((tag, path_step(tag, attrs)))
        if tag in ("script", "style", "head"):
            self.skip += 1
        if self.skip or not self.on():
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n# ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "tr":
            self.out.append("\n")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag == "br":
            self.out.append("\n" if self.pre else " ")
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif self.on() and not self.skip:
            if tag == "pre" and self.pre:
                self.pre -= 1
                self.out.append("\n```\n\n")
            elif tag in BLOCKS and tag not in ("li", "tr", "br", "td"):
                self.out.append("\n\n")
        if tag in CONTAINERS:
            for i in range(len(self.path) - 1, 0, -1):
                if self.path[i][0] == tag:
                    del self.path[i:]
                    break

    def handle_data(self, data):
        if not self.skip and self.on():
            self.out.append(data)


def html_to_text(x: str, keep: set[str] | None) -> str:
    """HTML with its comparison signs kept: only '<' that begin a tag are read as tags."""
    safe = re.sub(rf"<(?!{_TAG}>|!--|!DOCTYPE)", "&lt;", x, flags=_I)
    e = Extractor(keep)
    e.feed(safe)
    e.close()
    return "".join(e.out)


# fixed values: commands whose argument is a heading, is kept as text, or is dropped
_HEADING = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{([^{}]*)\}")
_KEEP = re.compile(r"\\(?:emph|textit|textbf|texttt|textsc|textrm|underline|text|mbox|url|footnote)\{([^{}]*)\}")
_DROP = re.compile(r"~?\\(?:cite[a-z]*|label|ref|eqref|autoref|index|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}")


def latex_to_text(x: str) -> str:
    """LaTeX commands replaced; formulas are kept between dollar signs."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append("$" + re.sub(r"\s+", " ", next(g for g in m.groups() if g is not None).strip()) + "$")
        return f"\x00{len(held) - 1}\x00"

    x = re.sub(r"\\begin\{(?:equation|align|gather|displaymath|math)\*?\}(.*?)\\end\{(?:equation|align|gather|displaymath|math)\*?\}|\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])((?:(?!\n\n)[^$])*?(?<=[^\s$\\]))\$(?![\d$])", hold, x, flags=re.S)
    x = _DROP.sub("", x)
    x = re.sub(r"\\S(?![A-Za-z])", "§", x).replace("~", " ")
    x = re.sub(r"\((?:see|cf\.?)?[\s§,;]*\)\s?", "", x)  # a bracket whose references are gone
    x = _HEADING.sub(r"\n\n# \1\n\n", x)
    for _ in range(4):
        y = _KEEP.sub(r"\1", x)
        if y == x:
            break
        x = y
    x = re.sub(r"\\(?:begin|end)\{(?:verbatim|lstlisting)\}", "\n```\n", x)
    x = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "\n", x)
    x = re.sub(r"\\item(?:\[[^\]]*\])?[ \t]*", "\n- ", x)
    x = re.sub(r"\\([&%$#_{}])", r"\1", x)
    x = re.sub(r"\\\\", "\n", x)
    x = re.sub(r"\\[A-Za-z]+\*?(?:\{([^{}]*)\})?", lambda m: m.group(1) or "", x)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], x)


def wiki_to_text(x: str) -> str:
    """Wiki headings, links, templates, tables and quotes replaced."""
    x = re.sub(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", r"# \2", x, flags=re.M)
    for _ in range(3):
        x = re.sub(r"\{\{[^{}]*\}\}", "", x)
    x = re.sub(r"\n?\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", x)
    x = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", x)
    x = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", x)
    x = re.sub(r"'''?((?:(?!'''?|\n\n).)+?)'''?", r"\1", x, flags=re.S)

    def tab(m: re.Match) -> str:
        rows = [[]]
        for ln in m.group(1).split("\n")[1:]:
            if ln.startswith("|-"):
                rows.append([])
            elif ln[:1] in "!|" and ln:
                rows[-1] += [c.strip() for c in re.split(r"\|\||!!", ln[1:])]
        return "\n".join(" | ".join(r) for r in rows if r)

    return re.sub(r"\{\|(.*?)\n\|\}", tab, x, flags=re.S)


def markdown_to_text(x: str) -> str:
    """Markdown emphasis and links replaced; headings, lists, tables and code keep plain marks."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group())
        return f"\x01{len(held) - 1}\x01"

    x = re.sub(r"^ {0,3}```.*?^ {0,3}```[ \t]*$", hold, x, flags=re.S | re.M)
    x = re.sub(r"^([^\n]*\S[^\n]*)\n {0,3}(?:={3,}|-{3,})[ \t]*$", r"# \1", x, flags=re.M)
    x = re.sub(r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t#]*$", r"# \1", x, flags=re.M)
    x = re.sub(r"!\[([^\[\]]*)\]\([^()]*\)", r"\1", x)
    x = re.sub(r"\[([^\[\]]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)", r"\1", x)
    x = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", x, flags=re.M)
    x = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", x, flags=re.M)
    x = re.sub(r"^ {0,3}>[ \t]+", "", x, flags=re.M)
    x = re.sub(r"^[ \t]*[*+-][ \t]+(?!\d+ -$)", "- ", x, flags=re.M)
    for kind, p in PIECES[4:9]:
        x = p.sub(lambda m: m.group().strip("*_~"), x)
    x = re.sub(r"(?<!`)`(?!`)((?:(?!\n\n)[^`])+)`(?!`)", r"\1", x)
    return re.sub("\x01(\\d+)\x01", lambda m: held[int(m.group(1))], x)


def to_clean(text: str, kinds: dict[str, int], keep: set[str] | None = None) -> str:
    """Clean text of a value that holds ``kinds`` of markup; without any it is returned as it is."""
    if not kinds:
        return text
    x = text
    if "html" in kinds:
        x = re.sub(rf"&lt;({_TAG})&gt;", r"<\1>", x, flags=_I)
        x = html_to_text(x, keep)
    if "latex" in kinds:
        x = latex_to_text(x)
    if "wiki" in kinds:
        x = wiki_to_text(x)
    if "markdown" in kinds:
        x = markdown_to_text(x)
    x = x.replace("\xa0", " ")
    x = re.sub(r"[ \t]+\n", "\n", x)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", x)).strip()


def winning_paths(df: DataFrame, host: str, value: str) -> DataFrame:
    """(host, paths): the generalised tag-class paths whose containers hold the host's text.

    Every page scores its containers; scores are added up by host and path with map-side combining,
    so one hot host is one small group of paths. The best path and those with at least WIN_SHARE
    of its score win.
    """
    kind = df.schema[host].dataType.simpleString()

    def score(it):
        for pdf in it:
            sums: dict[tuple, float] = {}
            for h, x in zip(pdf._h, pdf._v):
                c = Containers()
                c.feed(x)
                c.close()
                for p, s in c.scores.items():
                    sums[h, p] = sums.get((h, p), 0.0) + s
            yield pd.DataFrame([(h, p, s) for (h, p), s in sums.items()], columns=["_h", "path", "score"])

    v = df.select(F.col(host).alias("_h"), F.col(value).alias("_v")).mapInPandas(score, f"_h {kind}, path string, score double").groupBy("_h", "path").agg(F.sum("score").alias("score"))
    w = Window.partitionBy("_h")
    best = v.withColumn("_m", F.max("score").over(w)).filter((F.col("score") > 0) & (F.col("score") >= WIN_SHARE * F.col("_m")))
    return best.groupBy("_h").agg(F.collect_set("path").alias("_paths"))


def clean_markup(df: DataFrame, key: str, fields: list[str], host: str) -> DataFrame:
    """(key, field, html, markdown, wiki, latex, clean) of every value of ``fields`` that holds markup.

    The counts are of pieces of each kind. HTML is read by host consensus: containers of all the
    host's values are scored, generalised tag-class paths win by vote, and values that have a
    winning container are extracted from winning containers alone (a bare fragment is its own
    container). Values without markup, null and empty ones give no rows. Rows with a null host are
    extracted whole. Repeated rows give repeated results.
    """
    kt, ht = (df.schema[c].dataType.simpleString() for c in (key, host))
    v = df.select(F.col(key).alias("_k"), F.col(host).alias("_h"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("s")).select("_k", "_h", "s.field", F.col("s.v").alias("_v")).filter(F.length("_v") > 0)

    def mark(it):
        for pdf in it:
            ks = [pieces(x) for x in pdf._v]
            hit = [bool(k) for k in ks]
            out = pdf[hit].copy()
            ks = [k for k in ks if k]
            for kind in ("html", "markdown", "wiki", "latex"):
                out[kind] = [k.get(kind, 0) for k in ks]
            yield out

    cols = f"_k {kt}, _h {ht}, field string, _v string, html int, markdown int, wiki int, latex int"
    marked = cut(v.mapInPandas(mark, cols), "marked")
    boxed = F.lower("_v").rlike("<(?:" + "|".join(sorted(CONTAINERS)) + r")[\s>]") & F.col("_h").isNotNull()
    wins = winning_paths(marked.filter(boxed), "_h", "_v")
    joined = marked.filter(boxed).join(wins, "_h", "left").select(*marked.columns, "_paths").unionByName(marked.filter(~F.coalesce(boxed, F.lit(False))).withColumn("_paths", F.lit(None).cast("array<string>")))

    def convert(it):
        for pdf in it:
            out = []
            for x, h, m, w, l, paths in zip(pdf._v, pdf.html, pdf.markdown, pdf.wiki, pdf.latex, pdf._paths):
                kinds = {k: n for k, n in (("html", h), ("markdown", m), ("wiki", w), ("latex", l)) if n}
                keep = set(paths) if paths is not None and len(paths) else None
                if keep:
                    c = Containers()
                    c.feed(x)
                    keep = keep if keep & set(c.scores) else None
                out.append(to_clean(x, kinds, keep))
            yield pd.DataFrame({key: pdf._k, "field": pdf.field, "html": pdf.html, "markdown": pdf.markdown, "wiki": pdf.wiki, "latex": pdf.latex, "clean": out})

    return joined.mapInPandas(convert, f"{key} {kt}, field string, html int, markdown int, wiki int, latex int, clean string")
