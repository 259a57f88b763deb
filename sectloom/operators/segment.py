"""Cutting texts: lines, headings, sections, windows, chunks, sentences, phrases."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectloom.functions import stats
from sectloom.functions import text as X
from sectloom.plans.runtime import cut, size_bound

#: Most rows of a vocabulary or list of phrases that is broadcast.
MAX_LOOKUP = 2_000_000


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line), i from 1; null texts have none."""
    x = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\\n")).alias("i", "line"))
    return x.withColumn("i", F.col("i") + 1)


def _with_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("i")
    x = lines(df, key, text).withColumn("t", F.trim("line")).withColumn("_p", F.trim(F.lag("line").over(w))).withColumn("_n", F.trim(F.lead("line").over(w)))
    is_h = F.length("t").between(3, 80) & F.col("t").rlike("^[0-9A-Z]") & ~F.col("t").rlike("[.!?,;:]$") & (F.col("_p").isNull() | (F.col("_p") == "")) & (F.col("_n") == "")
    return x.withColumn("is_h", F.coalesce(is_h, F.lit(False)))


def heading_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, heading): short capitalised lines without an end mark between blank lines."""
    return _with_headings(df, key, text).filter("is_h").select(key, F.col("i").alias("line_no"), F.col("t").alias("heading"))


def section_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, n_lines, n_chars): lines between heading lines; a heading opens its run."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    r = _with_headings(df, key, text).withColumn("run", F.sum(F.col("is_h").cast("int")).over(w).cast("int"))
    return r.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def header_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sec, title, body_lines): blocks under # headings; block 0 stands before the first."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    h = lines(df, key, text).withColumn("is_h", F.col("line").rlike("^#{1,6} +[^ ]"))
    r = h.withColumn("sec", F.sum(F.col("is_h").cast("int")).over(w).cast("int"))
    title = F.max(F.when(F.col("is_h"), F.trim(F.regexp_replace("line", "^#+ +", ""))))
    return r.groupBy(key, "sec").agg(title.alias("title"), (F.count(F.lit(1)) - F.max(F.col("is_h").cast("long"))).alias("body_lines"))


def log_band(df: DataFrame, by: str, size: Column, z: float = 2.0) -> DataFrame:
    """(by, middle, hi): exp of the median of log sizes, and of z robust deviations above it."""
    x = df.select(by, F.log(size).alias("x"))
    m = x.groupBy(by).agg(F.median("x").alias("m"))
    a = x.join(m, by).groupBy(by).agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    return m.join(a, by).select(by, F.round(F.exp("m"), 4).alias("middle"), F.round(F.exp(F.col("m") + z * 1.4826 * F.col("mad")), 4).alias("hi"))


def chunk_params(df: DataFrame, by: str, size: Column) -> DataFrame:
    """(by, lam, middle, hi): median and upper band of sizes on a Box-Cox scale fitted per group, turned back.

    The power is the best of a grid by profile likelihood, all powers in one aggregation.
    """
    from sectloom.operators.boxcox import fit_by

    return fit_by(df.select(F.col(by).alias("g"), size.cast("double").alias("x")).filter("x > 0"), "g").withColumnRenamed("g", by)


def length_filter(df: DataFrame, key: str, text: str, z: float) -> DataFrame:
    """Keys of texts whose log length is within z robust deviations of the median."""
    x = df.filter(F.length(text) > 0).select(key, F.log(F.length(text)).alias("x"))
    m = x.agg(F.median("x").alias("m"))
    a = x.crossJoin(F.broadcast(m)).agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))  # one-row tables
    return x.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(a)).filter(F.abs(F.col("x") - F.col("m")) <= z * 1.4826 * F.col("mad")).select(key)


def usable(df: DataFrame, title: str, text: str) -> DataFrame:
    """Rows with the first reason that excludes them: empty, reference, short (below the robust floor of log lengths), junk; else kept."""
    ref = X.is_reference(F.col(title))
    x = df.withColumn("_ref", ref).withColumn("_n", F.length(text))
    b = x.filter("_n > 0 AND NOT _ref").select(F.log("_n").alias("x"))
    m = b.agg(F.median("x").alias("m"))
    f = b.crossJoin(F.broadcast(m)).agg(F.first("m").alias("m"), F.median(F.abs(F.col("x") - F.col("m"))).alias("mad")).select(F.exp(F.col("m") - 2 * 1.4826 * F.col("mad")).alias("_floor"))
    why = F.when(F.coalesce("_n", F.lit(0)) == 0, "empty").when(F.col("_ref"), "reference").when(F.col("_n") < F.col("_floor"), "short").when(X.is_junk(F.col(text)), "junk").otherwise("kept")
    return x.crossJoin(F.broadcast(f)).withColumn("reason", why).drop("_ref", "_n", "_floor")


def first_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_md5): the least key of each exact text."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.md5(text).alias("text_md5")).agg(F.min(key).alias(key)).select(key, "text_md5")


def reassemble(chunks: DataFrame) -> DataFrame:
    """(build_id, doc_id, section_idx, n_chunks, digest): sections from the newest version of each chunk, in order."""
    w = Window.partitionBy("build_id", "doc_id", "section_idx", "chunk_idx").orderBy(F.col("version").desc(), F.col("record_id").desc())
    v = chunks.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda s: s["text"])
    return v.groupBy("build_id", "doc_id", "section_idx").agg(F.count(F.lit(1)).alias("n_chunks"), F.md5(F.array_join(parts, "\n\n")).alias("digest"))


def pack_lengths(sizes: list[int], target: int) -> list[int]:
    """Chunk number of each unit, in order: a unit opens a new chunk if it would carry the open one over the target."""
    out, n, room = [], -1, -1
    for s in sizes:
        if n < 0 or s > room:
            n, room = n + 1, target
        out.append(n)
        room -= s
    return out


def pack_units(df: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """(key, chunk, n_units, n_chars, digest): paragraphs packed in order into chunks of up to ``target`` characters; a longer paragraph is a chunk by itself."""
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        import hashlib

        for pdf in it:
            out = []
            for k, ps in zip(pdf.k, pdf.ps):
                ps = list(ps)
                chunk = pack_lengths([len(p) + 2 for p in ps], target)
                for c in range(chunk[-1] + 1 if chunk else 0):
                    part = [p for p, n in zip(ps, chunk) if n == c]
                    out.append((k, c, len(part), sum(map(len, part)), hashlib.md5("\n\n".join(part).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[key, "chunk", "n_units", "n_chars", "digest"])

    p = df.filter(F.length(text) > 0).select(F.col(key).alias("k"), X.paragraphs(F.col(text)).alias("ps"))
    return p.mapInPandas(work, f"{key} {kt}, chunk int, n_units int, n_chars long, digest string")


def windows(df: DataFrame, key: str, text: str, hi: int) -> DataFrame:
    """(key, win, first, n): disjoint windows of up to ``hi`` paragraphs; a tail of less than a third joins the window before, so nothing is lost."""
    n = df.filter(F.col(text).isNotNull()).select(key, F.size(X.paragraphs(F.col(text))).alias("np")).filter("np > 0")
    full = F.when((F.col("np") > hi) & (F.col("np") % hi != 0) & (F.col("np") % hi < hi / 3), F.floor(F.col("np") / hi)).otherwise(F.ceil(F.col("np") / hi)).cast("int")
    w = n.withColumn("_w", full).select(key, "np", "_w", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("win"))
    last = F.col("win") == F.col("_w") - 1
    return w.select(key, "win", (F.col("win") * hi).alias("first"), F.when(last, F.col("np") - F.col("win") * hi).otherwise(hi).cast("int").alias("n"))


def parents(df: DataFrame, doc: str, idx: str, text: str, m: int, hi: int, overlap: int) -> DataFrame:
    """(doc, parent, start, n_chars): a document's sections in order as parents: those of up to m characters
    are merged while they fit, longer than hi are windowed with the overlap."""
    dt = df.schema[doc].dataType.simpleString()
    g = df.filter(F.length(text) > 0).groupBy("build_id", doc).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.length(text).alias("n")))).alias("s"))

    def work(it):
        for pdf in it:
            out = []
            for b, k, s in zip(pdf.build_id, pdf[doc], pdf.s):
                p, open_ = 0, 0
                rows = []
                for r in s:
                    n = r["n"]
                    if n <= m and open_ and open_ + n <= hi:
                        rows[-1][2] += n
                        open_ += n
                    elif n <= hi:
                        rows.append([p, 0, n])
                        p, open_ = p + 1, n if n <= m else 0
                    else:
                        for at in range(0, max(1, n - overlap), hi - overlap):
                            rows.append([p, at, min(hi, n - at)])
                            p += 1
                        open_ = 0
                out += [(b, k, *r) for r in rows]
            yield pd.DataFrame(out, columns=["build_id", doc, "parent", "start", "n_chars"])

    return g.mapInPandas(work, f"build_id long, {doc} {dt}, parent int, start int, n_chars int")


def char_windows(df: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """(key, win, start, piece): windows of ``size`` characters every ``step``; the last ends with the text."""
    n = F.length(text)
    k = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    x = df.filter(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), k - 1)).alias("win"))
    return x.select(key, "win", (F.col("win") * step).alias("start"), F.substring(F.col("_t"), F.col("win") * step + 1, F.lit(size)).alias("piece"))


_CUTS = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def recursive_split(x: str, hi: int, level: int = 0) -> list[tuple[int, int]]:
    """Spans of pieces of at most ``hi`` characters, cut at the coarsest boundary that does it; nothing is lost."""
    if len(x) <= hi:
        return [(0, len(x))]
    if level == len(_CUTS):
        return [(i, min(i + hi, len(x))) for i in range(0, len(x), hi)]
    marks = [0, *(m.end() for m in _CUTS[level].finditer(x)), len(x)]
    out: list[tuple[int, int]] = []
    for a, b in zip(marks, marks[1:]):
        if b <= a:
            continue
        if b - a > hi:
            out += [(a + p, a + q) for p, q in recursive_split(x[a:b], hi, level + 1)]
        elif out and out[-1][1] == a and b - out[-1][0] <= hi:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def section_chunks(df: DataFrame, key: str, title: str, text: str, hi: int, overlap: int) -> DataFrame:
    """(key, chunk, start, end, is_reference): chunks of every section; each but the first repeats up to
    ``overlap`` characters from a word start. References sections are chunks too, flagged."""
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        for pdf in it:
            out = []
            for k, x, ref in zip(pdf.k, pdf.x, pdf.ref):
                for i, (a, b) in enumerate(recursive_split(x, hi - overlap)):
                    s = max(0, a - overlap) if i else a
                    m = re.compile(r"\s").search(x, s, a) if i else None
                    out.append((k, i, m.end() if m else (a if i else s), b, ref))
            yield pd.DataFrame(out, columns=[key, "chunk", "start", "end", "is_reference"])

    src = df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("x"), X.is_reference(F.coalesce(title, F.lit(""))).alias("ref"))
    return src.mapInPandas(work, f"{key} {kt}, chunk int, start int, end int, is_reference boolean")


_ABBREV = {"e.g", "i.e", "etc", "vs", "cf", "al", "fig", "eq", "sec", "dr", "mr", "mrs", "prof", "st", "no", "vol", "ch", "p", "pp"}
_SENT = re.compile(r"(?<=[.!?])[\"”’)]*\s+(?=[\"“‘(]*[A-Z0-9])|\n\s*\n")


def split_sentences(x: str) -> list[tuple[int, int]]:
    """Spans of sentences; a dot after an abbreviation or an initial ends none."""
    out, at = [], 0
    for m in _SENT.finditer(x):
        last = re.search(r"([\w.]+)\.$", x[at : m.start()].rstrip("\"”’)"))
        if last and "\n" not in m.group() and (last.group(1).lower() in _ABBREV or re.fullmatch(r"[A-Z]", last.group(1))):
            continue
        out.append((at, m.start()))
        at = m.end()
    if at < len(x):
        out.append((at, len(x)))
    return out


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, start, end, n_words): sentences of at least three words."""
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        for pdf in it:
            out = []
            for k, x in zip(pdf.k, pdf.x):
                for i, (a, b) in enumerate(split_sentences(x)):
                    n = len(re.findall(r"\w+", x[a:b]))
                    if n >= 3:
                        out.append((k, i, a, b, n))
            yield pd.DataFrame(out, columns=[key, "sent", "start", "end", "n_words"])

    return df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(work, f"{key} {kt}, sent int, start int, end int, n_words int")


_BARRIER = re.compile(r"\$[^$\n]{1,400}\$|\\\(.*?\\\)|<!--.*?-->|\[\d+(?:,\s*\d+)*\]|glyph<[^>]*>|\\cite\w*\{[^}]*\}", re.S)
_TOK = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*|\d+(?:\.\d+)?")


def shape(w: str) -> str:
    """Shape class of a word."""
    return "number" if w[0].isdigit() else "upper" if w.isupper() and len(w) > 1 else "title" if w[0].isupper() and w[1:].islower() else "lower" if w.islower() else "mixed"


def token_segments(x: str):
    """(kind, segment begins a sentence, words) of every segment of a text that has words, in order."""
    for block in re.split(r"\n\s*\n|\n(?=#|\|)", x):
        kind = "heading" if block.lstrip().startswith("#") else "cell" if block.lstrip().startswith("|") else "prose"
        for a, b in split_sentences(block) if kind == "prose" else [(0, len(block))]:
            first = True
            for part in _BARRIER.split(block[a:b]):
                for piece in part.split("|") if kind == "cell" else [part]:
                    ws = _TOK.findall(piece)
                    if ws:
                        yield kind, first, ws
                        first = False


def structural_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seg, pos, surface, fold, shape, sent_initial, kind): tokens in segments that no math, citation,
    comment, sentence end or line of another kind is crossed by. Kinds: heading, cell, prose."""
    kt = df.schema[key].dataType.simpleString()

    def work(it):
        for pdf in it:
            out = []
            for k, x in zip(pdf.k, pdf.x):
                for seg, (kind, first, ws) in enumerate(token_segments(x)):
                    out += [(k, seg, i, w, w.lower(), shape(w), first and i == 0, kind) for i, w in enumerate(ws)]
            yield pd.DataFrame(out, columns=[key, "seg", "pos", "surface", "fold", "shape", "sent_initial", "kind"])

    return df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(work, f"{key} {kt}, seg int, pos int, surface string, fold string, shape string, sent_initial boolean, kind string")


def folded_tokens(df: DataFrame, carry: list[str], text: str) -> DataFrame:
    """(carry, kind, fold, n, segs): how often each text has each folded token of :func:`structural_tokens`. The number of a
    text's segments of a kind stands in the first row of that kind and is 0 in the others, so sums over rows are totals."""
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def work(it):
        for pdf in it:
            out = []
            for *c, x in zip(*[pdf[c] for c in carry], pdf.x):
                found: dict[str, Counter] = {}
                segs: Counter = Counter()
                for kind, _, ws in token_segments(x):
                    found.setdefault(kind, Counter()).update(w.lower() for w in ws)
                    segs[kind] += 1
                out += [(*c, kind, w, n, 0 if i else segs[kind]) for kind, f in found.items() for i, (w, n) in enumerate(f.items())]
            yield pd.DataFrame(out, columns=[*carry, "kind", "fold", "n", "segs"])

    return df.filter(F.length(text) > 0).select(*carry, F.col(text).alias("x")).mapInPandas(work, f"{types}, kind string, fold string, n long, segs long")


def adjacent_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b, n): adjacent index tokens and how often they occur."""
    t = df.filter(F.col(text).isNotNull()).select(X.tokenize(F.col(text)).alias("t"))
    p = t.select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def merge_phrases(df: DataFrame, key: str, text: str, min_count: int, min_npmi: float) -> DataFrame:
    """(key, n_tokens, n_merged, digest): token sequences with phrases merged left to right. Phrases are
    broadcast after a check of their number."""
    kt = df.schema[key].dataType.simpleString()
    toks = df.filter(F.col(text).isNotNull()).select(F.explode(X.tokenize(F.col(text))).alias("t"))
    uni = toks.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    total = toks.count()
    p = adjacent_pairs(df, key, text).filter(F.col("n") >= min_count)
    j = p.join(uni.select(F.col("t").alias("a"), F.col("n").alias("na")), "a").join(uni.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b")
    good = j.filter(stats.npmi(F.col("n"), F.col("na"), F.col("nb"), F.lit(float(total))) >= min_npmi).select("a", "b")
    good = cut(good, "phrases")
    if not size_bound(good, MAX_LOOKUP):
        raise ValueError("more phrases than MAX_LOOKUP")
    shared = df.sparkSession.sparkContext.broadcast({(r.a, r.b) for r in good.toLocalIterator()})

    def work(it):
        import hashlib

        for pdf in it:
            out = []
            for k, t in zip(pdf.k, pdf.t):
                t, res, i = list(t), [], 0
                while i < len(t):
                    if i + 1 < len(t) and (t[i], t[i + 1]) in shared.value:
                        res.append(t[i] + "_" + t[i + 1])
                        i += 2
                    else:
                        res.append(t[i])
                        i += 1
                out.append((k, len(res), len(t) - len(res), hashlib.md5(" ".join(res).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=[key, "n_tokens", "n_merged", "digest"])

    return df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), X.tokenize(F.col(text)).alias("t")).mapInPandas(work, f"{key} {kt}, n_tokens int, n_merged int, digest string")


def vocabulary_pieces(df: DataFrame, key: str, text: str, vocab: DataFrame, piece: str) -> DataFrame:
    """(key, piece, tf): words spelled by the longest pieces of a frozen vocabulary; ## marks continuations.

    Distinct words are spelled once (the vocabulary, of a checked size, is broadcast) and joined back.
    """
    kt = df.schema[key].dataType.simpleString()
    if not size_bound(vocab, MAX_LOOKUP):
        raise ValueError("the vocabulary exceeds MAX_LOOKUP")
    shared = df.sparkSession.sparkContext.broadcast({r[0] for r in vocab.select(piece).filter(F.col(piece).isNotNull()).collect()})

    def work(it):
        for pdf in it:
            out = []
            for k, x in zip(pdf.k, pdf.x):
                c: Counter = Counter()
                for w, n in Counter(re.findall(r"[^\W_]+", x.lower())).items():
                    i, ps = 0, []
                    while i < len(w):
                        for j in range(len(w), i, -1):
                            p = ("##" if i else "") + w[i:j]
                            if p in shared.value:
                                ps.append(p)
                                i = j
                                break
                        else:
                            ps = []
                            break
                    for p in ps:
                        c[p] += n
                out += [(k, p, n) for p, n in c.items()]
            yield pd.DataFrame(out, columns=[key, "piece", "tf"])

    return df.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("x")).mapInPandas(work, f"{key} {kt}, piece string, tf long")


def corrections(df: DataFrame, key: str, text: str, min_df: int) -> DataFrame:
    """(word, right, n, n_right, context): words seen once or twice that are one edit from a word of at least
    ``min_df`` occurrences, where that word also occurs beside one of their neighbours.

    Candidates meet on a shared deletion: every word is joined by its spellings with one letter left
    out, so no pair of words without one is ever compared.
    """
    t = df.filter(F.col(text).isNotNull()).select(F.explode(X.tokenize(F.col(text))).alias("w"))
    c = t.filter(F.col("w").rlike("^[a-z]{4,}$")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    dels = lambda col: F.array_union(F.array(col), F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col)))))
    rare = c.filter("n <= 2").select(F.col("w").alias("word"), "n", F.explode(dels(F.col("w"))).alias("d"))
    freq = c.filter(F.col("n") >= min_df).select(F.col("w").alias("right"), F.col("n").alias("n_right"), F.explode(dels(F.col("w"))).alias("d"))
    cand = rare.join(freq, "d").filter((F.col("word") != F.col("right")) & (F.levenshtein("word", "right") == 1)).select("word", "right", "n", "n_right").distinct()
    pairs = adjacent_pairs(df, key, text)
    ctx = pairs.select(F.col("a").alias("w"), F.concat(F.lit(">"), "b").alias("c")).unionByName(pairs.select(F.col("b").alias("w"), F.concat(F.lit("<"), "a").alias("c")))
    own = cand.join(ctx.select(F.col("w").alias("word"), "c"), "word")
    both = own.join(ctx.select(F.col("w").alias("right"), "c"), ["right", "c"]).groupBy("word", "right", "n", "n_right").agg(F.count(F.lit(1)).alias("context"))
    w = Window.partitionBy("word").orderBy(F.col("context").desc(), F.col("n_right").desc(), "right")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
