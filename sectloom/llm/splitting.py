"""Splitting oversized items at natural boundaries, by ranges with halos."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut

LIMIT, OVERLAP = 1500, 150
#: Characters (or bytes, for files) of one range, and of the halo read on either side of it.
RANGE, HALO = 4096, 2048
LEVELS = ("paragraph", "line", "sentence", "word")

# fixed values: what separates pieces at each level
SEPARATORS = {
    "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
    "line": re.compile(r"\n\s*"),
    "sentence": re.compile(r"(?<=[.!?])\s+|\n\s*"),
    "word": re.compile(r"\s+"),
}
_SPACE = re.compile(r"\s")
#: Where the first piece of a range begins if not at a known place: at the first character that is no white space, or nowhere.
FIRST, NOWHERE = -1, -2


def fragments(text: str, lo: int, hi: int, base: int, level: str) -> tuple[tuple[int, int] | None, int, tuple[int, int] | None, bool]:
    """Pieces of text[lo:hi] at one level: the one open at the left, the longest closed one, the one open
    at the right, and whether any boundary lies in the range. Spans are offsets of the first and past
    the last character that is no white space, moved by ``base``; None if there is no such character."""

    def span(a: int, b: int) -> tuple[int, int] | None:
        a, b = max(a, lo), min(b, hi)
        x = text[a:b]
        s = x.lstrip()
        return (base + b - len(s), base + a + len(x.rstrip())) if s else None

    left, longest, at, found = None, 0, lo, False
    for m in SEPARATORS[level].finditer(text, max(0, lo - HALO)):
        if m.start() >= hi:
            break
        if m.end() <= lo:
            continue
        piece = span(at, m.start()) if m.start() > at else None
        if not found:
            left = piece
        elif piece:
            longest = max(longest, piece[1] - piece[0])
        found, at = True, m.end()
    rest = span(at, hi) if at < hi else None
    return (left, longest, rest, True) if found else (rest, 0, None, False)


def ranges_of(df: DataFrame, key: str, text: str, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """(key, r, base, lead, slice): each text in ranges, every slice with its halos; lead is the length of the left halo."""
    n = F.ceil(F.length(text) / range_chars).cast("int")
    r = df.select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("r"))
    base = (F.col("r") * range_chars).cast("long")
    lead = F.least(F.lit(halo), base).cast("int")
    return r.select(key, "r", base.alias("base"), lead.alias("lead"), F.substring(F.col(text), (base - lead + 1).cast("int"), (lead + range_chars + halo)).alias("slice"))


def oversized_boundaries(df: DataFrame, key: str, text: str, *, limit: int = LIMIT, range_chars: int = RANGE) -> DataFrame:
    """(key, n_chars, boundary) of every text of more than ``limit`` characters without outer white space.

    boundary is the first of paragraph, line, sentence, word at which cutting everywhere leaves only
    pieces within the limit, else hard. Workers look at ranges; pieces that reach over range ends are
    put together from the table of open fragments, so no text need be held whole by a worker. White
    space of more than HALO characters over the end of a range counts as two runs. Null, empty and
    blank texts are not oversized; keys must be unique (of repeated keys the texts would be mixed).
    """
    big = df.select(key, text).filter(F.length(text) > limit)
    kind = df.schema[key].dataType.simpleString()

    def look(it):
        for pdf in it:
            out = []
            for k, r, base, lead, x in zip(pdf[key], pdf.r, pdf.base, pdf.lead, pdf.slice):
                hi = min(len(x), lead + range_chars)
                inner = x[lead:hi]
                s = inner.lstrip()
                whole = (int(base) + len(inner) - len(s), int(base) + len(inner.rstrip())) if s else None
                out.append((k, r, "all", *(whole or (None, None)), 0, None, None, False))
                for lv in LEVELS:
                    left, longest, right, cut = fragments(x, lead, hi, int(base) - lead, lv)
                    out.append((k, r, lv, *(left or (None, None)), longest, *(right or (None, None)), cut))
            yield pd.DataFrame(out, columns=[key, "r", "level", "l0", "l1", "longest", "r0", "r1", "cut"]).astype({c: "Int64" for c in ("l0", "l1", "r0", "r1")})

    found = ranges_of(big, key, text, range_chars).mapInPandas(look, f"{key} {kind}, r int, level string, l0 long, l1 long, longest int, r0 long, r1 long, cut boolean")
    w = Window.partitionBy(key, "level").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    seg = F.coalesce(F.sum(F.col("cut").cast("int")).over(w), F.lit(0))
    open_ = found.withColumn("_seg", seg).select(
        key, "level", "longest",
        F.explode(F.array(F.struct(F.col("_seg").alias("s"), F.col("l0").alias("a"), F.col("l1").alias("b")), F.struct((F.col("_seg") + F.col("cut").cast("int")).alias("s"), F.col("r0").alias("a"), F.col("r1").alias("b")))).alias("f"),
    )
    parts = open_.groupBy(key, "level", "f.s").agg((F.max("f.b") - F.min("f.a")).alias("len"), F.max("longest").alias("longest"))
    worst = parts.groupBy(key, "level").agg(F.max(F.greatest(F.coalesce("len", F.lit(0)), "longest")).alias("worst"))
    by = worst.groupBy(key).agg(*[F.max(F.when(F.col("level") == lv, F.col("worst"))).alias(lv) for lv in ("all", *LEVELS)])
    kindest = F.lit("hard")
    for lv in reversed(LEVELS):
        kindest = F.when(F.col(lv) <= limit, lv).otherwise(kindest)
    return by.filter(F.col("all") > limit).select(key, F.col("all").alias("n_chars"), kindest.alias("boundary"))


def best_cut(x: str, start: int, stop: int) -> tuple[int, int]:
    """Where to end a piece in x[start:stop], and where the next text begins: the last paragraph end in
    the window that leaves at least half of it, else line, sentence or word end, else the very stop."""
    least = start + (stop - start) // 2
    for lv in LEVELS:
        hit = None
        for m in SEPARATORS[lv].finditer(x, start):
            if m.start() > stop:
                break
            if m.start() > start and (m.start() >= least or lv == "word"):
                hit = m
        if hit:
            return hit.start(), hit.end()
    return stop, stop


def back(x: str, start: int, lowest: int) -> int:
    """Start of the overlap before ``start``: the first word start at or after ``lowest``."""
    if lowest <= 0:
        return 0
    m = _SPACE.search(x, lowest - 1, start)
    return m.end() if m and m.end() < start else (lowest if not _SPACE.search(x, lowest, start) else start)


def step(x: str, at: int, limit: int, overlap: int) -> tuple[int, int, int]:
    """(start, end, next) of the piece whose new text begins at ``at``: x[start:end] is the piece, the next begins at ``next``."""
    start = back(x, at, max(0, at - overlap)) if at > 0 else at
    while start < at and x[start].isspace():
        start += 1
    end, nxt = (len(x), len(x)) if len(x) - start <= limit else best_cut(x, at, start + limit)
    e = end
    while e > at and x[e - 1].isspace():
        e -= 1
    return start, e, solid(x, nxt if nxt > at else end)


def solid(x: str, at: int) -> int:
    """The first place from ``at`` that is no white space."""
    while at < len(x) and x[at].isspace():
        at += 1
    return at


def cut_whole(x: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(fresh, start, end) of the pieces of a whole text: x[fresh:end] is new, x[start:fresh] repeats the piece before."""
    out, at = [], solid(x, 0)
    while at < len(x):
        start, end, nxt = step(x, at, limit, overlap)
        out.append((at, start, end))
        at = nxt
    return out


def entries(x: str, lo: int, limit: int, overlap: int) -> set[int]:
    """Every place at which the first piece of a range that begins at ``lo`` > 0 can begin: word starts within the limit, the
    first word after white space that reaches over it, and any place in a stretch without white space that is
    long enough to be cut hard."""
    out, hi = set(), min(len(x), lo + limit + 1)
    for m in re.finditer(r"\S+", x):
        if m.start() >= hi:
            if hi < len(x) and x[hi - 1].isspace():
                out.add(m.start())
            break
        if m.end() <= lo:
            continue
        if m.start() >= lo:
            out.add(m.start())
        if m.end() - m.start() >= limit - overlap - 1:
            out.update(range(max(lo, m.start()), min(hi, m.end())))
    return out


def leave(x: str, at: int, hi: int, final: bool, limit: int, overlap: int, memo: dict[int, int]) -> int:
    """Where the first piece at or after ``hi`` begins if one begins at ``at``: a place in x, FIRST or NOWHERE."""
    path = []
    while at < hi and at < len(x) and at not in memo:
        path.append(at)
        at = step(x, at, limit, overlap)[2]
    out = memo[at] if at in memo else at if at < len(x) else NOWHERE if final else FIRST
    memo.update(dict.fromkeys(path, out))
    return out


def range_map(x: str, lead: int, hi: int, zero: int, final: bool, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(entry, exit) of a range x[lead:hi], in places of the whole text: where its first piece begins, and where that of the
    ranges after it does."""
    memo: dict[int, int] = {}
    out = [(FIRST, leave(x, solid(x, lead), hi, final, limit, overlap, memo))]
    if zero + lead > 0:
        out += [(zero + e, leave(x, e, hi, final, limit, overlap, memo)) for e in sorted(entries(x, lead, limit, overlap))]
    return [(e, zero + o if o >= 0 else o) for e, o in out]


def resolve(maps: DataFrame, key: str, ranges: int) -> DataFrame:
    """(key, r, entry): where the first piece of every range begins, from the ranges' maps (key, r, entry, exit): maps of
    neighbouring ranges are put together two by two, up and down again, so ``ranges`` in a row take log2(ranges) joins."""
    levels, size = [maps], 1
    while size * 2 < ranges:
        f = levels[-1]
        second = f.filter(F.col("r") % (2 * size) == size).select(key, (F.col("r") - size).alias("r"), F.col("entry").alias("exit"), F.col("exit").alias("_to"))
        both = f.filter(F.col("r") % (2 * size) == 0).join(second, [key, "r", "exit"], "left")
        levels.append(cut(both.select(key, "r", "entry", F.coalesce("_to", "exit").alias("exit")), "map"))
        size *= 2
    known = maps.select(key).distinct().select(key, F.lit(0).alias("r"), F.lit(FIRST).cast("long").alias("entry"))
    for f in reversed(levels):
        nxt = known.filter(F.col("r") % (2 * size) == 0).join(f, [key, "r", "entry"]).filter(F.col("exit") != NOWHERE)
        known = cut(known.unionByName(nxt.select(key, (F.col("r") + size).alias("r"), F.col("exit").alias("entry"))), "entries")
        size //= 2
    return known


def numbered(pieces: DataFrame, key: str) -> DataFrame:
    """Pieces (key, r, i, ...) with piece_no: a prefix sum of the ranges' piece counts."""
    counts = pieces.groupBy(key, "r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(key, "r", "_before")
    return pieces.join(before, [key, "r"]).withColumn("piece_no", (F.col("_before") + F.col("i")).cast("int"))


def split_oversized(df: DataFrame, key: str, text: str, carry: list[str], *, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """Pieces of every text over ``limit`` characters (outer white space dropped): key, the ``carry``
    columns, piece_no, start, end, n_repeated and piece.

    A piece has at most ``limit`` characters and repeats up to ``overlap`` of the one before. Workers read ranges
    with halos: each says, for every place at which its first piece can begin, where the pieces leave it; these maps
    are stitched to the one place at which each range does begin, and then ranges emit their pieces by offset.
    The pieces are those of cutting the whole text from its beginning, whatever the range size. Piece numbers follow
    from a prefix sum. Texts within the limit, blank and null ones give no rows; rows of a repeated key
    are each cut by themselves.
    """
    if overlap * 2 > limit or limit + overlap >= halo or limit + overlap >= range_chars:
        raise ValueError("overlap must be at most half the limit, and both together must fit a halo and a range")
    big = df.select(key, text, *carry).filter(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) > limit)
    big = cut(big.withColumn("_id", F.monotonically_increasing_id()), "big")
    size = F.length(text)
    slices = ranges_of(big.withColumn("_len", size), "_id", text, range_chars, halo)
    slices = slices.join(big.select("_id", size.alias("_len")), "_id")

    def bounds(pdf: pd.DataFrame):
        for k, r, base, lead, x, n in zip(pdf._id, pdf.r, pdf.base, pdf.lead, pdf.slice, pdf._len):
            yield k, r, x, int(lead), min(len(x), int(lead) + range_chars), int(base) - int(lead), int(base) + range_chars + halo >= n

    def look(it):
        for pdf in it:
            out = [(k, r, e, o) for k, r, x, lead, hi, zero, final in bounds(pdf) for e, o in range_map(x, lead, hi, zero, final, limit, overlap)]
            yield pd.DataFrame(out, columns=["_id", "r", "entry", "exit"])

    maps = cut(slices.mapInPandas(look, "_id long, r int, entry long, exit long"), "maps")
    ranges = (maps.agg(F.max("r")).first()[0] or 0) + 1
    begin = resolve(maps, "_id", ranges)

    def emit(it):
        for pdf in it:
            out = []
            for (k, r, x, lead, hi, zero, _), entry in zip(bounds(pdf), pdf.entry):
                at, i = (solid(x, lead) if entry == FIRST else int(entry) - zero), 0
                while at < hi:
                    start, end, nxt = step(x, at, limit, overlap)
                    out.append((k, r, i, zero + start, zero + end, at - start, x[start:end]))
                    at, i = nxt, i + 1
            yield pd.DataFrame(out, columns=["_id", "r", "i", "start", "end", "n_repeated", "piece"])

    p = slices.join(begin, ["_id", "r"]).mapInPandas(emit, "_id long, r int, i int, start long, end long, n_repeated int, piece string")
    out = numbered(p, "_id").drop("r", "i").join(big.select("_id", key, *carry), "_id")
    return out.select(key, *carry, "piece_no", "start", "end", "n_repeated", "piece")


def file_pieces(spark, paths: list[str], *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE * 256, halo: int = HALO * 4) -> DataFrame:
    """Pieces of giant UTF-8 files: (path, piece_no, start_byte, end_byte, n_repeated, piece), as in :func:`split_oversized`.

    One row per byte range is distributed; each worker seeks to its range and reads it with halos, never the
    whole file. Sizes and bytes are read through the Arrow file systems, so object stores that Arrow knows serve
    as well as paths. Offsets are in bytes. Bytes that are not UTF-8 are replaced. Missing files raise an error.
    """
    from pyarrow import fs as arrow

    if (limit + overlap) * 4 >= min(halo, range_bytes):
        raise ValueError("limit and overlap together must fit a quarter of a halo and of a range")

    def opened(path: str):
        return arrow.FileSystem.from_uri(path) if "://" in path else (arrow.LocalFileSystem(), path)

    def size_of(path: str) -> int:
        f, p = opened(path)
        info = f.get_file_info(p)
        if info.type == arrow.FileType.NotFound:
            raise FileNotFoundError(path)
        return info.size

    sizes = [(p, size_of(p)) for p in paths]
    rows = [(p, i, i * range_bytes, n) for p, n in sizes for i in range(max(1, -(-n // range_bytes)))]
    ranges = spark.createDataFrame(rows, "path string, r int, base long, size long").repartition(max(1, min(len(rows), 4096)))

    def read(path: str, base: int, size: int):
        """(x, lead, hi, byte of each character's place, final): the text of a range and its halos."""
        a = max(0, base - halo)
        f, p = opened(path)
        with f.open_input_file(p) as h:
            h.seek(a)
            raw = h.read(base - a + range_bytes + halo)
        skip = 0
        while a > 0 and skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80:
            skip += 1
        final = a + len(raw) >= size
        raw, a = raw[skip:], a + skip
        if not final:  # a character cut off at the end
            for t in range(1, 5):
                if raw[-t] & 0xC0 != 0x80:
                    if raw[-t] >= 0xC0:
                        raw = raw[:-t]
                    break
        x = raw.decode("utf-8", "surrogateescape")
        byte = np.cumsum([0, *(1 if c < "\x80" else 1 if "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in x)]) + a
        lead, hi = int(np.searchsorted(byte, base)), int(np.searchsorted(byte, base + range_bytes))
        return x, lead, min(hi, len(x)), byte, final

    def look(it):
        for pdf in it:
            out = []
            for path, r, base, size in zip(pdf.path, pdf.r, pdf.base, pdf["size"]):
                x, lead, hi, byte, final = read(path, int(base), int(size))
                # a text's beginning has no left halo, so only there is the place 0
                for e, o in range_map(x, lead, hi, 0, final, limit, overlap) if base else [(FIRST, leave(x, solid(x, 0), hi, final, limit, overlap, {}))]:
                    out.append((path, r, int(byte[e]) if e >= 0 else e, int(byte[o]) if o >= 0 else o))
            yield pd.DataFrame(out, columns=["path", "r", "entry", "exit"])

    maps = cut(ranges.mapInPandas(look, "path string, r int, entry long, exit long"), "maps")
    begin = resolve(maps, "path", max((r[1] for r in rows), default=0) + 1)

    def emit(it):
        for pdf in it:
            out = []
            for path, r, base, size, entry in zip(pdf.path, pdf.r, pdf.base, pdf["size"], pdf.entry):
                x, lead, hi, byte, _ = read(path, int(base), int(size))
                at, i = (solid(x, lead) if entry == FIRST else int(np.searchsorted(byte, entry))), 0
                while at < hi:
                    start, end, nxt = step(x, at, limit, overlap)
                    piece = x[start:end].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    out.append((path, r, i, int(byte[start]), int(byte[end]), at - start, piece))
                    at, i = nxt, i + 1
            yield pd.DataFrame(out, columns=["path", "r", "i", "start_byte", "end_byte", "n_repeated", "piece"])

    p = ranges.join(begin, ["path", "r"]).mapInPandas(emit, "path string, r int, i int, start_byte long, end_byte long, n_repeated int, piece string")
    return numbered(p, "path").select("path", "piece_no", "start_byte", "end_byte", "n_repeated", "piece")
