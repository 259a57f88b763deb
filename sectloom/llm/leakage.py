"""Evaluation texts leaking into training text: SimHash windows, multi-index Hamming lookup, exact check."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hamming radius, and the bit ranges of its radius + 1 blocks: fingerprints within the radius agree in one block at least.
RADIUS = 2
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Item words looked up in one pass; more items are taken in further passes over the documents.
MAX_WORDS = 1_000_000
#: Share of an item's words a run must hold, and words per replaced word.
SHARE, PER_REPLACED = 0.5, 8
#: Words by which one alignment may shift.
SLACK = 3
#: Documents whose windows are looked up together, and pairs of windows beyond which they are looked up in halves.
DOCS_AT_ONCE, PAIRS_AT_ONCE = 2000, 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words in lower case; punctuation and spacing only separate them."""
    return _WORD.findall(text.lower())


def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


def window_of(n: int) -> tuple[int, int]:
    """(words in a window, windows) that every run of half of an item of ``n`` words holds unharmed.

    Of L = n / 2 words up to L / 8 are replaced, and two more may be divided otherwise. What is left lies in that
    many places and one more, so the longest of them has at least the mean length: the window. A window
    is lost only by a word in it, which leaves the number of windows that is needed.
    """
    run = -(-n // 2)
    bad = run // PER_REPLACED
    w = max(1, -(-(run - bad - 2) // (bad + 2)))
    return w, max(1, run - w + 1 - bad * w - (w + 1))


def fingerprints(h: np.ndarray, w: int) -> np.ndarray:
    """64-bit SimHash of every window of ``w`` word hashes: each bit is the majority of the words' bits, counted
    for all 64 bits at once in bit planes."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    planes: list[np.ndarray] = []
    for i in range(w):
        carry = h[i : i + n]
        for j, p in enumerate(planes):
            planes[j], carry = p ^ carry, p & carry
        if i + 1 == 1 << len(planes):
            planes.append(carry)
    least = w // 2 + 1
    out = np.full(n, ~np.uint64(0))
    for j, p in enumerate(planes):  # count >= least, from the lowest bit
        out = p & out if least >> j & 1 else p | out
    return out


class _Hashes(dict):
    """Word hashes, kept."""

    def __missing__(self, w: str) -> int:
        v = self[w] = word_hash(w)
        return v


class WindowIndex:
    """Windows of the items that have windows of one size, found by any of the blocks."""

    def __init__(self, w: int, numbers: np.ndarray, starts: np.ndarray, flat: np.ndarray):
        self.w = w
        at = [np.arange(starts[i], starts[i + 1] - w + 1) for i in numbers]
        self.at = np.concatenate([np.empty(0, np.int64), *at]).astype(np.int64)  # first word of each window
        self.fp = np.concatenate([np.empty(0, np.uint64), *(fingerprints(flat[starts[i] : starts[i + 1]], w) for i in numbers)])
        self.keys = []
        for lo, bits in BLOCKS:
            v = (self.fp >> np.uint64(lo)).astype(np.int64) & ((1 << bits) - 1)
            order = np.argsort(v, kind="stable")
            there = np.zeros(1 << bits, bool)
            there[v] = True
            self.keys.append((lo, bits, v[order], order, there))

    def lookup(self, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All (document window, item window) pairs within RADIUS; None if more than ``most`` would be looked at."""
        todo, total = [], 0
        for lo, bits, sorted_v, order, there in self.keys:
            v = (fp >> np.uint64(lo)).astype(np.int64) & ((1 << bits) - 1)
            at = np.flatnonzero(there[v])
            first, last = np.searchsorted(sorted_v, v[at], "left"), np.searchsorted(sorted_v, v[at], "right")
            total += int((last - first).sum())
            todo.append((at, first, last - first, order))
        if total > most:
            return None
        dw, iw = [], []
        for at, first, cnt, order in todo:
            d = np.repeat(at, cnt)
            i = order[np.repeat(first - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt) + np.arange(cnt.sum())] if len(d) else d
            near = np.bitwise_count(fp[d] ^ self.fp[i]) <= RADIUS
            dw.append(d[near])
            iw.append(i[near])
        n = np.int64(max(1, len(self.fp)))
        key = np.unique(np.concatenate(dw) * n + np.concatenate(iw))
        return key // n, key % n


class ItemIndex:
    """Items by the windows that :func:`window_of` gives each; built once and shipped."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.words = dict(items)
        self.order = [k for k, _ in items]
        self.length = np.array([len(ws) for _, ws in items])
        self.starts = starts = np.cumsum([0, *self.length])
        self.flat = np.array([word_hash(w) for _, ws in items for w in ws], np.uint64)
        self.number = np.repeat(np.arange(len(items)), self.length) if len(items) else np.empty(0, np.int64)
        _, code = np.unique(self.flat, return_inverse=True)
        df = np.bincount(np.unique(code * np.int64(max(1, len(items))) + self.number) // max(1, len(items)))
        self.weight = np.log(1 + len(items) / df[code]) if len(code) else np.empty(0)
        size = np.array([window_of(n) for n in self.length]).reshape(-1, 2)
        self.need = size[:, 1]
        # the lightest stretch that the needed windows can cover
        span = size[:, 0] + self.need - 1
        sums = np.concatenate(([0.0], np.cumsum(self.weight)))
        self.least = np.array([(sums[a + m : b + 1] - sums[a : b + 1 - m]).min() - 1e-9 for a, b, m in zip(starts[:-1], starts[1:], np.minimum(span, self.length))])
        self.groups = [WindowIndex(int(w), np.flatnonzero(size[:, 0] == w), starts, self.flat) for w in np.unique(size[:, 0])]

    def candidates(self, words: list[list[str]], memo: _Hashes):
        """(document number, item, first and last window) of alignments that agree in as many windows, of as
        much weight, as any run of half of the item must; all documents' windows are looked up at once."""
        h = np.array([memo[w] for ws in words for w in ws], np.uint64)
        ends = np.cumsum([len(ws) for ws in words])
        for g in self.groups:
            yield from self._of(g, h, ends, 0, len(words))

    def _of(self, g: WindowIndex, h: np.ndarray, ends: np.ndarray, lo: int, hi: int):
        """Candidates among documents lo..hi, by halves if their pairs of windows are too many at once."""
        base = int(ends[lo - 1]) if lo else 0
        h_ = h[base : ends[hi - 1]]
        pairs = g.lookup(fingerprints(h_, g.w), PAIRS_AT_ONCE if hi - lo > 1 else 1 << 62)
        if pairs is None:
            mid = (lo + hi) // 2
            yield from self._of(g, h, ends, lo, mid)
            yield from self._of(g, h, ends, mid, hi)
            return
        dw, iw = pairs
        if not len(dw):
            return
        last = ends[lo:hi] - base
        doc = np.searchsorted(last, dw, "right")
        inside = dw + g.w <= last[np.minimum(doc, len(last) - 1)]  # a window over the end of a document is none
        dw, at, doc = dw[inside], g.at[iw[inside]], doc[inside]
        n = np.int64(len(self.order))
        own = doc * n + self.number[at]
        u, inv, cnt = np.unique(own, return_inverse=True, return_counts=True)
        many = (cnt >= self.need[u % n])[inv]
        dw, at, own = dw[many], at[many], own[many]
        if not len(dw):
            return
        # windows of one alignment have nearly the same distance between document and item words
        by = np.lexsort((dw - at, own))
        dw, at, own = dw[by], at[by], own[by]
        run = np.cumsum(np.concatenate(([0], (np.diff(own) != 0) | (np.diff(dw - at) > SLACK))))
        size = np.int64(len(self.flat))
        seen = []
        for s in range(g.w):
            eq = h_[dw + s] == self.flat[at + s]
            seen.append(run[eq] * size + at[eq] + s)
        seen = np.unique(np.concatenate(seen))
        votes = np.bincount(seen // size, self.weight[seen % size], run[-1] + 1)
        first = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
        until = np.append(first[1:], len(run))
        item, doc = own[first] % n, own[first] // n
        begin = np.concatenate(([0], last[:-1]))
        ok = np.flatnonzero(votes >= self.least[item])
        ok = ok[self._aligned(item[ok], (dw - at)[first[ok]], begin[doc[ok]], last[doc[ok]], h_)]
        for r in ok:
            i, j, start = first[r], until[r], begin[doc[r]]
            yield lo + int(doc[r]), self.order[item[r]], int(dw[i:j].min() - start), int(dw[i:j].max() - start) + g.w - 1

    def _aligned(self, item: np.ndarray, shift: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether some half of the item has as many words near the alignment's diagonal in the document as a run with all
        its replaced and divided words has: exact word shingles in place of the fingerprints."""
        size = self.length[item]
        which = np.repeat(np.arange(len(item)), size)
        pos = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        word = self.starts[item][which] + pos
        at = word + shift[which]
        eq = np.zeros(len(which), bool)
        for s in range(-SLACK, SLACK + 1):
            q = at + s
            inside = (q >= begin[which]) & (q < end[which])
            eq |= inside & (h[np.clip(q, 0, len(h) - 1)] == self.flat[word])
        half = -(-size // 2)
        total = np.concatenate(([0], np.cumsum(eq)))
        whole = np.flatnonzero(pos + half[which] <= size[which])
        most = np.zeros(len(item), np.int64)
        np.maximum.at(most, which[whole], total[whole + half[which[whole]]] - total[whole])
        return most >= half - half // PER_REPLACED - 2


def longest_run(item: list[str], doc: list[str]) -> int:
    """Most words of ``item`` in one run of ``doc``, in order, with at most one word in PER_REPLACED
    replaced. Stretches that differ only in where words are divided count as equal."""
    blocks = [b for b in SequenceMatcher(None, item, doc, False).get_matching_blocks() if b.size]
    if not blocks:
        return 0
    spans: list[tuple[int, int, int, int]] = []  # item from, to, doc from, to
    for b in blocks:
        a0, d0 = b.a, b.b
        if spans:
            pa, pd_ = spans[-1][1], spans[-1][3]
            if "".join(item[pa:a0]) == "".join(doc[pd_:d0]):
                spans[-1] = (spans[-1][0], a0 + b.size, spans[-1][2], d0 + b.size)
                continue
        spans.append((a0, a0 + b.size, d0, d0 + b.size))
    best = 0
    for i in range(len(spans)):
        wrong = 0
        for j in range(i, len(spans)):
            if j > i:
                wrong += max(spans[j][0] - spans[j - 1][1], spans[j][2] - spans[j - 1][3])
            n = spans[j][1] - spans[i][0]
            if wrong * PER_REPLACED <= n:
                best = max(best, n)
    return best


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, run_words, item_words): documents that hold, in one run, at least half of an
    item's words in their order, with at most one word in eight replaced.

    Windows are sized by the item: the longest that a run of half of it must hold unharmed, see
    :func:`window_of`. Every window of that size of every document gets a SimHash; a multi-index over
    three blocks of bits gives every item window within RADIUS. Windows of one alignment add their
    weighted shingles (weights: rarity among the items); pairs with as many windows, of as much weight, as any such
    run must have are checked exactly, word by word. Documents are read whole and never shuffled,
    so copies or one hot source cost no more than other rows. Items are few and frozen: their index is
    built once and broadcast, in passes of at most MAX_WORDS item words. Null and empty texts and
    null keys match nothing; items of a single word are searched for too. Repeated rows give one result.
    """
    spark = docs.sparkSession
    out = None
    src = docs.select(F.col(doc_key).alias("_d"), F.col(text).alias("_x")).filter(F.col("_d").isNotNull() & (F.length("_x") > 0))
    batch: list[tuple[int, list[str]]] = []
    n = 0

    def one_pass(batch):
        shared = spark.sparkContext.broadcast(ItemIndex(batch))

        def scan(it):
            ix = shared.value
            memo = _Hashes()
            for pdf in it:
                rows = []
                for lo in range(0, len(pdf) if ix.groups else 0, DOCS_AT_ONCE):
                    keys, texts = pdf._d.values[lo : lo + DOCS_AT_ONCE], pdf._x.values[lo : lo + DOCS_AT_ONCE]
                    words = [words_of(x) for x in texts]
                    if len(memo) > 1_000_000:
                        memo.clear()
                    for k, item, d0, d1 in ix.candidates(words, memo):
                        iwords, ws = ix.words[item], words[k]
                        best = longest_run(iwords, ws[max(0, d0 - len(iwords) - 8) : d1 + len(iwords) + 8])
                        if best >= SHARE * len(iwords):
                            rows.append((keys[k], item, best, len(iwords)))
                yield pd.DataFrame(rows, columns=[doc_key, item_key, "run_words", "item_words"])

        kind = docs.schema[doc_key].dataType.simpleString()
        return src.mapInPandas(scan, f"{doc_key} {kind}, {item_key} long, run_words int, item_words int")

    for r in items.select(item_key, item_text).distinct().toLocalIterator():
        if r[0] is None or not r[1]:
            continue
        ws = words_of(r[1])
        if not ws:
            continue
        if batch and n + len(ws) > MAX_WORDS:
            p = one_pass(batch)
            out = p if out is None else out.unionByName(p)
            batch, n = [], 0
        batch.append((int(r[0]), ws))
        n += len(ws)
    p = one_pass(batch)
    out = p if out is None else out.unionByName(p)
    return out.groupBy(doc_key, item_key).agg(F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words"))
