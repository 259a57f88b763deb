"""Garbled text from wrong character encodings: a hidden Markov model over non-ASCII runs."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: encodings that UTF-8 bytes, or one another's bytes, are commonly read with
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "iso8859-2", "iso8859-7", "iso8859-15", "koi8-r", "cp866", "gbk", "shift_jis")
SINGLE_PAIRS = (  # (read as, really)
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1253", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp850", "cp1251"),
    ("cp1252", "cp1253"), ("cp1252", "iso8859-7"), ("mac_roman", "cp1253"), ("cp437", "cp1253"), ("cp1251", "cp1253"), ("cp850", "cp1253"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("mac_roman", "cp1250"), ("cp437", "cp1250"), ("cp850", "cp1250"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1251", "cp1250"),
)
LOST = "�"
#: Nats to enter a garbled state, to leave it, and for each run that it cannot explain.
ENTER, LEAVE, ALIEN = 4.0, 1.0, 9.0
#: Contexts of characters kept by the model; alphabets bound it, not the data. Above it, it is refused.
MAX_CONTEXTS = 2_000_000

_RUN = re.compile(r"[^\x00-\x7f]+")


def states() -> list[tuple[str, tuple[tuple[str, str], ...]]]:
    """Garbled states by name; each is a chain of (read as, really) to undo, first to last."""
    out = [(f"utf-8 as {w}", ((w, "utf-8"),)) for w in UTF8_READ_AS]
    out += [(f"utf-8 as {w} twice", ((w, "utf-8"), (w, "utf-8"))) for w in ("cp1252", "latin-1")]
    return out + [(f"{r} as {w}", ((w, r),)) for w, r in SINGLE_PAIRS]


STATES = states()


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int] | None:
    """Byte of each character of a one-byte encoding; bytes it leaves undefined stand for themselves."""
    if codec in ("gbk", "shift_jis"):
        return None
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def undo(run: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """What the run was before it was read wrongly, or None. Up to a quarter of broken UTF-8 is left as U+FFFD."""
    for wrong, right in chain:
        t = _table(wrong)
        try:
            raw = bytes(t[c] for c in run) if t else run.encode(wrong)
            new = raw.decode(right, "strict" if right != "utf-8" else "replace")
        except (KeyError, UnicodeError):
            return None
        if new == run or new.count(LOST) * 4 > len(new) or not new:
            return None
        if right == "utf-8" and len(new) >= len(run) and all(ord(c) < 128 for c in new):
            return None
        run = new
    return run


@lru_cache(maxsize=100_000)
def kind(c: str) -> str:
    """Class of a neighbour: case and script for letters, else digit, space, mark or other."""
    if c == "":
        return "e"
    if c < "\x80":
        return "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if c.isdigit() else "s" if c.isspace() else "p"
    if c.isalpha():
        n = unicodedata.name(c, "")
        s = "L" if n.startswith("LATIN") else "G" if n.startswith("GREEK") else "C" if n.startswith("CYRILLIC") else "X"
        return s + ("u" if c.isupper() else "l")
    return "n" if c.isspace() else "o"


@lru_cache(maxsize=500_000)
def contexts(left: str, run: str, right: str) -> tuple[tuple[str, str, str], ...]:
    """(class before, character, class after) of the non-ASCII characters of a run."""
    ks = [left, *map(kind, run), right]
    return tuple((ks[i], c, ks[i + 2]) for i, c in enumerate(run) if c >= "\x80")


def runs(text: str):
    """(start, class before, run, class after) of each stretch of non-ASCII characters."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        yield a, kind(text[a - 1 : a]), m.group(), kind(text[b : b + 1])


def train(docs: DataFrame, text: str) -> tuple[dict[tuple[str, str, str], int], int]:
    """Number of distinct texts that show each character in each context, over all documents, and their
    number; null and plain ASCII texts count nothing. Only the non-ASCII runs are shuffled."""

    def shown(it):
        for pdf in it:
            pdf = pdf[[not x.isascii() for x in pdf._x]]
            yield pd.DataFrame({"h": pdf.h, "runs": [json.dumps(sorted({r[1:] for r in runs(x)})) for x in pdf._x]})

    def count(it):
        c: Counter = Counter()
        n = 0
        for pdf in it:
            for x in pdf.runs:
                n += 1
                seen = set()
                for key in json.loads(x):
                    seen.update(contexts(*key))
                c.update(seen)
        c["", "", ""] = n
        yield pd.DataFrame([(*k, v) for k, v in c.items()], columns=["a", "c", "b", "n"])

    src = docs.select(F.col(text).alias("_x"), F.xxhash64(text).alias("h")).filter(F.length("_x") > 0)
    once = src.mapInPandas(shown, "h long, runs string").dropDuplicates(["h"])
    got = once.mapInPandas(count, "a string, c string, b string, n long").groupBy("a", "c", "b").agg(F.sum("n").alias("n"))
    rows = got.limit(MAX_CONTEXTS + 1).collect()
    if len(rows) > MAX_CONTEXTS:
        raise ValueError("the character model exceeds MAX_CONTEXTS")
    model = {(r.a, r.c, r.b): r.n for r in rows}
    return model, model.pop(("", "", ""), 0)


class Labeller:
    """Viterbi labelling of a text's runs by clean or one of STATES."""

    def __init__(self, model: dict[tuple[str, str, str], int], n: int):
        # a context unseen as a whole is judged by the side that is better known, a nat less
        sides: dict[tuple[str, str, str], int] = {}
        for (a, c, b), v in model.items():
            for k in ((a, c, "*"), ("*", c, b)):
                sides[k] = max(sides.get(k, 0), v)
        self.log = {k: math.log(v + 0.5) for k, v in model.items()}
        self.side = {k: math.log(v + 0.5) - 1.0 for k, v in sides.items()}
        self.floor = math.log(0.5)
        self.top = math.log(n + 1.0)
        self.memo: dict[tuple[str, str, str], list[tuple[int, float, str]]] = {}

    def weigh(self, key: tuple[str, str, str]) -> float:
        """Log-probability of a run, up to a constant a character."""
        t = 0.0
        for x in contexts(*key):
            if x[1] == LOST:  # no character of any clean text
                t -= ALIEN
                continue
            v = self.log.get(x)
            if v is None:
                v = max(self.floor, self.side.get((x[0], x[1], "*"), self.floor), self.side.get(("*", x[1], x[2]), self.floor))
            t += v - self.top
        return t

    def options(self, key: tuple[str, str, str]) -> list[tuple[int, float, str]]:
        """(state, log-likelihood ratio against clean, restored run) of the states that explain a run."""
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            left, run, right = key
            clean = self.weigh(key)
            got = []
            if LOST in run:
                got.append((len(STATES), -clean, run))
            for s, (_, chain) in enumerate(STATES):
                new, rest = undo(run, chain), ""
                if new is None and right == "s" and run[-1] in "ÃÂ":  # a no-break space that became a space
                    new = undo(run + "\xa0", chain)
                    rest = "!"
                if new is None:
                    continue
                gain = self.weigh((left, new, right)) - clean + (ALIEN - 2.0) * new.count(LOST)
                got.append((s, gain, new + rest))
            self.memo[key] = got
        return got

    def label(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, restored, state) of the garbled runs of a text."""
        seq, opts, hope = [], [], False
        for a, left, run, right in runs(text):
            o = self.options((left, run, right))
            seq.append((a, run))
            opts.append(o)
            hope = hope or any(g > 0 for _, g, _ in o)
        if not hope:
            return []
        # Viterbi over clean (-1) and the states that any run allows
        score: dict[int, float] = {-1: 0.0}
        back: list[dict[int, int]] = []
        live = {s for o in opts for s, g, _ in o if g > 0}
        for o in opts:
            em = {s: g for s, g, _ in o}
            best = max(score, key=score.get)
            new, frm = {}, {}
            for s in (-1, *live):
                stay = score.get(s, -math.inf)
                move = score[best] - ((LEAVE if best != -1 else 0.0) if s == -1 else ENTER)
                frm[s], v = (s, stay) if stay >= move else (best, move)
                new[s] = v + (0.0 if s == -1 else em.get(s, -ALIEN))
            score = new
            back.append(frm)
        s = max(score, key=lambda k: (score[k], -k))
        out = []
        for (a, run), o, frm in zip(reversed(seq), reversed(opts), reversed(back)):
            if s != -1:
                fixed = next((x for st, _, x in o if st == s), None)
                if fixed is not None:
                    extra = fixed.endswith("!")
                    out.append((a, a + len(run) + extra, fixed[:-1] if extra else fixed, s))
            s = frm[s]
        return out[::-1]


def garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, encoding, n_runs, restored) of every row whose text holds a garbled passage.

    The model's clean state is trained on all rows: in how many distinct texts each non-ASCII character stands
    in each context. Each garbled state is a pair of encodings; it explains a run of characters by
    how usual the run is once the pair is undone. Spans labelled with a state get its inverse
    transform; characters lost to U+FFFD stay, as they cannot be known. Null and empty texts, plain
    ASCII and letters usual in the collection are no cases. Each row is judged by itself, so
    repeated rows give repeated results; no row is shuffled.
    """
    model, n = train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model, n))
    kind_ = docs.schema[key].dataType.simpleString()

    def work(it):
        lab = Labeller(*shared.value)
        for pdf in it:
            out = []
            for k, x in zip(pdf._k, pdf._x):
                if x.isascii():
                    continue
                found = lab.label(x)
                if not found:
                    continue
                parts, at = [], 0
                for a, b, new, _ in found:
                    parts += [x[at:a], new]
                    at = b
                names = Counter((STATES[s][0] if s < len(STATES) else "lost") for *_, s in found)
                out.append((k, names.most_common(1)[0][0], len(found), "".join(parts) + x[at:]))
            yield pd.DataFrame(out, columns=[key, "encoding", "n_runs", "restored"])

    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).filter(F.length("_x") > 0)
    return src.mapInPandas(work, f"{key} {kind_}, encoding string, n_runs int, restored string")
