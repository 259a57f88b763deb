"""Operators on training data against brute force, and on dirty input."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectloom.llm import cooccur, encoding, gridclust, knn, leakage, markup, packing, relevance, scans, splitting


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# p4 -------------------------------------------------------------------------
def _brute_pairs(data, min_shared):
    base = {}
    for s, o, e, c, *_ in data:
        if None not in (s, o, e) and c is not None and c > 0:
            base.setdefault(s, {}).setdefault(o, set()).add(e)
    out = {}
    for s, by in base.items():
        c = Counter(p for es in by.values() for p in itertools.combinations(sorted(es), 2))
        f = Counter(e for es in by.values() for e in es)
        for (a, b), k in c.items():
            if k >= min_shared:
                n = len(by)
                p = k / n
                v = 0.0 if k >= n else math.log(p / (f[a] / n * f[b] / n)) / -math.log(p)
                out[s, a, b] = (k, round(v, 9))
    return out


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_pairs_with_and_without_chunks(spark, chunk):
    rnd = random.Random(3)
    data = [(rnd.choice(["x", "y"]), rnd.randrange(8), rnd.randrange(12), rnd.choice([1, 2, 0, -1, None]), "extra") for _ in range(300)]
    data += data[:40] + [("x", 100, e, 1, "big") for e in range(40)] + [(None, 1, 1, 1, ""), ("x", None, 1, 1, ""), ("x", 1, None, 1, "")]
    df = spark.createDataFrame(data, "run string, ord int, ent int, cnt int, n string")
    got = {(r.run, r.a, r.b): (r.n_shared, round(r.npmi, 9)) for r in cooccur.associations(df, "run", "ord", "ent", "cnt", min_shared=2, chunk_items=chunk).collect()}
    want = _brute_pairs(data, 2)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_pairs_empty(spark):
    df = spark.createDataFrame([], "run string, ord int, ent int, cnt int")
    assert cooccur.associations(df, "run", "ord", "ent", "cnt").count() == 0


# p6 -------------------------------------------------------------------------
def test_terms_spellings_and_repeats(spark):
    data = [(1, 1, "Foo", 3), (1, 1, " foo ", 2), (1, 1, "Foo", 3), (1, 1, "bar", None), (1, 1, "bar", 0), (1, 2, "baz", 50), (1, None, "q", 1), (1, 2, None, 1)]
    df = spark.createDataFrame(data, "qa_build_id long, community_id int, term string, df int")
    s = relevance.term_relevance(relevance.community_terms(df), "qa_build_id", "community_id", "term", "df").collect()
    assert {(r.term, r.tf, r.record_len, r.term_total, r.scope_total) for r in s} == {("foo", 5, 5, 5, 55), ("baz", 50, 50, 50, 55)}
    assert all(r.score > 0 for r in s)


def test_pieces_and_idf(spark):
    v = spark.createDataFrame([("l", 1, "ab", 2.0), ("l", 2, "##c", None), ("l", 3, "zz", 0.0), (None, 4, "x", 1.0)], "label string, col int, piece string, idf float")
    c = spark.createDataFrame([("l", 1, "Abc ab!"), ("l", 2, None), ("l", 3, ""), ("other", 4, "ab")], "label string, record_id long, text string")
    n = relevance.piece_counts(c, v)
    assert rows(n) == [("l", 1, "##c", 1), ("l", 1, "ab", 2)]
    f = {r.piece: (r.filled, r.idf) for r in relevance.fill_idf(v, n).collect() if r.label == "l"}
    assert f["ab"] == (False, 2.0) and f["##c"][0] and f["zz"][0] and f["zz"][1] > f["##c"][1]


# p3 -------------------------------------------------------------------------
def _boundary(t, limit):
    import re

    for name, p in (("paragraph", r"\n[ \t\r]*\n"), ("line", r"\n"), ("sentence", r"(?<=[.!?])\s+|\n"), ("word", r"\s+")):
        if max(len(x.strip()) for x in re.split(p, t)) <= limit:
            return name
    return "hard"


def _text(rnd):
    return "".join(rnd.choice(["word ", "xy. ", "\n", "\n \t\n", "long" * 12, "木川", "  ", "a! "]) for _ in range(rnd.randrange(0, 120)))


@pytest.mark.parametrize("size", [50, 333, 65536])
def test_boundaries_and_pieces(spark, size):
    rnd = random.Random(size)
    texts = {i: _text(rnd) for i in range(60)} | {100: None, 101: "", 102: " " * 500, 103: "x" * 700}
    texts[104] = "ab " * 40 + " " * 900 + "cd " * 60 + "\n\n" * 300 + "end"
    df = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "id long, text string, r string")
    want = {k: _boundary(t.strip(), 100) for k, t in texts.items() if t and len(t.strip()) > 100}
    got = {r.id: r.boundary for r in splitting.oversized_boundaries(df, "id", "text", limit=100, range_chars=size).collect()}
    assert got == want
    p = splitting.split_oversized(df, "id", "text", ["r"], limit=100, overlap=10, range_chars=max(size, 200), halo=400).collect()
    by = {}
    for r in p:
        by.setdefault(r.id, []).append(r)
    assert by.keys() == want.keys()
    for k, ps in by.items():
        t, end = texts[k], 0
        ps.sort(key=lambda r: r.piece_no)
        assert [(r.start + r.n_repeated, r.start, r.end) for r in ps] == splitting.cut_whole(t, 100, 10)  # at any range size
        assert [r.piece_no for r in ps] == list(range(len(ps)))
        for r in ps:
            assert t[r.start : r.end] == r.piece and 0 < len(r.piece) <= 100 and 0 <= r.n_repeated <= 10
            assert t[end : r.start + r.n_repeated].strip() == ""
            end = r.end
        assert t[end:].strip() == ""


def test_giant_file(spark, tmp_path):
    rnd = random.Random(1)
    t = "".join(rnd.choice(["wörd ", "木川 ", "end. ", "\n\n", "ab\n"]) for _ in range(5000))
    f = tmp_path / "big.txt"
    f.write_text(t, encoding="utf-8")
    raw = t.encode()
    ps = sorted(splitting.file_pieces(spark, [str(f)], limit=200, overlap=20, range_bytes=4096, halo=2048).collect(), key=lambda r: r.piece_no)
    end = 0
    for i, r in enumerate(ps):
        assert r.piece_no == i and raw[r.start_byte : r.end_byte].decode() == r.piece and len(r.piece) <= 200
        fresh = r.start_byte + len(r.piece[: r.n_repeated].encode())
        assert raw[end:fresh].decode().strip() == ""
        end = r.end_byte
    assert raw[end:].decode().strip() == ""
    whole = splitting.cut_whole(t, 200, 20)
    assert [r.piece for r in ps] == [t[a:b] for _, a, b in whole]
    with pytest.raises(FileNotFoundError):
        splitting.file_pieces(spark, [str(tmp_path / "none.txt")])


# p8 -------------------------------------------------------------------------
def test_hilbert_is_a_curve():
    p = np.array(list(itertools.product(range(8), repeat=3)))
    k = packing.hilbert(p, 3)
    o = p[np.argsort(k)]
    assert sorted(k.tolist()) == list(range(512)) and (np.abs(np.diff(o, axis=0)).sum(1) == 1).all()


def test_packing_round_trip(spark):
    texts = [(i, "alpha beta gamma " * (i % 40)) for i in range(200)] + [(500, "tok " * 900), (501, None), (502, ""), (503, "same"), (504, "same")]
    df = spark.createDataFrame(texts, "doc long, text string")
    enc = packing.load_tokenizer()
    want = {k: len(enc.encode_ordinary(t)) for k, t in texts if t}
    r = packing.pack(df, "doc", "text", capacity=256, stretch_tokens=10_000).collect()
    size, got = Counter(), Counter()
    for x in r:
        size[x.container] += x.n_tokens
        got[x.doc] += x.n_tokens
        assert x.n_pieces == 1 or x.doc == 500
    assert max(size.values()) <= 256 and dict(got) == want
    assert sum(size.values()) / (256 * len(size)) > 0.9


# p9 -------------------------------------------------------------------------
def test_fingerprints_are_majorities():
    h = np.random.default_rng(0).integers(0, 2**63, 40, dtype=np.uint64)
    for w in range(1, 10):
        f = leakage.fingerprints(h, w)
        assert len(f) == 41 - w
        for i in range(0, len(f), 5):
            assert all(int(f[i]) >> b & 1 == int(2 * sum(int(x) >> b & 1 for x in h[i : i + w]) > w) for b in range(64))


def test_no_quote_of_half_an_item_is_missed(spark):
    """Items of 1 to 90 words, quoted by half with as many replaced words as are allowed, anywhere."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(6000)]
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 7, 9, 12, 16, 17, 21, 30, 33, 48, 64, 90):
        t = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(t)))
        for r in range(6):
            half = -(-n // 2)
            at = rnd.randrange(0, n - half + 1)
            q = t[at : at + half]
            # no word at an end, so that the run is as long as it says
            for k in rnd.sample(range(1, half - 1), min(half // 8, max(0, half - 2))):
                q[k] = "zzz"
            docs.append((n * 100 + r, " ".join(rnd.choices(words, k=30) + q + rnd.choices(words, k=30))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == {(k, k // 100) for k, _ in docs}


def test_too_many_pairs_at_once_are_looked_up_in_halves(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PAIRS_AT_ONCE", 50)
    words = [f"a{k}" for k in range(40)]
    items = [(i, " ".join(words)) for i in range(5)]
    ix = leakage.ItemIndex([(i, t.split()) for i, t in items])
    got = {(k, i) for k, i, *_ in ix.candidates([words, ["x"], words + ["y"], []], leakage._Hashes())}
    assert got == {(k, i) for k in (0, 2) for i in range(5)}


def test_leaks(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rnd.choices(words, k=50))) for i in range(20)]
    docs, want = [(900, None), (901, ""), (902, "few words")], set()
    for i, t in items:
        w = t.split()
        pad = lambda: " ".join(rnd.choices(words, k=60))
        docs.append((i, f"{pad()} {t.upper().replace(' ', ' , ')} {pad()}"))
        want.add((i, i))
        half = w[10:38]
        half[5], half[15] = "zzz", "yyy"  # two of 28 replaced
        docs.append((100 + i, f"{pad()} {' '.join(half)} {pad()}"))
        want.add((100 + i, i))
        docs.append((200 + i, f"{pad()} {' '.join(w[:15])} {pad()}"))  # too short a quote
        docs.append((300 + i, f"{' '.join(w[:13])} {pad()} {' '.join(w[25:38])}"))  # not in one run
    d = spark.createDataFrame(docs + docs[3:4], "doc_id long, text string")
    it = spark.createDataFrame(items + [(77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == want


# p10 ------------------------------------------------------------------------
def test_garbled_texts_are_restored(spark):
    clean = ["Das Mädchen größer als „fünf“ Bäume", "El niño comió años después “mañana”", "café naïve — élève déjà", "été où l’été", "überprüft für Größe"]
    texts = [(i, clean[i % 5] + f" {i}") for i in range(400)]
    bad = {}
    for i, (w, r) in enumerate([("cp1252", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("mac_roman", "cp1252")]):
        t = "El niño comió años después de café, élève déjà"
        texts.append((1000 + i, t.encode(r).decode(w)))
        bad[1000 + i] = t
    texts += [(2000, "plain"), (2001, None), (2002, ""), (2003, "lost caf�")]
    got = {r.id: r.restored for r in encoding.garbled(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    assert got.keys() == bad.keys() | {2003}
    assert all(got[k] == bad[k] for k in bad)


def test_a_garbled_text_copied_into_most_rows_is_restored(spark):
    clean = ["Das Mädchen", "El niño", "café", "été", "überprüft"]
    bad = "Das Mädchen".encode().decode("cp1252")
    texts = [(i, f"{clean[i % 5]} {i}") for i in range(200)] + [(1000 + i, bad) for i in range(300)]
    got = {r.id: r.restored for r in encoding.garbled(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    assert got == {1000 + i: "Das Mädchen" for i in range(300)}


# p5 -------------------------------------------------------------------------
@pytest.mark.parametrize("t", ["p < 0.05 and q > 0.2", "costs $40 per node and $55 per", "file a_b_c to d_e", "see [12] for 2*3*4", "KX-204B -> KX-207 and R&D", "x^2 + y_1 = 4", "a < b and c > d", "- 60 -", "Ranks #1 to #5", "Q&A", "5 % of it; {p, q} | r", "", None])
def test_no_markup(t):
    assert markup.pieces(t) == {}


@pytest.mark.parametrize("t,k,clean", [
    ("<b>bold</b> x", "html", "bold x"), ("a &amp; b", "html", "a & b"), ("&lt;p&gt;para&lt;/p&gt;", "html", "para"), ("## Head\n\ntext", "markdown", "# Head\n\ntext"),
    ("a **b c** d", "markdown", "a b c d"), ("see [in](https://x.example/y) it", "markdown", "see in it"), ("== Head ==", "wiki", "# Head"), ("[[As|as]] is", "wiki", "as is"),
    ("x{{cite|1}} y", "wiki", "x y"), ("an \\emph{odd} word", "latex", "an odd word"), ("so $x_i^2$ holds", "latex", "so $x_i^2$ holds"), ("\\section{Head}", "latex", "# Head"),
])
def test_markup(t, k, clean):
    p = markup.pieces(t)
    assert set(p) == {k} and markup.to_clean(t, p) == clean


def test_consensus_paths(spark):
    page = lambda i: f'<html><body><div class="nav{i}"><a href="x">home</a><a href="y">about us all</a></div><div class="main c{i}"><p>{"real text here " * 9}{i}</p></div></body></html>'
    df = spark.createDataFrame([(i, "h", page(i), 0) for i in range(6)] + [(9, None, "<p>no host</p>", 0), (10, "h", None, 0)], "k long, host string, v string, score int")
    r = {x.k: x.clean for x in markup.clean_markup(df, "k", ["v"], "host").collect()}
    assert set(r) == {*range(6), 9} and all("about" not in r[i] and "real text" in r[i] for i in range(6)) and r[9] == "no host"


# p7 -------------------------------------------------------------------------
def test_scan_noise(spark):
    base = [(i, "the figure shows a token and the cluster of letters in every margin of the table") for i in range(60)]
    bad = [(100, "the figurc shows a tok-\nen and the\n12\nclu5ter of l e t t e r s in\nKLOLINE ARCHIVES AND THEIR INDEXES\nevery margin"), (101, "the table\nof tokens"), (102, None), (103, ""), (104, "13\n14\n15"), (105, "a heavy-tailed sum and a heavy-\ntailed one, heavy-tailed")]
    a = spark.createDataFrame(base, "record_id long, text string")
    b = spark.createDataFrame(bad, "record_id long, text string")
    got = {(r.source_table, r.record_id): r for r in scans.repair_scans([("a", a), ("b", b)], "record_id", "text").collect()}
    assert set(got) == {("b", 100)}
    r = got["b", 100]
    assert (r.hyphen, r.page_no, r.header) == (1, 1, 1) and r.glyph == 3
    assert r.repaired == "the figure shows a token and the cluster of letters in every margin"


@pytest.mark.parametrize("t", [
    "[ 12 ]", "- 12 -", "p. 12", "pp 12", "pg. 12", "Page 3 of 9", "Seite 3 von 9", "12", "| 12 |", "12   Methods of the survey", "Methods of the survey | 12",
    "A. Writer • Methods of the survey", "A. Writer · Methods of the survey", "Ch. 5. Methods of the survey", "Chap. 5: Methods of the survey", "Chapter 3. Methods of the survey",
    "Journal of Methods, vol. 12 (3), no. 4", "METHODS OF THE SURVEY",
])
def test_every_form_of_furniture_passes_the_prefilter(t):
    assert scans._PAGE.fullmatch(t) or scans._NUMBERED.fullmatch(t) or scans.header_shape(t)
    assert scans._CANDIDATE.search(t)


# p1, p2 ---------------------------------------------------------------------
def _vectors(seed=0):
    g = np.random.default_rng(seed)
    c = np.linalg.qr(g.normal(size=(32, 32)))[0][:4]
    lab = g.integers(0, 4, 300)
    x = c[lab] * 0.8 + g.normal(size=(300, 32)) * 0.06
    return lab, x.astype(np.float32)


def test_nearest_equals_brute_force(spark):
    _, x = _vectors()
    x[10] = x[11]
    data = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(5, x[5].tolist(), "e"), (900, None, ""), (901, [0.0] * 32, ""), (902, [float("nan")] * 32, ""), (903, [1.0], ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(data, "id long, emb array<float>, code string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(300)}
    for leaf in (4096, 100):
        got = {}
        for r in knn.nearest(df, "id", "emb", 32, 5, leaf=leaf).collect():
            got.setdefault(r.a, set()).add(r.b)
        assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
        assert np.mean([len(got[i] & want[i]) / 5 for i in want]) > (0.97 if leaf == 4096 else 0.9)


def test_rounds_go_on_until_lists_settle(spark, monkeypatch):
    """The last round changes at most two in a thousand entries."""
    x = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<float>")
    changed, cut = [], knn.cut

    def spy(d, label="cut"):
        out = cut(d, label)
        if label == "new":
            changed.append(out.count())
        return out

    monkeypatch.setattr(knn, "cut", spy)
    assert knn.nearest(df, "id", "emb", 8, 5, trees=2, leaf=30).count() == 1500
    assert changed[-1] <= 0.002 * 300 * 10


def test_trees_split_although_most_rows_are_copies():
    x = np.random.default_rng(0).normal(size=(400, 8)).astype(np.float32)
    x[:360] = x[0]
    f = knn.Forest(x, 400, 8, 50)
    assert all(len(np.unique(f.route(x)[:, t])) > 1 for t in range(8))


def test_leaves_that_come_out_too_large_are_split_again(spark):
    """Trees of a tiny sample leave large leaves; these get trees of their own, and lists are as good as before."""
    x = np.random.default_rng(6).normal(size=(900, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<float>")
    codes, members = knn.encode(df, "id", "emb", 4, 2, 20, sample=16)
    assert members is None and codes.count() == 900
    for t in (0, 1):
        assert codes.groupBy(F.col("leaves")[t].alias("l")).count().agg(F.max("count")).first()[0] <= 40
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(900)}
    got = {}
    for r in knn.top_lists(knn.nn_descent(codes, 4), 5).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) > 0.9


def test_copies_of_one_vector(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    data = [(i, v) for i in range(40)] + [(100 + i, [float(i), 1.0, -1.0, 0.5]) for i in range(10)]
    df = spark.createDataFrame(data, "id long, emb array<float>")
    got = {}
    for r in knn.nearest(df, "id", "emb", 4, 5).collect():
        got.setdefault(r.a, []).append(r.b)
    assert len(got) == 50 and sorted(got[0]) == [1, 2, 3, 4, 5] and sorted(got[30]) == [0, 1, 2, 3, 4]
    assert knn.nearest(df.filter("id < 0"), "id", "emb", 4, 5).count() == 0


def test_clusters(spark):
    lab, x = _vectors(1)
    noise = np.random.default_rng(2).normal(size=(10, 32))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(noise)] + [(2000, None)]
    df = spark.createDataFrame(data, "id long, emb array<float>")
    m = {r.id: r for r in gridclust.grid_clusters(df, "id", "emb", 32).collect()}
    assert len(m) == 310
    names = {c: {m[i].cluster for i in range(300) if lab[i] == c and m[i].clear} for c in range(4)}
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == 4
    assert sum(m[i].clear for i in range(300)) > 280 and sum(m[1000 + i].clear for i in range(10)) <= 2


def test_queries_are_registered():
    from sectloom.llm.queries import LLM

    assert {f"p{n}_found" for n in range(1, 11)} <= set(LLM.queries)


def test_more_clusters_than_a_hundred(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(110, 160))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 40, 0) + g.normal(size=(110 * 40, 160)) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<float>")
    m = gridclust.grid_clusters(df, "id", "emb", 160).toPandas()
    assert m.cluster.notna().all() and m.cluster.nunique() == 110
    assert (m.groupby(m.id // 40).cluster.nunique() == 1).all()


def test_short_words_are_corrected_too(spark):
    """Three letters are enough where the right form is far more frequent."""
    words = [("see", 4000), ("sec", 60), ("cat", 50), ("eat", 40), ("on", 9000), ("ori", 1)]
    got = {r.word: r.right for r in scans.corrections(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"sec": "see"}
