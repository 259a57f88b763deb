"""Filling fixed-capacity containers with documents along a Hilbert curve."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectloom.plans.runtime import cut

CAPACITY = 4096
#: Hashed features of a document, axes they are projected to, and bits of each axis.
FEATURES, AXES, BITS = 256, 3, 10
#: Containers that stay open while a stretch of the curve is packed.
OPEN = 64
#: Tokens in one stretch of the curve: one task's work.
STRETCH_TOKENS = 4_000_000


def load_tokenizer(path: str | None = None):
    """The byte-level BPE in ``path`` (ranks of a .tiktoken file); by default the public 50k vocabulary installed with the machine."""
    import base64

    import tiktoken

    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    else:
        # fixed value: the split pattern of byte-level BPE vocabularies
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point of an integer grid along the Hilbert curve (Skilling's transform, all points at once)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    """Fixed directions of the axes: signs from a hash of (feature, axis)."""
    f, a = np.meshgrid(np.arange(FEATURES, dtype=np.uint64), np.arange(AXES, dtype=np.uint64), indexing="ij")
    z = (f * np.uint64(0x9E3779B97F4A7C15) + a * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    return np.where((z >> np.uint64(13)) & np.uint64(1), 1.0, -1.0) / np.sqrt(FEATURES)


def measured(docs: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens, curve): length in tokens and place on the Hilbert curve of the hashed token vector.
    Null and empty texts have no tokens and give no row."""
    kind = docs.schema[key].dataType.simpleString()

    def work(it):
        enc, proj = load_tokenizer(tokenizer), projection()
        for pdf in it:
            n, vec = [], np.zeros((len(pdf), FEATURES), np.float32)
            for i, x in enumerate(pdf._x):
                ids = enc.encode_to_numpy(x, disallowed_special=())
                n.append(len(ids))
                v = np.bincount(ids % FEATURES, minlength=FEATURES)
                vec[i] = np.sqrt(v)
            norm = np.linalg.norm(vec, axis=1, keepdims=True)
            y = (vec / np.maximum(norm, 1e-9)) @ proj
            grid = np.clip((y + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pd.DataFrame({key: pdf._k, "n_tokens": np.array(n, np.int64), "curve": hilbert(grid, BITS)})

    src = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).filter(F.length("_x") > 0)
    return src.mapInPandas(work, f"{key} {kind}, n_tokens long, curve long").filter("n_tokens > 0")


class Filler:
    """Open containers of a stretch: an item goes to the one it fits most tightly, else to a new one;
    when too many are open, the fullest is closed."""

    def __init__(self, capacity: int, open_at_once: int = OPEN):
        self.capacity, self.most, self.n = capacity, open_at_once, 0
        self.free: list[tuple[int, int]] = []  # (room, container), sorted

    def put(self, size: int) -> int:
        i = bisect.bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, c = self.free.pop(i)
        else:
            room, c = self.capacity, self.n
            self.n += 1
            if len(self.free) >= self.most:
                self.free.pop(0)
        if room > size:
            bisect.insort(self.free, (room - size, c))
        return c


def pack(docs: DataFrame, key: str, text: str, *, capacity: int = CAPACITY, tokenizer: str | None = None, stretch_tokens: int = STRETCH_TOKENS) -> DataFrame:
    """(container, key, piece_no, first_token, n_tokens, n_pieces): every document in containers of ``capacity`` tokens.

    Only a document that exceeds the capacity by itself is split: into full pieces, each alone in a
    container, and a rest that is packed like a short document. Documents are sorted by their place
    on a Hilbert curve through hashed token vectors (ties by a hash of the key, so that many copies
    of one text spread over tasks), and each stretch of the curve is packed by itself, most tightly
    fitting open container first. Null and empty texts are in no container. Rows with a repeated key
    are packed as items of their own.
    """
    kind = docs.schema[key].dataType.simpleString()
    m = cut(measured(docs, key, text, tokenizer), "tokens")
    total = m.agg(F.sum("n_tokens")).first()[0] or 0
    pieces = m.withColumn("n_pieces", F.ceil(F.col("n_tokens") / capacity).cast("int")).select(
        key, "curve", "n_pieces", F.col("n_tokens").alias("_all"), F.explode(F.expr("sequence(0, n_pieces - 1)")).alias("piece_no")
    )
    pieces = pieces.select(
        key, "curve", "n_pieces", "piece_no", (F.col("piece_no").cast("long") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("piece_no").cast("long") * capacity).alias("n_tokens"),
    )
    stretches = max(1, -(-int(total) // stretch_tokens))
    spread = pieces.withColumn("_h", F.xxhash64(key, "piece_no")).repartitionByRange(stretches, "curve", "_h").sortWithinPartitions("curve", "_h")

    def work(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        filler = Filler(capacity)
        for pdf in it:
            out = [filler.put(int(x)) for x in pdf.n_tokens]
            yield pd.DataFrame({"container": (np.int64(part) << 40) + np.array(out, np.int64), key: pdf[key], "piece_no": pdf.piece_no, "first_token": pdf.first_token, "n_tokens": pdf.n_tokens, "n_pieces": pdf.n_pieces})

    # written, so that numbers stay as they are although a lost partition is made again
    return cut(spread.mapInPandas(work, f"container long, {key} {kind}, piece_no int, first_token long, n_tokens long, n_pieces int"), "containers")
