"""Byte-level BPE with a pair occurrence index, worked on the distinct pieces of a partition."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import query, table, texts

#: Fixed value: the split pattern of this public vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of stretches that a worker remembers before it starts over, and what each takes besides its letters and ids.
REMEMBERED, EACH = 128 << 20, 200


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by rank, pieces by id, and the pieces encoded so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array(x, "int64") for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs)))
        self.base = max(max(ids.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype("int64")
        self.left, self.right, self.made = left, right, made
        self.of_byte = np.zeros(256, "int64")
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.piece = {i: bytes(letters[c] for c in s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = a.astype("int64") * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_pieces(self, words: list[str]) -> list[bytes]:
        """Ids of every piece, as little-endian 32-bit integers, by merging all pieces together.

        One array holds the symbols of all pieces with links to the neighbours. The index maps each
        rank to the positions of its pair. Active ranks are applied in ascending order, each to all its
        positions at once; the two pairs that a merge creates are entered into the index. A position
        whose pair has changed meanwhile is passed over.
        """
        import heapq

        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], "int64")
        sym = self.of_byte[np.frombuffer(b"".join(raw), "uint8")].astype("int32")
        n = len(sym)
        if not n:
            return [b""] * len(words)
        after, before = np.arange(1, n + 1, dtype="int32"), np.arange(-1, n - 1, dtype="int32")
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        after[last[sizes > 0]] = n
        before[first[sizes > 0]] = -1
        sym = np.append(sym, np.int32(-1))  # what lies beyond the end of a piece
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at):
            at = at[(at >= 0)]
            at = at[after[at] < n]
            rank = self.rank_of(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        enter(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of one symbol, every other pair from the left
                at = np.sort(at)
                new_run = np.concatenate(([True], at[1:] != after[at[:-1]]))
                run_start = np.flatnonzero(new_run)
                nth = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
                at = at[nth % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.made[r]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            enter(np.unique(np.concatenate((at, before[at]))))
        kept = np.concatenate(([0], np.cumsum(alive)))
        out = sym[:-1][alive].astype("<u4").tobytes()
        lo, hi = kept[first] * 4, kept[first + sizes] * 4
        return [out[i:j] for i, j in zip(lo.tolist(), hi.tolist())]

    def cut(self, text: str) -> list[str]:
        """Pieces of a text; special strings stay whole.

        A cut before a space that a non-space follows never changes the pieces, so most texts fall
        apart into short stretches whose pieces are looked up, not matched again.
        """
        parts = self.specials.split(text) if self.specials else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            out.extend([part] if i % 2 else self.split.findall(part))
        return out

    def stretches(self, text: str) -> list[str]:
        """The text cut before every space that a non-space follows."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        out.append(held)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if self.known_bytes > REMEMBERED:
            self.known, self.known_bytes = {}, 0
        known = self.known
        cuts = [self.stretches(t) for t in texts]
        fresh = list({s for c in cuts for s in c if s not in known})
        pieces = [self.cut(s) for s in fresh]
        words = list({p for c in pieces for p in c if p not in self.special})
        ids = dict(zip(words, self.encode_pieces(words)))
        ids |= {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        for s, c in zip(fresh, pieces):
            known[s] = x = b"".join([ids[p] for p in c])
            self.known_bytes += len(s) + len(x) + EACH
        return [b"".join([known[s] for s in c]) for c in cuts]

    def decode(self, ids: bytes) -> str:
        """Text of a sequence of ids; special ids as their strings, broken UTF-8 as U+FFFD."""
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text that are encoded together; a longer text is a run of its own.
CHUNK_BYTES = 3 << 20


def chunks(values: list[str], limit: int = 4_000_000):
    """Consecutive runs of texts of about `limit` characters; a longer text is a run of its own."""
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parts(batch):
    """(first row, texts) of consecutive runs of rows with about CHUNK_BYTES, taken out of Arrow run by run."""
    for i, j in R.parts(R.text_column(batch, "t")[1], CHUNK_BYTES):
        yield i, batch.column("t").slice(i, j - i).to_pylist()


def _mapped(docs: DataFrame, path: str, key: str, text: str, back: bool) -> DataFrame:
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for at, part in _parts(batch):
                ids = v.encode(part)
                cols = {"d": batch.column("d").slice(at, len(part)), "ids": pa.array(ids, pa.binary())}
                if back:
                    cols["text"] = pa.array([v.decode(b) for b in ids], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    docs = texts(docs, key, text).withColumn("d", F.col("d").cast("long"))
    return docs.mapInArrow(run, "d long, ids binary" + ", text string" * back).withColumnRenamed("d", key)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: (key, ids) with ids as little-endian unsigned 32-bit integers.

    Text equal to a special token's string becomes that token, as the public library does by default.
    NULL text: no ids. Map-only: nothing is shuffled, one row in, one row out. A task holds one run of texts of
    about CHUNK_BYTES (or one longer text) and at most REMEMBERED bytes of stretches it has met.
    """
    return _mapped(docs, path or default_path("byte_bpe_50k.json"), key, text, False)


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, text): `encode` and `decode` in one pass of one worker, for the same rows."""
    return _mapped(docs, path or default_path("byte_bpe_50k.json"), key, text, True)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of token ids: (key, ids, text). NULL ids: empty text."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [v.decode(b or b"") for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("ids"), pa.array(found, pa.string())], ["d", "ids", "text"])

    df = encoded.select(F.col(key).cast("long").alias("d"), F.col(ids).alias("ids"))
    return df.mapInArrow(run, "d long, ids binary, text string").withColumnRenamed("d", key)


@query("op2_bpe_round_trip")
def op2(spark, sf_dir):
    done = round_trip(table(spark, sf_dir, "documents"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
