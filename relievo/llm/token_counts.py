"""Token counts of a unigram tokenizer: a count-only Viterbi over Aho-Corasick matches."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks, default_path
from .common import query, table, texts

#: Stands for a space inside pieces.
SPACE = "▁"
#: Fixed value: how far an unknown character scores below the worst piece.
UNKNOWN_BELOW = 10.0
#: Stretches that a worker remembers before it starts over; bounds its memory.
REMEMBERED = 1_000_000
#: Stretches longer than this are counted each time and not remembered.
LONG = 64


class Unigram:
    """Pieces and scores of a vocabulary file, matched by one automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.unknown = min(s for _, s in self.vocab) - UNKNOWN_BELOW
        self.find = ahocorasick.Automaton()
        score = dict(self.vocab)
        for piece, s in score.items():
            if piece:
                self.find.add_word(piece, (len(piece), s))
        self.find.make_automaton()
        self.bytes_known = all(f"<0x{b:02X}>" in score for b in range(256))
        #: Without pieces that go on after a space, the text falls apart before each word.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in score)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of a text whose spaces are marked already.

        The automaton gives all pieces that end at each character. best[i] and pieces[i] are score and
        piece count of the best way to the first i characters. Tie rule: of ways with equal score the
        one whose last piece starts first stays. A character that is no piece itself may be taken
        as unknown, after all pieces; unknown characters count their bytes, or, without byte pieces,
        one for each run.
        """
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.find.iter(text):
            ends[end].append(match)
        best, pieces, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            top, count, alone = None, 0, False
            for size, score in sorted(ends[i - 1], reverse=True):
                at = i - size
                if top is None or best[at] + score > top:
                    top, count = best[at] + score, pieces[at] + 1
                alone = alone or size == 1
            if not alone and (top is None or best[i - 1] + self.unknown > top):
                top, unk[i] = best[i - 1] + self.unknown, True
                if self.bytes_known:
                    count = pieces[i - 1] + len(text[i - 1].encode("utf-8", "surrogatepass"))
                else:
                    count = pieces[i - 1] + (not unk[i - 1])
            best[i], pieces[i] = top, count
        return pieces[n]

    def stretches(self, text: str) -> list[str]:
        """The marked text, cut before each space that a non-space precedes."""
        words = text.split(" ")
        if "" in words[1:]:  # runs of spaces are pieces of their own: keep each run with what follows
            out, held = [], SPACE + words[0]
            for w in words[1:]:
                if held.strip(SPACE):
                    out.append(held)
                    held = ""
                held += SPACE + w
            return [*out, held]
        return [SPACE + w for w in words]

    def counts(self, values: list[str]) -> list[int]:
        """Token counts of texts. A space goes before a text, and an empty text has no tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for t in values:
            if not t:
                out.append(0)
                continue
            total = 0
            for s in self.stretches(t) if self.apart else [SPACE + t.replace(" ", SPACE)]:
                c = known.get(s)
                if c is None:
                    c = self.count(s)
                    if len(s) <= LONG:
                        known[s] = c
                total += c
            out.append(total)
        return out


@lru_cache(maxsize=4)
def unigram(path: str) -> Unigram:
    return Unigram(path)


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens of every whole text, without making the tokens.

    The vocabulary file's pieces and scores are taken as a unigram model: the segmentation with the
    highest sum of scores counts, by double arithmetic from the left. Its scores are whole numbers, so
    sums are exact and the count of a text is the sum over its words, which workers remember.
    Map-only; one row in, one row out. NULL or empty text: 0 tokens.
    Returns key, n_chars, n_tokens.
    """
    path = path or default_path("piece_bpe_32k.model")

    def work(batches):
        u = unigram(path)
        for pdf in batches:
            t, at = pdf["t"].tolist(), 0
            for part in chunks(t):
                yield pd.DataFrame({"d": pdf["d"].iloc[at:at + len(part)].tolist(), "n_chars": [len(x) for x in part],
                                    "n_tokens": u.counts(part)})
                at += len(part)

    rows = texts(docs, key, text).withColumn("d", F.col("d").cast("string"))
    return rows.mapInPandas(work, "d string, n_chars long, n_tokens long").select(
        F.col("d").cast("long").alias(key), "n_chars", "n_tokens")


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
