"""Plain single-machine versions of the operators, and small documents with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sample_docs():
    """(doc_id, text): NULLs, empty and very long texts, ties, repeated rows, copies and shared passages."""
    rng = random.Random(5)
    vocab = [a + b for a in ("the", "on", "re", "ñu", "éa", "st", "li") for b in ("", "an", "or", "sh", "ö", "x", "ed")]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    long = prose(300)
    passage = prose(90)
    near = prose(200).split(" ")
    edited = near[:]
    edited[50] = "changed"
    other = near[:]
    other[120:124] = ["quite", "new", "words", "here"]
    docs = [(i, prose(rng.randrange(1, 120))) for i in range(1, 13)]
    docs += [
        (20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, "one two three four"), (25, "one two three four five"),
        (26, "One TWO three four"), (30, long), (31, long), (32, long.upper()), (40, " ".join(near)), (41, " ".join(edited)),
        (42, " ".join(other)), (50, prose(30) + " " + passage + " " + prose(20)), (51, passage + "\n" + prose(40)),
        (52, prose(10) + " " + passage), (53, passage + " " + passage), (60, "a " * 900), (61, "b" * 5000), (62, "ab" * 900 + " tail"),
        (63, "é" * 700 + "x" + "é" * 700), (70, "<|endoftext|> and <|startoftext|> text  with   gaps\r\n\n and   odd　spaces 日本語 \U0001F600"),
        (71, "same row twice " * 30), (71, "same row twice " * 30), (73, long[::-1]), (73, long[::-1]), (72, "x\ny\nx\n\n \nx"), (None, "no name " + prose(60)), (None, None),
        (80, "mail bob.x@mail.example.com now, bob@x, a@b.c_d@e.f; call +1 (988) 555-2485 or +1 2; ip 42.144.35.254 or 300.1.1.1, 1.2.3.4.5"),
        (81, "card 4539 1488 0343 6467 and 4539148803436468, 12345678901234567890; phone: (988) 555-2485; SSN 123-45-6789. Dear Dr. Anna Smith,"),
        (82, "##$$ junk*** " * 30), (83, " ".join(f"w{i}" for i in range(9000))), (84, "same id, first text"), (84, "same id, second text"),
    ]
    return docs


def clashing(spark, docs):
    """The documents with columns whose names the operators use inside."""
    rows = [(i, t, "x", f"s{n % 3}" if n % 7 else None, 1, 2, 3, "z") for n, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, source string, d long, tv long, row int, hits string")


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words((t or "").translate(UPPER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    """Index of the class of each set: linked by a Jaccard similarity of 0.8 or more, or equal and not empty."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    shared = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            shared[g].append(i)
    both = Counter()
    for group in shared.values():
        both.update((a, b) for n, b in enumerate(group) for a in group[:n])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(sets))]


def word_repeats(docs, k=20):
    """{(id, text): (words, removed, digest of the rest)}; NULL identifiers first."""
    order = sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    first, out = {}, {}
    for n, (_, t) in enumerate(order):
        w = words(t)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i:i + k]), (n, i))
    for n, (d, t) in enumerate(order):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] != (n, i):
                gone[i:i + k] = [True] * k
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, t] = len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest()
    return out


def byte_repeats(docs, k=400):
    """{(id, text): (bytes, removed, runs, digest of the rest)}."""
    raw = {x: (x[1] or "").encode() for x in set(docs)}
    seen = Counter(b[i:i + k] for b in raw.values() for i in range(len(b) - k + 1))
    out = {}
    for x, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if seen[b[i:i + k]] > 1:
                gone[i:i + k] = b"\1" * k
        rest = bytes(c for c, g in zip(b, gone) if not g)
        out[x] = len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_pii(t):
    """(kind, start, end) by kind, then start."""
    def digits(m):
        return re.sub("[^0-9]", "", m)

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m[0])]


def quality(t):
    t = t or ""
    w = words(t)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
            len(w) < 50 or 100 * len(again) > 50 * len(w))


def crc(ids):
    return zlib.crc32(ids)
