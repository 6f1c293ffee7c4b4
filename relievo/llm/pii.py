"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

#: Kinds in the order of output.
KINDS = ["email", "ip", "card", "phone", "id", "name"]
# Patterns by name: (kind, part of the base, pattern, a cheap condition that any match implies).
# Base patterns start where a run starts or the last match ended, and use possessive loops; that changes
# no match and keeps long runs linear.
PATTERNS = {
    "email": ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    "ip": ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t rlike '[0-9][.][0-9]'"),
    "card": ("card", True, r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9][ -]?[0-9]'"),
    "phone": ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
    "spelled": ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+", "t rlike '[(\\\\[]at[)\\\\]]'"),
    "national": ("phone", False, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "t rlike '[0-9]{3}[)]?[ .-][0-9]{3}[ .-]'"),
    "social": ("id", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]-[0-9]{2}-[0-9]'"),
    "titled": ("name", False, r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?", "t rlike '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra)[.]? '"),
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co ai dev app eu uk de fr es it nl be ch at pl pt se no dk fi ie us ca mx br ar cl au nz jp kr cn in ru za".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 358 380 420 421".split()
GIVEN_NAMES = "james john robert michael david mary anna maria elena laura peter paul hans jürgen klaus karl sabine monika petra jean pierre marie claire sophie luc antoine carlos juan josé luis carmen lucía pablo thomas daniel martin sarah emma julia".split()
# Words right before a span that speak for or against personal data.
FOR = "e-?mail|mail|contact|contacto|kontakt|write to|reach|tel|telephone|phone|mobile|call|fax|card|visa|mastercard|account|ip|address|adresse|host|ssn|name"
AGAINST = "version|ver|isbn|issn|issue|page|seite|chapter|section|order|ticket|build|rfc|number|no|nr|figure|table|id"
#: Characters of text before a span that the context labeler sees.
BEFORE = 40
LABELERS = ("r", "g", "c")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits_sql() -> str:
    """All matches of all patterns in `t`, each with the text between it and the match before."""
    arrays = []
    for name, (_, _, pattern, needs) in PATTERNS.items():
        p = _lit(pattern)
        arrays.append(f"""if({needs}, transform(array(split(t, {p}, -1)), p -> transform(regexp_extract_all(t, {p}, 0), (m, i) -> struct(
            '{name}' as pat, i as nth, length(p[i]) as gap, right(p[i], {BEFORE}) as before, left(p[i + 1], 1) as after, m as hit)))[0],
            cast(array() as array<struct<pat: string, nth: int, gap: int, before: string, after: string, hit: string>>))""")
    return "concat(" + ", ".join(arrays) + ")"


def _checked(hits: DataFrame) -> DataFrame:
    """Hits with positions in code points, `valid` for base rules, and the votes (1, 0, -1 for none)."""
    so_far = Window.partitionBy("row", "pat").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size, digits, low = F.char_length("hit"), F.regexp_replace("hit", "[^0-9]", ""), F.lower("hit")
    rows = (hits.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
            .withColumn("digits", digits).withColumn("low", low))
    n, pat = F.length("digits"), F.col("pat")
    valid = (F.when(pat == "email", True).when(pat == "ip", F.col("hit").rlike(f"^{OCTET}(?:[.]{OCTET}){{3}}$"))
             .when(pat == "card", n.between(13, 19) & F.when(n.between(13, 19), F.expr("luhn_check(digits)")).otherwise(False))
             .when(pat == "phone", n.between(9, 15)).otherwise(False))
    strict = (F.when(pat.isin(*[k for k, v in PATTERNS.items() if v[1]]), F.col("valid"))
              .when(pat == "spelled", F.col("low").rlike("at[)\\]]")).when(pat == "national", F.col("hit").rlike("^(?:[(][0-9]{3}[)] |[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}$"))
              .otherwise(True))
    tail, lead = F.regexp_extract("low", "([a-z]+)$", 1), F.regexp_extract("low", "[.]? +(\\p{L}+)", 1)
    area = F.substring("digits", 1, 3)
    listed = (F.when(pat.isin("email", "spelled"), tail.isin(*DOMAINS))
              .when(pat == "ip", ~F.col("hit").rlike("^(?:0|10|127|255|169[.]254|192[.]168)[.]"))
              .when(pat == "card", F.col("digits").rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"))
              .when(pat == "phone", F.substring("digits", 1, 1).isin(*COUNTRY_CODES) | F.substring("digits", 1, 2).isin(*COUNTRY_CODES) | area.isin(*COUNTRY_CODES))
              .when(pat == "national", area.rlike("^[2-9]")).when(pat == "social", ~area.rlike("^(?:000|666|9)"))
              .otherwise(F.when(lead.isin(*GIVEN_NAMES), True)))
    said = F.lower("before")
    context = F.when(said.rlike(f"(?:^|[^a-z])(?:{FOR})[^a-z]{{0,4}}$"), 1).when(said.rlike(f"(?:^|[^a-z])(?:{AGAINST})[^a-z]{{0,3}}$"), 0).otherwise(-1)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return (rows.withColumn("r", F.coalesce(strict.cast("int"), F.lit(-1))).withColumn("g", F.coalesce(listed.cast("int"), F.lit(-1)))
            .withColumn("c", context)
            .withColumn("open", (F.col("before").rlike("\\s$") | (F.col("before") == "")).cast("int"))
            .withColumn("closed", (F.col("after").rlike("^[\\s.,;:!?)]") | (F.col("after") == "")).cast("int"))
            .withColumn("long", (size >= 12).cast("int")))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation over vote patterns (pattern name, votes, count).

    Each labeler has a hit rate and a false-alarm rate, each pattern a share of true spans; all start at
    plain guesses and are re-estimated with a few pseudo-counts until they settle. Returns the chance that
    each row is personal data, and the rates.
    """
    hit, wrong = [0.8] * len(LABELERS), [0.2] * len(LABELERS)
    share = {p: 0.5 for p, _, _ in patterns}
    chance = []
    for _ in range(rounds):
        chance = []
        for p, votes, _ in patterns:
            yes, no = share[p], 1 - share[p]
            for v, h, w in zip(votes, hit, wrong):
                if v >= 0:
                    yes, no = yes * (h if v else 1 - h), no * (w if v else 1 - w)
            chance.append(yes / (yes + no))
        for i in range(len(LABELERS)):
            seen = [(q, v[i], n) for q, (_, v, n) in zip(chance, patterns) if v[i] >= 0]
            hit[i] = (4 + sum(q * n for q, v, n in seen if v)) / (5 + sum(q * n for q, _, n in seen))
            wrong[i] = (1 + sum((1 - q) * n for q, v, n in seen if v)) / (5 + sum((1 - q) * n for q, _, n in seen))
        for p in share:
            own = [(q, n) for q, (x, _, n) in zip(chance, patterns) if x == p]
            share[p] = (1 + sum(q * n for q, n in own)) / (2 + sum(n for _, n in own))
    return chance, {"hit": hit, "wrong": wrong, "share": share}


def train(rows: list[tuple[dict[str, float], float, float]], rounds: int = 200) -> dict[str, float]:
    """Logistic regression on (features, soft label, weight), by accelerated gradient steps."""
    names = sorted({f for x, _, _ in rows for f in x})
    total = sum(w for _, _, w in rows)
    weight, speed = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for _ in range(rounds):
        step = {f: -1e-3 * weight[f] for f in names}
        for x, label, w in rows:
            z = max(-30.0, min(30.0, sum(weight[f] * v for f, v in x.items())))
            d = (label - 1 / (1 + math.exp(-z))) * w / total
            for f, v in x.items():
                step[f] += d * v
        for f in names:
            speed[f] = 0.9 * speed[f] + 0.5 * step[f]
            weight[f] += speed[f]
    return weight


def _present(row) -> dict[str, float]:
    """Features of a counted row: its pattern, its votes and the shape of its borders."""
    x = {"pat " + row["pat"]: 1.0, "all": 1.0}
    x |= {f"{v}{row[v]}": 1.0 for v in LABELERS if row[v] >= 0}
    return x | {f: 1.0 for f in ("open", "closed", "long") if row[f]}


def _classifier(checked: DataFrame):
    """Score column (log odds) of the trained classifier.

    Spans count by pattern, votes and shape: at most 8 x 27 x 8 rows, however many documents there are.
    """
    cols = ["pat", *LABELERS, "open", "closed", "long"]
    counted = checked.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(*cols).collect()
    if not counted:
        return F.lit(-1.0)
    chance, _ = estimate([(r["pat"], tuple(r[v] for v in LABELERS), r["n"]) for r in counted])
    weight = train([(_present(r), q, float(r["n"])) for r, q in zip(counted, chance)])
    score = F.lit(weight.get("all", 0.0))
    for f, w in weight.items():
        if f.startswith("pat "):
            score = score + F.when(F.col("pat") == f[4:], w).otherwise(0.0)
        elif f in ("open", "closed", "long"):
            score = score + F.col(f) * w
        elif f != "all":
            score = score + F.when(F.col(f[0]) == int(f[1:]), w).otherwise(0.0)
    return score


def _found(rows: DataFrame) -> DataFrame:
    """(row, kind, k, start, end, base, score): spans of stored rows (row, hits), base ones and added ones.

    A match of the base patterns stands if it passes its check; one that fails only teaches the
    labelers' reliabilities. Another candidate is added if the classifier's odds are even or better
    and it overlaps no base span.
    """
    kinds = F.create_map(*[F.lit(x) for name, v in PATTERNS.items() for x in (name, v[0])])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    hits = rows.select("row", F.inline("hits"))
    checked = stored(_checked(hits).drop("before", "after", "hit", "digits", "low", "gap", "nth"), "spans")
    named = (checked.withColumn("score", _classifier(checked)).withColumn("kind", kinds[F.col("pat")])
             .withColumn("k", order[F.col("kind")])
             .where(F.col("valid") | (~F.col("pat").isin(*[k for k, v in PATTERNS.items() if v[1]]) & (F.col("score") >= 0))))
    line = Window.partitionBy("row").orderBy("start", F.desc("valid"), "end", "k")
    past = F.max(F.when(F.col("valid"), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("valid"), F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    clear = ~F.coalesce(F.col("past") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("ahead") < F.col("end"), F.lit(False))
    free = named.withColumn("past", past).withColumn("ahead", ahead).where(F.col("valid") | clear)
    return free.select("row", "kind", "k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                       F.col("valid").alias("base"), "score").distinct()


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text: one row per document with its spans.

    Candidates come from patterns. Three labelers vote on each: the pattern's own check (form, checksum,
    number of digits), gazetteers (domains, country codes, issuers, given names) and the words before it.
    Expectation-maximisation over the counts of all vote patterns estimates how reliable the labelers
    are; a logistic classifier is trained on the resulting chances. Base matches always stand.

    Built-in functions only: a map over the texts, a window over the (few) matches of a document, and
    small aggregates. Positions are code points, ends exclusive. NULL or empty text: no spans.
    Repeated rows are searched each by itself; identifiers are only carried along.
    Returns key, spans array of (kind, start, end, base, score) ordered by kind, then start.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("d"), t.alias("t"))
                  .select("row", "d", F.expr(_hits_sql()).alias("hits")), "hits")
    span = F.struct("k", "start", "end", "kind", "base", "score")
    spans = _found(rows).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.expr("cast(array() as array<struct<k: int, start: bigint, end: bigint, kind: string, base: boolean, score: double>>)")
    return rows.select("row", "d").join(spans, "row", "left").select(F.col("d").alias(key), F.coalesce("spans", none).alias("spans"))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with every span of personal data replaced by its kind in brackets, as in [EMAIL].

    Overlapping spans are one, named after the first. All other columns stay; a NULL text stays NULL.
    """
    kept = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "redact")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hits = stored(kept.select(F.col("__row").alias("row"), t.alias("t")).select("row", F.expr(_hits_sql()).alias("hits")), "hits")
    line = Window.partitionBy("row").orderBy("start", "end", "k")
    past = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce((F.col("past") <= F.col("start")).cast("int"), F.lit(1))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    whole = (_found(hits).withColumn("past", past).withColumn("island", island).groupBy("row", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "k")).alias("kind")))
    spans = whole.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    # Each part is the text from the end of the span before, then the placeholder.
    cut = F.expr(f"""if(__spans is null, `{text}`, concat(
        array_join(transform(__spans, (s, i) -> concat(
            substring(`{text}`, cast(if(i = 0, 0, __spans[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, __spans[i - 1].end) as int)),
            '[', upper(s.kind), ']')), ''),
        substring(`{text}`, cast(element_at(__spans, -1).end as int) + 1)))""")
    return kept.join(spans, "__row", "left").withColumn(text, cut).select(*docs.columns)


@query("op1_pii")
def op1(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))

    def joined(which):
        return F.array_join(F.transform(F.filter("spans", which), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(lambda s: s["base"]), 256).alias("base_sha256"),
                        joined(lambda s: F.lit(True)).alias("spans"))
