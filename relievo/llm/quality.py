"""Quality rules: text statistics, and a likelihood ratio between a trusted part and the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, query, stored, table, texts

#: Buckets that n-grams are hashed into. The two count tables and the weights have this many rows.
BUCKETS = 1 << 16
#: Most trusted documents that the target counts are fitted on (a bounded sample of the labelled rows).
TRUSTED = 20_000
#: Verdict: kept from this mean log ratio per n-gram on. ln(1/2): n-grams half as likely as in the corpus.
THRESHOLD = -0.6931
#: Weights are whole numbers of a millionth, so that sums do not depend on their order.
UNIT = 1_000_000
SYMBOLS = "#*$%&|<>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The words of `t`, as SQL.
WORDS_SQL = "filter(split(t, '" + GAP.replace("\\", "\\\\") + "'), x -> x <> '')"
#: Buckets of the n-grams of words `w`: over the last three letters of each word, n = 1 and 2.
GRAMS_SQL = _let("transform(w, x -> right(x, 3))", "e", f"""concat(
    transform(e, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int)),
    if(size(e) < 2, cast(array() as array<int>),
       transform(sequence(0, size(e) - 2), i -> cast(pmod(xxhash64(e[i], e[i + 1]), {BUCKETS}) as int))))""")
#: Positions of words `w` in three-word windows that occur twice or more: equal neighbours after sorting.
REPEATED_SQL = _let(
    "sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))", "g",
    """size(array_distinct(flatten(transform(
        filter(g, (x, k) -> (k > 0 and g[k - 1].h = x.h) or (k < size(g) - 1 and g[k + 1].h = x.h)),
        x -> array(x.i, x.i + 1, x.i + 2)))))""")
#: Lines with a word that equal an earlier line.
LINES_SQL = _let("filter(split(t, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "l", "size(l) - size(array_distinct(l))")


def gram_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(b, weight): log ratio of each bucket between trusted documents and the whole corpus, in UNITs.

    Corpus counts cover all documents of `docs` (d, t). Target counts come from the documents named in
    `trusted` (d), of which at most TRUSTED are used, those with the smallest digests; that table is the
    only thing broadcast besides. Both multinomials are smoothed by one count per bucket. Counting
    aggregates before it shuffles: a task sends at most one row per bucket, however frequent an
    n-gram is. Without trusted documents all weights are 0.
    """
    named = trusted.distinct().orderBy(F.xxhash64("d"), "d").limit(TRUSTED).withColumn("good", F.lit(1))
    rows = docs.join(F.broadcast(named), "d", "left")
    grams = F.explode(F.expr(_let(WORDS_SQL, "w", GRAMS_SQL)))
    counts = rows.select(grams.alias("b"), F.coalesce("good", F.lit(0)).alias("good")).groupBy("b").agg(
        F.count("*").alias("n"), F.sum("good").alias("m"))
    counts = stored(counts, "grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    if not total["m"]:
        return counts.select("b", F.lit(0).cast("long").alias("weight"))
    ratio = (F.log((F.col("m") + 1) / F.lit(float(total["m"] + BUCKETS))) - F.log((F.col("n") + 1) / F.lit(float(total["n"] + BUCKETS))))
    return counts.select("b", F.round(ratio * UNIT).cast("long").alias("weight"))


def assess(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
           trusted_key: str = "doc_id") -> DataFrame:
    """Text statistics and the verdict of every document.

    base_failed: fewer than 50 words, or more than half of the words lie in three-word windows that occur
    twice or more in the text. kept: not base_failed, and the mean log ratio of the document's hashed
    n-grams between trusted documents and the corpus is at least `threshold`.

    Only built-in functions: a first pass counts, a second one joins the n-grams with the weights (at most
    BUCKETS rows, broadcast) and adds up whole numbers per document before anything is shuffled.
    NULL, empty or wordless text: zero counts, score 0, base_failed. NULL identifier: never trusted.
    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, text_digest (xxhash64).
    """
    rows = texts(docs, key, text)
    named = trusted.select(F.col(trusted_key).alias("d")).where("d is not null")
    weights = gram_weights(rows, named)
    spaces = GAP.replace("\\", "\\\\")
    # `inline` hands out the fields of one struct, so every part is computed once per row.
    held = rows.select(F.monotonically_increasing_id().alias("row"), "d", F.xxhash64("t").alias("text_digest"), F.expr(f"""inline(array({_let(WORDS_SQL, "w", f'''struct(
        cast(size(w) as bigint) as n_words,
        cast(char_length(regexp_replace(t, '{spaces}', '')) as bigint) as word_chars,
        cast(char_length(t) - char_length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
        cast({LINES_SQL} as bigint) as n_dup_lines,
        cast(if(size(w) < 3, 0, {REPEATED_SQL}) as bigint) as n_repeat_words,
        {GRAMS_SQL} as f)''')}))"""))
    stats = ["d", "text_digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # The rows of a document lie together, so adding up leaves one row per document to shuffle.
    out = (held.select("row", *stats, F.explode_outer("f").alias("b")).join(F.broadcast(weights), "b", "left")
           .groupBy("row").agg(*[F.max(c).alias(c) for c in stats], F.sum("weight").alias("sum"), F.count("b").alias("grams"))
           .withColumn("score", F.coalesce(F.col("sum") / F.col("grams"), F.lit(0.0)) / UNIT).withColumnRenamed("d", key))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "text_digest")


def trusted_of(labels: DataFrame) -> DataFrame:
    """Identifiers of documents labelled as good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


@query("op6_quality_rules")
def op6(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"), trusted_of(table(spark, sf_dir, "labels"))).drop("text_digest")
