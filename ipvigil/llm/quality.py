"""Quality rules: counts over the text, then a hashed n-gram likelihood ratio between trusted texts and the whole corpus.

Features are the words (runs of anything but white space) and word pairs of a text, hashed by CRC-32 into BUCKETS. Two
multinomials over the buckets are counted, both with one added everywhere: that of all texts, and that of the trusted ones.
A bucket's weight is floor(10^6 ln(p_trusted / p_all)); a text's score is the sum of its features' weights by their
number, in thousandths, rounded down. All of it is whole numbers, so results do not depend on the order of rows. A text is
kept if it does not fail the base rules and scores at least as high as all but TAIL of the trusted texts.

Everything is column functions and one grouping by bucket, combined on the map side; no Python runs on the texts. Windows are told apart by 64-bit hashes within their text.

Every labelled id of quality 1 is trusted, however many there are. They meet the texts in a join on the id, which costs one
shuffle of the texts at any size. The BUCKETS weights are sent to all tasks.

Defined results: a null text has no words and fails; a null doc_id is not trusted; rows that repeat an id are rows of
their own; with no trusted text at hand every text that passes the base rules is kept; extra columns pass unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.llm.frames import cut_lineage, free_name

BUCKETS = 1 << 14
#: The check's SQL trusts so many ids at most; the operator has no such limit.
TRUSTED = 1 << 16
#: One trusted text in so many may score below the threshold.
TAIL = 100
WINDOW = 8
LEAST_WORDS = 20
#: Percent of words in repeated windows that is still allowed.
REPEATED = 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_WHITE = r"\\x20\\x09-\\x0D"
#: Places (from 0) of the windows that occur twice or more, ascending: sorted by hash, equal neighbours kept.
_PLACES = """
transform(array(sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))), s ->
  sort_array(transform(filter(s, (p, i) -> p.h = get(s, i + 1).h OR p.h = get(s, i - 1).h), p -> p.i)))[0]"""
_COVERED = f"""
transform(array({_PLACES}), at ->
  aggregate(transform(at, (p, i) -> CAST(least(coalesce(get(at, i + 1) - p, {WINDOW}), {WINDOW}) AS BIGINT)), 0L, (a, b) -> a + b))[0]"""


def _words(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(row, t, words): the kept columns as one, the text without null, its words."""
    given = F.coalesce(F.col(text), F.lit(""))
    split = F.array_remove(F.split(given, rf"[{_WHITE}]+".replace("\\\\", "\\")), "")
    return docs.select(F.struct(*keep).alias("row"), given.alias("t"), split.alias("words"))


def _features() -> Column:
    """Buckets of all words and pairs of neighbours."""
    return F.expr(f"""concat(
      transform(words, w -> CAST(crc32(CAST(w AS BINARY)) % {BUCKETS} AS INT)),
      CASE WHEN size(words) < 2 THEN CAST(array() AS ARRAY<INT>) ELSE transform(sequence(0, size(words) - 2), i ->
        CAST(crc32(CAST(concat(get(words, i), ' ', get(words, i + 1)) AS BINARY)) % {BUCKETS} AS INT)) END)""")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, trusted): the distinct ids of labelled rows of quality 1."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    return ids.withColumn("trusted", F.lit(True))


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, one column: the weight of every bucket, in order."""
    # joined before the texts are split: words are several times their size
    marked = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).join(trusted.hint("merge"), "id", "left")
    rows = _words(marked, ["trusted"], "t").select("row.trusted", F.explode(_features()).alias("bucket"))
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    n, good = (F.coalesce(c, F.lit(0)).cast("double") for c in ("n", "good"))
    both = every.join(found, "bucket", "left").select("bucket", n.alias("n"), good.alias("good"))
    listed = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "good"))).alias("b"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
    return listed.select(F.expr(f"""transform(b, x -> CAST(floor(1000000 * ln(
      ((x.good + 1) / (all_good + {BUCKETS})) / ((x.n + 1) / (all_n + {BUCKETS})))) AS BIGINT))""").alias("weights"))


def measured(docs: DataFrame, keep: list[str], weight: DataFrame, text: str = "text") -> DataFrame:
    """`row` (the kept columns), COUNTS, `base_failed` and `score` (null without words) of every text."""
    rows = _words(docs, keep, text)
    hashes = f"CASE WHEN size(words) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END"
    lines = f"filter(split(t, '\\n'), x -> x RLIKE '[^{_WHITE}]')"
    # the weights as a column: a subquery may not stand inside a lambda
    rows = rows.select(
        "row", "t", "words", F.expr(hashes).alias("hashes"), F.expr(lines).alias("lines"), _features().alias("features"),
        weight.scalar().alias("weights"),
    )
    summed = F.aggregate("features", F.lit(0).cast("long"), lambda total, bucket: total + F.get("weights", bucket))
    rows = rows.select(
        "row", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.expr("CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN {_COVERED} ELSE 0L END").alias("n_repeat_words"),
        F.when(F.size("features") > 0, F.floor(summed.cast("double") / (1000 * F.size("features")))).alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def threshold(scores: DataFrame, tail: int = TAIL) -> DataFrame:
    """One row, one column: the smallest score such that at most 1 in `tail` of the rows score below; null for no rows.

    Scores are thousandths between +-ln(rows) * 1000, so the frame that is ordered in one task has a bounded number of rows.
    """
    counted = scores.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"))
    running = counted.select("score", F.expr("sum(n) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING)").alias("upto"), F.expr("sum(n) OVER ()").alias("total"))
    return running.filter(F.col("upto") > F.floor(F.col("total") / tail)).agg(F.min("score").alias("score"))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns in `keep` (all by default), COUNTS, `base_failed`, `score` and `kept` for every row of `docs`."""
    keep = docs.columns if keep is None else keep
    trusted = trusted_ids(labels)
    with_id = docs.withColumn(own := free_name(docs, "trusted_by"), F.col(doc_id).cast("long"))
    made = cut_lineage(measured(with_id, [*keep, own], weights(docs, trusted, text, doc_id), text), "quality")
    good = made.filter("NOT base_failed").select(F.col("row")[own].alias("id"), "score").join(trusted, "id", "left_semi")
    limit = threshold(good).scalar()
    above = ~F.col("base_failed") & F.coalesce(F.col("score") >= limit, F.lit(True))
    names = {c: free_name(docs, c) for c in [*COUNTS, "base_failed", "score", "kept"]}
    made = made.withColumn("kept", above)
    return made.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col(c).alias(n) for c, n in names.items()])


def kept(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    made = judged(docs, labels, None, text, doc_id)
    return made.filter(F.col(made.columns[-1])).select(*docs.columns)
