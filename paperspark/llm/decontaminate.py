"""Benchmark decontamination by spaced-seed hashing, with Spark expressions only.

Fixed masks pick some positions of every run of words and ignore the others,
so a hash of the picked words survives substitutions at ignored positions.
Hashes of the documents are joined to those of the benchmark; around each hit
the whole item is laid over the document at that offset and equal words are
counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperspark.llm.common import BROADCAST_ROWS, LOWER, UPPER, ascii_lower, join_by_id, staged, word_array

# Positions that a mask of the SQL form picks; each covers SPAN words. The SQL
# form finds less than the operator, which uses the masks below.
MASKS = ("111010011011", "110110101011", "101101110011")
SPAN = 12
# Masks of the operator. Of items of at least SPAN words every pattern of
# LEAST_SHARE equal words holds one of SEED_MASKS at some place (enumerated in
# the tests); shorter items need masks of fewer words.
SEED_MASKS = ("1111", "11101", "11011", "10111", "111001", "110101", "100111", "1110001")
SHORT_MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
# An item of fewer words than this says too little to be sought.
LEAST_WORDS = 5
# An overlap counts if so much of the item, or so many words of a longer
# item, are equal at one offset.
LEAST_SHARE = 0.6
LEAST_EQUAL = 20
MARKS = ".,;:!?\"'()[]{}«»“”’‘…¿¡"


def plain_words(text: Column) -> Column:
    """Lower-cased (A-Z) words without punctuation marks."""
    return word_array(F.translate(ascii_lower(text), MARKS, ""))


def with_seeds(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """``keep, pos, seed`` for every mask at every position of the word hashes
    ``h`` where the mask fits."""
    n, least = F.size("h"), min(map(len, masks))
    # A mask that reaches beyond the last word has no seed.
    seeds = F.array(*[F.when(F.col("pos") + len(mask) <= n, F.xxhash64(F.lit(mask), *[
        F.get("h", F.col("pos") + k) for k, c in enumerate(mask) if c == "1"])) for mask in masks])
    found = rows.where(n >= least).select(*keep, "h", F.explode(F.sequence(F.lit(0), n - least)).alias("pos"))
    return found.select(*keep, "pos", F.explode(seeds).alias("seed")).where("seed IS NOT NULL")


def hashed(text: Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, offset, n_equal, n_item`` for every document and item
    that overlap: the offset of the item in the document's words with most
    equal words (the least of several).

    Null and empty texts overlap with nothing; neither do items of fewer than
    ``LEAST_WORDS`` words. Ids that repeat are reported once, with the best of
    their rows. Rows without an id and other columns are ignored. The seeds of
    the benchmark are broadcast if counted to be few; else both sides are
    shuffled, and hot seeds split by adaptive execution.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    items = staged(benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.col(item_text_col)).alias("words"))
                   .where((F.size("words") >= LEAST_WORDS) & F.col("item_id").isNotNull()), "items")
    item_h = items.select("item_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    seeds = with_seeds(item_h.where(F.size("h") >= SPAN), ["item_id"], SEED_MASKS).unionByName(
        with_seeds(item_h.where(F.size("h") < SPAN), ["item_id"], SHORT_MASKS))
    seeds = staged(seeds.select("seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "seeds")
    few = seeds.count() <= BROADCAST_ROWS
    # Short masks cost their share of the seeds only if there is a short item.
    masks = SEED_MASKS + (SHORT_MASKS if items.where(F.size("words") < SPAN).limit(1).count() else ())
    doc_seeds = with_seeds(docs.select("doc_id", hashed(F.col("text")).alias("h")), ["doc_id"], masks)
    hits = doc_seeds.join(F.broadcast(seeds) if few else seeds, "seed").select(
        "doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()
    # One row per document with its hits, so that a text is split once.
    wanted = staged(hits.join(items, "item_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "offset", "words")).alias("hits")), "hits")
    near = join_by_id(docs, wanted, "doc_id").select(
        "doc_id", plain_words(F.col("text")).alias("doc_words"), "hits").select(
        "doc_id", F.explode(F.transform("hits", lambda h: F.struct(
            h["item_id"].alias("item_id"), h["offset"].alias("offset"), F.size(h["words"]).alias("n_item"),
            F.size(F.filter(h["words"], lambda w, j: (F.get("doc_words", h["offset"] + j) == w).eqNullSafe(True)))
            .alias("n_equal")))).alias("hit")).select("doc_id", "hit.*")
    good = near.where((F.col("n_equal") >= LEAST_SHARE * F.col("n_item")) | (F.col("n_equal") >= LEAST_EQUAL))
    best = F.max(F.struct("n_equal", (-F.col("offset")).alias("neg"), "n_item"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.neg")).alias("offset"), F.col("b.n_equal").alias("n_equal"),
        F.col("b.n_item").alias("n_item"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the documents that overlap with an item."""
    found = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def _sql() -> str:
    marks = MARKS.replace("'", "''")
    norm = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}{marks}', '{LOWER}'), "
            "'[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')")
    picks = " UNION ALL ".join(
        f"SELECT id, p, '{m}' || " + " || ' ' || ".join(f"w[p + {k + 1}]" for k, c in enumerate(m) if c == "1")
        + f" AS seed FROM (SELECT id, w, unnest(range(0, len(w) - {SPAN - 1})) AS p FROM {{0}} WHERE len(w) >= {SPAN})"
        for m in MASKS)
    short = (f"SELECT id, p, array_to_string(w[p + 1:p + l], ' ') AS seed FROM (SELECT id, w, l, unnest(range(0, len(w) - l + 1)) AS p "
             f"FROM {{0}}, (SELECT DISTINCT len(w) AS l FROM b WHERE len(w) < {SPAN}) WHERE len(w) >= l) {{1}}")
    return f"""
WITH d AS (SELECT doc_id AS id, {norm} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT * FROM (SELECT item_id AS id, {norm} AS w FROM benchmark) WHERE len(w) >= {LEAST_WORDS}),
ds AS ({picks.format('d')} UNION ALL {short.format('d', '')}),
bs AS ({picks.format('b')} UNION ALL {short.format('b', 'WHERE len(w) = l')}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, CAST(ds.p - bs.p AS INT) AS o FROM ds JOIN bs USING (seed)),
e AS (
  SELECT doc_id, item_id, o, CAST(len(b.w) AS INT) AS n_item,
    CAST(len(list_filter(range(0, len(b.w)), lambda j: o + j >= 0 AND d.w[o + j + 1] = b.w[j + 1])) AS INT) AS n_equal
  FROM hits JOIN d ON d.id = doc_id JOIN b ON b.id = item_id)
SELECT doc_id, item_id, o AS "offset", n_equal, n_item FROM e
WHERE n_equal >= {LEAST_SHARE} * n_item OR n_equal >= {LEAST_EQUAL}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, o) = 1
"""


OVERLAPS_SQL = _sql()
