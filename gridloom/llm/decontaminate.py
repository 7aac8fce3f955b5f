"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

Corpus counts of the benchmark's terms say which two terms of each window are rarest; the
corpus's postings (term, document, position) are stored for these. A posting of a term that an
item has at place q lies on the item's diagonal position - q; a document stays with a diagonal on
which the postings of both rarest terms of some window meet. There the item is laid beside the
document's words, and the runs of equal words that cover a window are its hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import sized, stored, table

#: Words of a window.
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that aren't lower-cased.
_BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text):
    """``text`` with A-Z lower-cased and nothing else changed.

    ``lower`` does just that unless a text has upper- or title-case letters beyond ASCII.
    """
    return F.when(F.col(text).rlike(r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: str):
    """Words between separators; an empty first or last element where the text starts or ends with a separator."""
    return F.split(ascii_lower(text), _BETWEEN, -1)


def _count(pieces):
    """Number of words of a text from its pieces between separators."""
    first, last = F.element_at(pieces, 1) == "", F.element_at(pieces, -1) == ""
    return F.coalesce(F.size(pieces) - first.cast("int") - (last & (F.size(pieces) > 1)).cast("int"), F.lit(0)).cast("long")


def item_words(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item_id, words, n, w) of items that have words; w is the length of their windows."""
    clean = F.filter(F.split(ascii_lower("text"), _BETWEEN, -1), lambda x: x != "")
    out = items.select("item_id", clean.alias("words")).withColumn("n", F.size("words")).where("n > 0")
    return out.withColumn("w", F.least("n", F.lit(window)))


class Index:
    """The index of a corpus for a set of items.

    ``items``: item_words; ``pairs``: item_id, pairs (array of the places of the two rarest terms of
    its windows); ``postings``: term, doc_id, pos, stored, of these two terms only, so no other items
    can be looked up in it. The vocabulary is broadcast only
    where its counted size allows it.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        self.docs = docs
        self.items = stored(item_words(items, window), "items", parts=8)
        places = self.items.select("item_id", "n", "w", F.posexplode("words").alias("q", "term"))
        terms = stored(places.select("term").distinct(), "terms", parts=8)
        counts = docs.select(F.explode("words").alias("term")).join(sized(terms), "term").groupBy("term").agg(F.count("*").alias("k"))
        self.counts = stored(terms.join(counts, "term", "left").select("term", F.coalesce("k", F.lit(0)).alias("k")), "term-counts", parts=8)
        # each window's two rarest places, of different terms if it has any
        ranked = places.join(sized(self.counts), "term").groupBy("item_id", "n", "w").agg(F.array_sort(F.collect_list(F.struct("q", "k", "term"))).alias("p"))
        starts = F.sequence(F.lit(0), F.col("n") - F.col("w"))
        order = lambda s: F.array_sort(F.transform(F.slice("p", s + 1, F.col("w")), lambda x: F.struct(x["k"], x["term"], x["q"])))

        def pair(s):
            by = order(s)
            other = F.get(F.filter(by, lambda x: x["term"] != F.get(by, 0)["term"]), 0)
            return F.struct(F.get(by, 0)["q"].alias("a"), F.coalesce(other["q"], F.get(by, 0)["q"]).alias("b"))

        self.pairs = stored(ranked.select("item_id", F.array_distinct(F.transform(starts, pair)).alias("pairs")), "pairs", parts=8)
        anchors = self.pairs.select("item_id", F.explode("pairs").alias("p")).select("item_id", F.explode(F.array("p.a", "p.b")).alias("q")).distinct()
        self.anchors = stored(anchors.join(places.select("item_id", "q", "term"), ["item_id", "q"]).select("item_id", "q", "term"), "anchors", parts=8)
        self.rare = stored(self.anchors.select("term").distinct(), "rare-terms", parts=8)
        posted = docs.select("doc_id", F.posexplode("words").alias("pos", "term")).join(sized(self.rare), "term")
        self.postings = stored(posted.select("term", "doc_id", "pos"), "postings")

    def diagonals(self) -> DataFrame:
        """(doc_id, item_id, diagonal) on which the rarest terms of a window meet."""
        on = self.postings.join(sized(self.anchors), "term").select("doc_id", "item_id", (F.col("pos") - F.col("q")).alias("diagonal"), "q")
        met = on.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set("q").alias("qs"))
        both = F.exists("pairs", lambda p: F.array_contains("qs", p["a"]) & F.array_contains("qs", p["b"]))
        return met.join(sized(self.pairs), "item_id").where(both).select("doc_id", "item_id", "diagonal")

    def phrases(self) -> DataFrame:
        """(doc_id, item_id, hits): positions of a document's words inside exact occurrences of windows."""
        found = stored(self.diagonals(), "diagonals")
        # an item with its place in the document; few documents have one
        laid = found.join(sized(self.items.select("item_id", "words", "n", "w")), "item_id").withColumnRenamed("words", "item")
        mine = self.docs.join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi")
        j = mine.join(laid, "doc_id")
        at = F.sequence(F.lit(0), F.col("n") - 1)
        same = F.transform(at, lambda q: F.coalesce(F.get("words", q + F.col("diagonal")) == F.get("item", q), F.lit(False)))
        j = j.select("doc_id", "item_id", "diagonal", "n", "w", same.alias("same"))
        # starts of windows whose words are all equal
        full = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("w")), lambda s: ~F.array_contains(F.slice("same", s + 1, F.col("w")), False))
        j = j.select("doc_id", "item_id", "diagonal", "w", full.alias("full")).where(F.size("full") > 0)
        hits = F.array_distinct(F.flatten(F.transform("full", lambda s: F.sequence(s + F.col("diagonal"), s + F.col("diagonal") + F.col("w") - 1))))
        return j.select("doc_id", "item_id", hits.alias("hits"))

    def near(self, slop: int) -> DataFrame:
        """(doc_id, item_id) where all words of a window, each as often as it has it, lie in any order within ``slop`` words more than its length.

        The postings of a window's two rarest terms are intersected; the other terms are looked up in the documents that this leaves.
        """
        starts = F.sequence(F.lit(0), F.col("n") - F.col("w"))
        windows = self.items.select("item_id", "w", F.posexplode(F.transform(starts, lambda s: F.slice("words", s + 1, F.col("w")))).alias("s", "terms"))
        term = windows.select("item_id", "s", "w", F.explode("terms").alias("term")).groupBy("item_id", "s", "w", "term").agg(F.count("*").alias("need"))
        ranked = term.join(sized(self.counts), "term").groupBy("item_id", "s", "w").agg(F.array_sort(F.collect_list(F.struct("k", "term", "need"))).alias("p"))
        first = F.get("p", 0)["term"]
        ranked = stored(ranked.select("item_id", "s", "w", "p", first.alias("a"), F.coalesce(F.get("p", 1)["term"], first).alias("b")), "windows", parts=8)
        span = F.col("w") + slop
        lists = self.postings.groupBy("term", "doc_id").agg(F.collect_list("pos").alias("at"))
        on = lists.select(F.col("term").alias("a"), "doc_id", F.col("at").alias("x")).join(sized(ranked), "a")
        on = on.join(lists.select(F.col("term").alias("b"), "doc_id", F.col("at").alias("y")), ["b", "doc_id"])
        met = F.exists("x", lambda i: F.exists("y", lambda j: F.abs(i - j) < span))
        found = stored(on.where(met).select("doc_id", "item_id", "w", "p"), "near")
        mine = self.docs.join(sized(found.select("doc_id").distinct()), "doc_id", "left_semi").join(found, "doc_id")
        enough = lambda i: F.forall("p", lambda t: F.size(F.filter(F.slice("words", i + 1, span), lambda x: x == t["term"])) >= t["need"])
        begins = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.exists("p", lambda t: t["term"] == F.get("words", i)))
        return mine.where(F.exists(begins, enough)).select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (``key``, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of ``docs``.

    ``items`` has item_id and text. A window is ``window`` consecutive item words; an item of fewer,
    but not none, is one window. Null texts have no words; rows of one key are one document whose
    words are those of all its rows, each tested alone, and get the same hits; a null key is never
    hit. Items' nulls and empty tables give no window. Other columns are not carried.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = Index(d.where("doc_id is not null").select("doc_id", split_words("text").alias("words")), items, window)
    found = index.phrases().groupBy("doc_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.collect_set(F.col("item_id").cast("string")).alias("ids"),
    )
    found = stored(found, "contaminated")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    # cut without lower-casing, which changes no word's ends
    pieces = d.select("doc_id", F.split("text", _BETWEEN_ANY, -1).alias("pieces"))
    out = pieces.select("doc_id", _count(F.col("pieces")).alias("n_words")).join(sized(found), "doc_id", "left")
    return out.select(
        F.col("doc_id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.sort_array(ids), ","), "UTF-8"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM d, lengths)
), found AS (
  SELECT p.doc_id, p.k, p.s, x.item_id FROM places p JOIN windows x ON x.k = p.k AND x.g = p.g
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM found) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""
