"""Text search: trigram postings over blocks of lines, exact line search, sequence patterns, level-of-detail buckets of reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import reverse_complement


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the folded text, by one pass of an expression that looks ahead from every character."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_index(lines: DataFrame, block_lines: int = 64, line: str = "line", text: str = "text") -> DataFrame:
    """Postings ``trigram, block``, each once. Trigrams never cross a line."""
    return lines.select(F.expr(f"{line} div {block_lines}").alias("block"), F.explode(trigrams(F.col(text))).alias("trigram")).distinct()


#: Folders of a stored index, by the hash of a trigram.
PARTS = 64


def _part(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(PARTS))


def store_index(index: DataFrame, path: str) -> None:
    """Write postings in folders by trigram, sorted, so that a search reads only the folders and row groups of its trigrams."""
    index.withColumn("part", _part(F.col("trigram"))).repartition("part").sortWithinPartitions("part", "trigram").write.mode("overwrite").partitionBy("part").parquet(path)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings of :func:`store_index`, with ``part``."""
    return spark.read.parquet(path)


def wanted_trigrams(pattern: str) -> list[str]:
    p = pattern.lower()
    return sorted({p[i : i + 3] for i in range(len(p) - 2)})


def trigram_candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """Blocks that hold every trigram of a pattern; None where fewer than three characters can't narrow."""
    wanted = wanted_trigrams(pattern)
    if not wanted:
        return None
    if "part" in index.columns:  # only these folders are read
        parts = index.sparkSession.createDataFrame([(w,) for w in wanted], "w string").select(_part(F.col("w"))).distinct().collect()
        index = index.filter(F.col("part").isin(*[int(r[0]) for r in parts]))
    return index.filter(F.col("trigram").isin(*wanted)).groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("block")


def search_engine(pattern: str, regex: bool = False, indexed: bool = False) -> str:
    """How a search is answered: ``index`` where postings are stored and the pattern has a literal of three characters, else ``scan``."""
    literal = longest_literal(pattern) if regex else pattern
    return "index" if indexed and len(literal) >= 3 else "scan"


def search_lines(lines: DataFrame, pattern: str, ignore_case: bool = True, index: DataFrame | None = None, block_lines: int = 64, line: str = "line", text: str = "text", regex: bool = False) -> DataFrame:
    """Lines that contain the pattern, or match it as a regular expression; a stored index only narrows what is read."""
    if regex:
        hit = lines.filter(F.col(text).rlike(f"(?i){pattern}" if ignore_case else pattern))
    else:
        hit = lines.filter((F.lower(text) if ignore_case else F.col(text)).contains(pattern.lower() if ignore_case else pattern))
    if search_engine(pattern, regex, index is not None) == "scan":
        return hit
    blocks = trigram_candidates(index, longest_literal(pattern) if regex else pattern)
    return hit.withColumn("__b", F.expr(f"{line} div {block_lines}")).join(blocks.withColumnRenamed("block", "__b"), "__b", "left_semi").drop("__b")


#: Words of an item by which documents that may hold it are found.
ANCHOR_WORDS = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def contained_items(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (item, document) where the item's whole text stands in the document's: an equi-join on words, then an exact test.

    Words inside an item, all but its first and last, are whole words of any text that holds it. Up to ``ANCHOR_WORDS`` of
    them, hashed together, meet the documents' runs of as many words. Items of fewer than three words have none and are compared as they are.
    """
    inner = items.select(F.col(item_id).alias("__item"), F.col(text).alias("__whole"), _words(F.col(text)).alias("w"))
    anchors = inner.withColumn("k", F.least(F.lit(ANCHOR_WORDS), F.size("w") - 2))
    long = anchors.filter("k > 0").select("__item", "__whole", "k", F.xxhash64("k", F.array_join(F.slice("w", F.lit(2), F.col("k")), " ")).alias("h"))
    sizes = [r[0] for r in long.select("k").distinct().collect()]  # ANCHOR_WORDS at most
    words = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text"), _words(F.col(text)).alias("w"))
    runs = lambda k: F.transform(F.filter(F.transform("w", lambda _, i: i), lambda i: i + k <= F.size("w")), lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice("w", i + 1, F.lit(k)), " ")))
    found = None
    if sizes:
        hashed = words.select("__doc", "__text", F.explode(F.array_distinct(F.flatten(F.array(*[runs(k) for k in sizes])))).alias("h"))
        found = hashed.join(long, "h").filter(F.contains("__text", "__whole")).select("__item", "__doc")
    short = anchors.filter("k <= 0")
    if found is None or not short.isEmpty():
        few = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(short.select("__item", "__whole"), F.contains("__text", "__whole")).select("__item", "__doc")
        found = few if found is None else found.unionByName(few)
    return found.distinct().select(F.col("__item").alias(item_id), F.col("__doc").alias(doc_id))


def longest_literal(pattern: str) -> str:
    """The longest plain run of a regular expression, for narrowing by an index."""
    import re

    return max(re.split(r"[^A-Za-z0-9_ :/\-]+", re.sub(r"\\.|\[[^\]]*\]|.[?*{]", "\0", pattern)), key=len, default="")


def pattern_counts(reads: DataFrame, pattern: str, seq: str = "seq") -> DataFrame:
    """Add ``hits``: non-overlapping occurrences on either strand, case aside."""
    p = pattern.upper()
    rc = reads.sparkSession.range(1).select(reverse_complement(F.lit(p)).alias("r")).first()["r"]
    both = p if rc == p else f"{p}|{rc}"
    return reads.withColumn("hits", F.regexp_count(F.upper(seq), F.lit(both)))


def pattern_offsets(reads: DataFrame, patterns: Sequence[str], both_strands: bool = True, id_col: str = "id", seq: str = "seq", first_per_record: bool = False) -> DataFrame:
    """Hits of many patterns with offsets: ``id, pattern, strand, start``; leftmost first, longest pattern first, no overlap. Aho-Corasick over Arrow batches."""
    kind = reads.schema[id_col].dataType.simpleString()
    comp = str.maketrans("ATUGCRYKMN", "TAACGYRMKN")
    wanted: dict[str, tuple[str, str]] = {}
    for p in patterns:
        up = p.upper()
        wanted.setdefault(up, (p, "+"))
        if both_strands:
            wanted.setdefault(up[::-1].translate(comp), (p, "-"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, v in wanted.items():
            a.add_word(w, (len(w), v))
        a.make_automaton()
        for f in frames:
            out = []
            for i, s in zip(f["id"], f["seq"], strict=True):
                found = sorted(((end - n + 1, -n, v) for end, (n, v) in a.iter((s or "").upper())), key=lambda h: (h[0], h[1]))
                free = 0
                for start, n, (p, strand) in found:
                    if start >= free:
                        out.append((i, p, strand, start))
                        free = start - n
                        if first_per_record:
                            break
            yield pd.DataFrame(out, columns=["id", "pattern", "strand", "start"])

    return reads.select(F.col(id_col).alias("id"), F.col(seq).alias("seq")).mapInPandas(run, f"id {kind}, pattern string, strand string, start long")


def read_buckets(reads: DataFrame, per_bucket: int, record: str = "record", seq: str = "seq", qual: str | None = None) -> DataFrame:
    """Level-of-detail summary of reads: ``bucket, n, bases, min_len, max_len, gc, n_frac[, mean_q]``; fractions are of bases."""
    s = F.coalesce(F.col(seq), F.lit(""))
    n = F.length(s)
    count = lambda chars: n - F.length(F.translate(s, chars + chars.lower(), ""))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(n).alias("bases"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), (F.sum(count("GC")) / F.sum(n)).alias("gc"), (F.sum(count("N")) / F.sum(n)).alias("n_frac")]
    if qual:
        q = F.aggregate(F.transform(F.split(F.col(qual), ""), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)
        aggs.append((F.sum(q) / F.sum(F.length(qual))).alias("mean_q"))
    return reads.groupBy(F.expr(f"{record} div {per_bucket}").alias("bucket")).agg(*aggs)


def zoom_buckets(buckets: DataFrame, lo: int, hi: int, target: int) -> DataFrame:
    """About ``target`` groups out of buckets [lo, hi): ``grp, n, bases, min_len, max_len, gc, n_frac``; means weighted by bases."""
    group = max(1, -(-(hi - lo) // target))
    weighted = lambda c: (F.sum(F.col(c) * F.col("bases")) / F.sum("bases")).alias(c)
    return buckets.filter((F.col("bucket") >= lo) & (F.col("bucket") < hi)).groupBy(F.expr(f"(bucket - {lo}) div {group}").alias("grp")).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"), weighted("gc"), weighted("n_frac"))
