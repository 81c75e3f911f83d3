"""Exact dedup by deterministic block naming (DataFrame functions only).

A text's normalised UTF-8 bytes are cut into blocks of a fixed size. Distinct blocks are sorted and get
integer names; then adjacent pairs of names are sorted and named in turn, level by level, until each
document has one integer. Two documents have the same (level, name) exactly when their bytes are equal.

At scale the bytes of a block cross the network once: blocks are sorted by a digest, and each digest's
group is checked to hold a single distinct content before its name counts. If a digest is shared by
different blocks, naming starts again with a stronger one, at last with the bytes themselves, so no
collision can merge two texts. Partial aggregation keeps groups of copies small before the shuffle, and
joins back to a hot name are left to adaptive skew handling; there is no window over a group.

Cases: null counts as empty, and all empty texts are one group; repeated rows are copies like any other
(one row stays); a null doc_id sorts last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, forget, materialize, text_of, with_row_key

#: The characters that don't count: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 16_384

Digest = Callable[[Column], Column]
#: Sort keys of blocks, tried in turn until no two blocks share one; the last is the block itself.
DIGESTS: tuple[Digest, ...] = (lambda b: F.unhex(F.md5(b)), lambda b: F.unhex(F.sha2(b, 256)), lambda b: b)


def normalised(text: Column) -> Column:
    """The text without blanks, as UTF-8 bytes."""
    return F.translate(text, BLANKS, "").cast("binary")


def _names(keys: DataFrame, by: list[str], label: str) -> DataFrame:
    """Distinct ``keys`` with ``name``, an integer that follows their sort order; written, so that names stay as they are."""
    ordered = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def block_identities(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, digests: Sequence[Digest] = DIGESTS, row_col: str = ROW, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Name whole texts. ``docs`` has a unique ``row_col``.

    Returns (rows, ids): rows holds ``row_col``, the columns in ``keep``, ``n_chars`` (code points of the original text),
    ``text_sha256`` and the blocks' digests; ids holds ``row_col``, ``level``, ``name``.
    """
    text = text_of(text_col)
    for digest in digests:
        base = docs.select(F.col(row_col), *keep, F.char_length(text).cast("long").alias("n_chars"), normalised(text).alias("__bytes"))
        cut = base.withColumn("__blocks", F.expr(f"transform(sequence(0L, greatest(0L, (octet_length(__bytes) - 1L) div {block_bytes})), i -> substring(__bytes, cast(i * {block_bytes} + 1 as int), {block_bytes}))"))
        content = cut.select(F.explode("__blocks").alias("block")).select(digest(F.col("block")).alias("sig"), "block").distinct()
        per_sig = content.groupBy("sig").agg(F.count(F.lit(1)).alias("contents"))
        names = _names(per_sig, ["sig"], "block-names")
        if names.filter("contents > 1").isEmpty():
            break
    else:
        raise ValueError("the last digest must tell any two blocks apart")
    rows = materialize(
        cut.select(row_col, *keep, "n_chars", F.sha2(F.col("__bytes"), 256).alias("text_sha256"), F.transform("__blocks", digest).alias("__sigs")), "block-rows"
    )
    level = 0
    flat = rows.select(row_col, F.size("__sigs").cast("long").alias("n"), F.posexplode("__sigs").alias("pos", "sig"))
    named = flat.join(names.select("sig", "name"), "sig").select(row_col, "n", F.col("pos").cast("long").alias("pos"), "name")
    most = rows.agg(F.max(F.size("__sigs"))).first()[0] or 0
    if most > 1:
        named = materialize(named, "block-level")
    done = named.filter("n = 1").select(row_col, F.lit(0).alias("level"), "name")
    while most > 1:
        level += 1
        pairs = (
            named.filter("n > 1")
            .groupBy(row_col, F.expr("(n + 1) div 2").alias("n"), F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.max(F.expr("if(pos % 2 = 1, name, -1)")).alias("b"))
        )
        pairs = materialize(pairs, "pairs")
        names = _names(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        named = pairs.join(names, ["a", "b"]).select(row_col, "n", "pos", "name")
        most = (most + 1) // 2
        if most > 1:
            named = materialize(named, "block-level")
        done = done.unionByName(named.filter("n = 1").select(row_col, F.lit(level).alias("level"), "name"))
    return rows, done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, digests: Sequence[Digest] = DIGESTS, row_col: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` (and the row key, if given).

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id.
    ``docs`` is read twice, but its row keys are taken once, so they may be computed here.
    """
    key = row_col or ROW
    keyed = docs if row_col else with_row_key(docs)
    keyed = keyed.select(F.col(key), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, ids = block_identities(keyed, "text", block_bytes, digests, key, keep=["doc_id"])
    whole = materialize(rows.drop("__sigs").join(ids, key), "identities")
    forget(rows)
    order = F.struct((-F.col("n_chars")).alias("x"), F.col("doc_id").isNull().alias("y"), F.col("doc_id").alias("doc_id"), F.col(key).alias("row"))
    groups = whole.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    # A group of one needs no join: its own row stays.
    groups = materialize(groups.filter("group_size > 1"), "groups")  # a plain table, so that a hot group's join can be split
    joined = whole.join(groups, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        *([key] if row_col else []),
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col(key))).alias("kept"),
        "text_sha256",
        "n_chars",
    )
