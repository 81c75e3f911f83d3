"""Sinks: conforming tables, label masks, BED, GeoJSON, harvests with a manifest, log snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast and ordered as ``schema``; missing ones are null, extra ones an error; a column of nulls alone is text."""
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra:
        raise ValueError(f"columns not in the schema: {', '.join(extra)}")
    kind = lambda f: T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(kind(f)).alias(f.name) for f in schema])


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def materialize(df: DataFrame, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Write chosen columns and rows as Snappy Parquet; the written table."""
    out = df.select(*columns) if columns else df
    out = out.limit(limit) if limit is not None else out
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def relabelled(masks: DataFrame, tile: str = "tile", label: str = "label") -> DataFrame:
    """Instance labels made unique: each tile's labels move up by the largest labels of all tiles before it; 0 stays background.

    The window runs over one row a tile.
    """
    tops = masks.groupBy(tile).agg(F.max(label).alias("__top"))
    base = F.coalesce(F.sum("__top").over(Window.orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = masks.join(tops.select(tile, base.alias("__base")), tile)
    return moved.withColumn(label, F.when(F.col(label) == 0, F.lit(0)).otherwise(F.col(label) + F.col("__base")).cast("long")).drop("__base")


def write_bed(loci: DataFrame, path: str) -> None:
    """BED6 lines of ``chrom, start, end, name, intent, status``; rows of two genome builds together are an error, unplaced ones are left out."""
    if loci.filter("build is not null").select("build").distinct().limit(2).count() > 1:
        raise ValueError("loci of more than one genome build")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.concat_ws("|", "name", "intent", "status"), F.lit("0"), F.lit("."))
    loci.filter("chrom is not null and start is not null and end is not null").select(line.alias("value")).write.mode("overwrite").text(path)


def geojson_feature(points: Column, properties: Column) -> Column:
    """A GeoJSON feature of a polygon given as array<struct<x, y>>; the ring is closed."""
    ring = F.transform(F.concat(points, F.slice(points, 1, 1)), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


FORMATS = ("parquet", "ndjson", "csv", "orc")


class Harvest:
    """Named results in a folder, with a manifest table of what, from where, how many rows and for whom."""

    MANIFEST = "name string, source string, format string, kind string, targets array<string>, rows long, content_hash string, note string, stat map<string,double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, name: str, df: DataFrame, fmt: str = "parquet", source: str = "", kind: str = "", targets: Sequence[str] = (), note: str = "", stat: dict | None = None) -> None:
        if fmt not in FORMATS:
            raise ValueError(f"format {fmt}: there are {', '.join(FORMATS)}")
        where = f"{self.path}/data/{name}"
        {"parquet": lambda w: w.parquet(where), "ndjson": lambda w: w.json(where), "csv": lambda w: w.option("header", True).csv(where), "orc": lambda w: w.orc(where)}[fmt](df.write.mode("overwrite"))
        written = self.read(name, fmt)
        digest = written.select(F.xxhash64(*written.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(F.sum("h"), F.lit(0)).cast("string"), 256).alias("d")).first()
        row = [(name, source, fmt, kind, list(targets), digest["n"], digest["d"], note, {k: float(v) for k, v in (stat or {}).items()})]
        self.spark.createDataFrame(row, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add_staged(self, staging, key: str, name: str | None = None, targets: Sequence[str] = (), note: str = "", overwrite: bool = False) -> str:
        """Copy a staged extract here without reading its source again; its name. Characters of the key that a file name
        can't hold become ``-``. A name that is there already is an error unless ``overwrite``."""
        if key not in staging.index:
            raise KeyError(f"no staged extract {key!r}; there are {sorted(staging.index)}")
        name = name or re.sub(r"[^A-Za-z0-9._-]", "-", key)[:200]
        if not name.strip(".") or "/" in name:
            raise ValueError(f"{name!r} can't be a name")
        if not overwrite and name in self.names():
            raise ValueError(f"{name!r} is there already")
        self.add(name, staging.read(key), source=staging.index[key].source, targets=targets, note=note)
        return name

    def names(self) -> set[str]:
        """What the manifest has; nothing before the first result."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return {r["name"] for r in self.manifest().select("name").distinct().collect()} if there else set()

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def read(self, name: str, fmt: str | None = None) -> DataFrame:
        fmt = fmt or self.manifest().filter(F.col("name") == name).first()["format"]
        reader = self.spark.read
        where = f"{self.path}/data/{name}"
        return {"parquet": reader.parquet, "ndjson": reader.json, "csv": lambda p: reader.csv(p, header=True, inferSchema=True), "orc": reader.orc}[fmt](where)

    def for_target(self, target: str) -> DataFrame:
        return self.manifest().filter(F.array_contains("targets", target))

    def significant(self, alpha: float = 0.05) -> DataFrame:
        """Entries whose q (else p) is at most alpha."""
        return self.manifest().filter(F.coalesce(F.try_element_at("stat", F.lit("q")), F.try_element_at("stat", F.lit("p"))) <= alpha)

    def dispatch(self) -> DataFrame:
        """A row a target, with its entries; those for nobody are ``unassigned``."""
        flat = self.manifest().select("name", "kind", "rows", F.explode_outer("targets").alias("t"))
        return flat.groupBy(F.coalesce("t", F.lit("unassigned")).alias("target")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "kind", "rows")))).alias("entries"))


def snapshot(folded: DataFrame, path: str) -> None:
    """A folded log as a flat table: lists joined by commas, objects as JSON."""
    flat = [F.array_join(c.name, ",").alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.to_json(c.name).alias(c.name) if isinstance(c.dataType, (T.MapType, T.StructType)) else F.col(c.name) for c in folded.schema]
    folded.select(*flat).write.mode("overwrite").parquet(path)
