"""From descriptions to a built dataset: describe rows as pieces, resolve where they are, see what evidence they cover, build one dataset."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocabulary as V
from ..operators import joins as J

# Names that columns of an inventory go by; the first that is there counts, and each column serves one field.
COLUMNS = {
    "id": ("dataset_id", "id", "dataset", "key", "name", "resource", "study"),
    "title": ("title", "description", "content summary", "content"),
    "doi": ("doi",),
    "accession": ("accession", "accessions", "accession(s)", "data_url", "url", "link", "links", "host"),
    "species": ("species", "organism", "taxon"),
    "context": ("context_type", "context"),
    "tissue": ("tissue_or_cell_type", "tissue", "cell_type", "cell type"),
    "modalities": ("modalities", "modality", "assay", "assays", "readout", "type"),
    "platform": ("platform", "instrument", "chemistry"),
    "disease": ("disease_state", "disease", "cancer type"),
    "n_cells": ("n_cells", "cells", "n cells", "scale", "size"),
    "n_samples": ("n_donors_or_samples", "n_samples", "samples", "donors"),
    "genes_protein": ("cd_protein_targets (listed)", "protein_targets", "cd_protein_targets", "adt_targets"),
    "genes_perturbed": ("cd_genes_perturbed", "genes_perturbed", "perturbed_genes", "targets", "target genes"),
    "genes_focus": ("cd_focus", "focus_genes", "genes_of_interest", "key_genes", "genes"),
    "perturbation_type": ("perturbation_type", "perturbation"),
    "perturbation_scope": ("perturbation_scope", "scope"),
    "access": ("access", "access note", "accessibility"),
    "notes": ("notes", "note", "comment", "comments", "remarks"),
}


def unique_headers(names: Sequence[str]) -> list[str]:
    """Repeated column names get ``.1``, ``.2``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def map_columns(columns: Sequence[str], fixed: Mapping[str, str] | None = None) -> dict[str, str]:
    """Field to column of an inventory."""
    norm = {re.sub(r"\s+", " ", c.strip().lower()): c for c in reversed(columns)}
    out, used = dict(fixed or {}), set((fixed or {}).values())
    for name, synonyms in COLUMNS.items():
        if name in out:
            continue
        for s in synonyms:
            if s in norm and norm[s] not in used:
                out[name] = norm[s]
                used.add(norm[s])
                break
    return out


def clean(column: Column) -> Column:
    """Trimmed text; null, NaN, NA and blanks are ''."""
    t = F.trim(column.cast("string"))
    return F.when(column.isNull() | F.lower(t).isin("nan", "na", "n/a", "none", "null", "nat"), "").otherwise(t)


def describe(rows: DataFrame, fixed: Mapping[str, str] | None = None) -> DataFrame:
    """Pieces out of an inventory's rows: ids, facets, accessions out of every text cell, genes by role, counts, access class. One projection."""
    where = map_columns(rows.columns, fixed)
    get = lambda name: clean(F.col(f"`{where[name]}`")) if name in where else F.lit("")
    cells = [clean(F.col(f"`{c}`")) for c in rows.columns]
    everything = F.concat_ws(" ; ", *cells)
    return rows.select(
        get("id").alias("id"), get("title").alias("title"), S.accessions(F.concat_ws(" \n ", get("accession"), *cells)).alias("accessions"), V.ASSAY.labels(get("modalities")).alias("assays"), V.primary_assay(get("modalities")).alias("assay"), V.organism(get("species")).alias("organism"),
        V.disease(get("disease")).alias("disease"), V.context(F.concat_ws(" ", get("context"), get("tissue"))).alias("context"), get("tissue").alias("tissue"), V.perturbation(F.concat_ws(" ", get("perturbation_type"), get("modalities"))).alias("perturbation"),
        S.gene_tokens(get("genes_protein")).alias("genes_protein"), S.gene_tokens(get("genes_perturbed")).alias("genes_perturbed"), S.gene_tokens(get("genes_focus")).alias("genes_focus"), F.lower(get("perturbation_scope")).contains("genome").alias("genome_wide"),
        S.first_count(get("n_cells"), ("cells", "nuclei", "spots", "bins", "profiles")).alias("n_cells"), S.first_count(get("n_samples"), ("donors", "patients", "samples", "subjects", "lines")).alias("n_samples"),
        V.access_class(F.concat_ws(" ", get("access"), get("accession"))).alias("access"), F.md5(everything).alias("row_key"),
    )


def resolve(pieces: DataFrame, files: DataFrame | None = None, catalogue: DataFrame | None = None) -> DataFrame:
    """``piece, status, lead``: a local file whose name holds an accession, a catalogued one, a route by the accession's kind, or nothing."""
    acc = pieces.select(F.col("id").alias("piece"), "access", F.explode_outer("accessions").alias("a")).select("piece", "access", F.col("a.id").alias("needle"), F.col("a.kind").alias("kind"))
    fetch = F.when(F.col("access") == "controlled", "controlled").when(F.col("kind").isin("sra_run", "sra_experiment", "sra_study", "bioproject", "geo_series", "geo_sample"), "streamable").when(F.col("kind") == "doi", "manual").when(F.col("needle").isNotNull(), "fetchable").otherwise("unresolved")
    options = acc.select("piece", fetch.alias("status"), F.coalesce("needle", F.lit("")).alias("lead"))
    named = acc.filter("needle is not null")
    if files is not None:
        found = J.token_lookup(files, named.select("needle").distinct())
        options = options.unionByName(named.join(found, "needle").select("piece", F.lit("local").alias("status"), F.col("path").alias("lead")))
    if catalogue is not None:
        known = catalogue.select(F.lower("key").alias("k"), F.col("target").alias("lead"))
        options = options.unionByName(named.join(known, F.lower("needle") == F.col("k")).select("piece", F.lit("catalogued").alias("status"), "lead"))
    return J.best_status(options)


def evidence(pieces: DataFrame, measured: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """``gene, piece, code``: P protein, X perturbed, F focus, R measured; x for every wanted gene where the screen is genome-wide."""
    role = lambda column, code: pieces.select(F.explode(column).alias("gene"), F.col("id").alias("piece"), F.lit(code).alias("code"))
    out = role("genes_protein", "P").unionByName(role("genes_perturbed", "X")).unionByName(role("genes_focus", "F"))
    if measured is not None:
        out = out.unionByName(measured.select("gene", "piece", F.lit("R").alias("code")))
    if genes is not None:
        wide = pieces.filter("genome_wide").select(F.col("id").alias("piece"))
        out = out.unionByName(genes.select("gene").crossJoin(wide).select("gene", "piece", F.lit("x").alias("code")))  # the optimiser checks the size of an inventory's screens
    return out


@dataclass
class Source:
    """A piece ready to build: ``matrix`` (cell, gene, value), ``features`` (gene, name), ``obs`` (cell, …)."""

    name: str
    matrix: DataFrame
    features: DataFrame
    obs: DataFrame


@dataclass
class Built:
    """What a build wrote, and its holes."""

    path: str
    pieces: list[str] = field(default_factory=list)
    holes: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table}")


def build(spark: SparkSession, sources: Sequence[Source], path: str, genes: DataFrame | None = None, how: str = "intersection", panel: DataFrame | None = None, overwrite: bool = True) -> Built:
    """One dataset on a shared gene axis: ``X/<piece>`` (cell, gene, value), ``obs``, ``var``, ``pieces`` and ``blueprint``.

    Cell ids are global: a piece's start after those of the pieces before it that were built. A piece that fails is a hole, uses no ids, and leaves no rows.
    """
    built = Built(path.rstrip("/"))
    mode = "overwrite" if overwrite else "errorifexists"
    named = None
    for i, s in enumerate(sources):
        one = s.features.select(F.lit(i).alias("piece"), F.col("gene").alias("pos"), F.col("name"))
        named = one if named is None else named.unionByName(one)
    resolved = J.with_fallback(J.resolve(named, genes)) if genes is not None else named.withColumn("canonical", F.upper(F.trim("name")))
    axis_rows = resolved.select("piece", "pos", F.col("canonical").alias("id"))
    axis = J.align(axis_rows, how, len(sources), panel)
    var = axis.select("id", "pieces", F.row_number().over(Window.orderBy("place")).cast("int").alias("n")).select((F.col("n") - 1).alias("gene"), "id", "pieces")  # one row a gene
    var.write.mode(mode).parquet(f"{built.path}/var")
    var = spark.read.parquet(f"{built.path}/var")
    first = axis_rows.filter("id is not null").groupBy("piece", "id").agg(F.min("pos").alias("pos"))
    offset, info = 0, []
    for i, s in enumerate(sources):
        try:
            lut = first.filter(F.col("piece") == i).join(var.select("id", F.col("gene").alias("axis")), "id").select(F.col("pos").alias("gene"), "axis")
            n = s.obs.count()
            shifted = s.matrix.join(lut, "gene").select((F.col("cell").cast("long") + F.lit(offset)).alias("cell"), F.col("axis").cast("int").alias("gene"), F.col("value").cast("float").alias("value"))
            shifted.write.mode(mode).parquet(f"{built.path}/X/{s.name}")
            obs = s.obs.select((F.col("cell").cast("long") + F.lit(offset)).alias("cell"), F.lit(s.name).alias("piece"), *[F.col(c).cast("string").alias(c) for c in s.obs.columns if c != "cell"])
            obs.write.mode("overwrite" if not built.pieces and overwrite else "append").option("mergeSchema", "true").parquet(f"{built.path}/obs")
        except Exception as e:  # a hole, by contract
            built.holes[s.name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        built.pieces.append(s.name)
        info.append((s.name, offset, n))
        offset += n
    spark.createDataFrame(info, "piece string, first_cell long, n_cells long").write.mode(mode).parquet(f"{built.path}/pieces")
    blueprint = json.dumps({"how": how, "pieces": built.pieces, "holes": built.holes}, sort_keys=True)
    spark.createDataFrame([(blueprint,)], "value string").coalesce(1).write.mode(mode).text(f"{built.path}/blueprint")
    return built


@dataclass
class State:
    """What an orchestration has found out, kept as text so that people can read and mend it."""

    pieces: DataFrame
    resolutions: DataFrame | None = None
    genes: DataFrame | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def save(self, path: str) -> None:
        """JSON lines of each table, with its schema, and the column map."""
        spark, path = self.pieces.sparkSession, path.rstrip("/")
        tables = {n: t for n, t in (("pieces", self.pieces), ("resolutions", self.resolutions), ("genes", self.genes)) if t is not None}
        for name, table in tables.items():
            table.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        meta = json.dumps({"columns": self.columns, "schemas": {n: t.schema.json() for n, t in tables.items()}})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        from pyspark.sql.types import StructType

        path = path.rstrip("/")
        meta = json.loads(spark.read.text(f"{path}/state").first()["value"])
        tables = {n: spark.read.schema(StructType.fromJson(json.loads(schema))).json(f"{path}/{n}") for n, schema in meta["schemas"].items()}
        return cls(columns=meta["columns"], **tables)

    def to_csv(self, path: str) -> None:
        """The pieces with their resolutions as one flat table: lists joined by ``; ``, nested values as JSON."""
        table = self.pieces if self.resolutions is None else self.pieces.join(self.resolutions.withColumnRenamed("piece", "id"), "id", "left")
        flat = []
        for f in table.schema:
            kind = f.dataType.simpleString()
            flat.append(F.array_join(f.name, "; ").alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f.name))
        table.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_pieces_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The pieces of :meth:`State.to_csv` with the types they had (``like``)."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    out = []
    for f in like.schema:
        kind, text = f.dataType.simpleString(), F.coalesce(F.col(f.name), F.lit(""))
        if kind == "array<string>":
            out.append(F.when(text == "", F.array().cast(kind)).otherwise(F.split(text, "; ")).alias(f.name))
        elif kind.startswith(("array", "struct", "map")):
            out.append(F.from_json(f.name, f.dataType).alias(f.name))
        else:
            out.append((text if kind == "string" else F.col(f.name)).cast(kind).alias(f.name))
    return rows.select(*out)
