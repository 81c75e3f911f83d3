"""Ways to data: routes and their prices, repository queries, transfer commands. Only text is built; nothing is fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import egress_cost

# Kinds of routes, the best first.
ROUTE_RANK = ("local", "aws-odp", "ena-http", "ena-ftp", "http", "ftp", "ena-aspera", "sra-toolkit", "aws-requester", "gcp-requester", "manual")


def ranked(routes: DataFrame, group: Sequence[str], kinds: Sequence, cost: str, tie: str) -> DataFrame:
    """Add ``place`` within each group: by ``kinds`` (names or expressions), then cost (unknown last), then ``tie``."""
    from pyspark.sql import Window

    order = Window.partitionBy(*group).orderBy(*kinds, F.coalesce(F.col(cost), F.lit(float("inf"))), tie)
    return routes.withColumn("place", F.row_number().over(order))


def rank_routes(routes: DataFrame) -> DataFrame:
    """Add ``cost`` and ``place`` within each accession: by kind, then price (unknown last), then those whose tool is missing."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROUTE_RANK]), F.col("kind"))
    priced = routes.withColumn("cost", egress_cost(F.col("bytes"), F.col("cost_class"))).withColumn("__tie", F.struct("available", "url"))
    return ranked(priced, ["accession"], [F.when(rank == 0, len(ROUTE_RANK) + 1).otherwise(rank)], "cost", "__tie").drop("__tie")


def one_per_run(routes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``has_fastq, cost`` of one representation a run: the cheapest FASTQ where there is one, else the cheapest of the rest. ``routes`` has the key, ``has_fastq, cost``."""
    fastq = F.col("has_fastq")
    per = routes.groupBy(*key).agg(F.bool_or(fastq).alias("has_fastq"), F.min(F.when(fastq, F.col("cost"))).alias("__fastq"), F.min("cost").alias("__any"))
    return per.select(*key, "has_fastq", F.when(F.col("has_fastq"), F.col("__fastq")).otherwise(F.col("__any")).alias("cost"))


def cheapest(routes: DataFrame) -> DataFrame:
    """Per accession, over one representation a run (FASTQ before containers): 0 if any route is free, null if a run's only price is unknown."""
    priced = routes.withColumn("cost", egress_cost(F.col("bytes"), F.col("cost_class"))).withColumn("has_fastq", F.col("representation") == "fastq")
    per = one_per_run(priced, ["accession", "run"]).groupBy("accession").agg(F.sum("cost").alias("known"), F.count_if(F.col("cost").isNull()).alias("unknown"))
    return per.select("accession", F.when(F.col("unknown") == 0, F.col("known")).alias("cost"))


def geo_folder(series: Column) -> Column:
    """GSE12345 to ``GSE12nnn/GSE12345``."""
    return F.concat(F.regexp_replace(series, r"\d{1,3}$", "nnn"), F.lit("/"), series)


def repository_queries(genes: Sequence[str], context: Sequence[str] = (), organism: str | None = None, max_genes: int = 5) -> dict[str, str]:
    """Search URLs for a few genes at public repositories."""
    from urllib.parse import quote, quote_plus

    few = list(genes)[:max_genes]
    terms = " AND ".join(["(" + " OR ".join(few) + ")", *context, *([f'"{organism}"[Organism]'] if organism else [])])
    species = (organism or "Homo sapiens").lower().replace(" ", "_")
    base = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi"
    return {
        "gds": f"{base}?db=gds&retmode=json&term={quote_plus(terms)}",
        "pubmed": f"{base}?db=pubmed&retmode=json&term={quote_plus(terms)}",
        "ena": f"https://www.ebi.ac.uk/ena/portal/api/search?result=read_study&format=json&query={quote_plus(' AND '.join(f'study_title=*{g}*' for g in few))}",
        **{f"ensembl:{g}": f"https://rest.ensembl.org/lookup/symbol/{species}/{quote(g)}?content-type=application/json" for g in few},
    }


def parse_hits(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Counts and ids out of recorded search answers (JSON)."""
    parsed = F.from_json(column, "esearchresult struct<count:string,idlist:array<string>>")
    return payloads.withColumn("hits", parsed["esearchresult"]["count"].try_cast("long")).withColumn("ids", parsed["esearchresult"]["idlist"])


def mirror_command(url: str, folder: str, include: str = "") -> str:
    """A wget command line that mirrors a remote tree."""
    import shlex

    return " ".join(["wget", "-r", "-np", "-nH", "-c", *(["-A", shlex.quote(include)] if include else []), "-P", shlex.quote(folder), shlex.quote(url)])


def capped_pick(entries: DataFrame, cap: int, path: str = "path", size: str = "size") -> DataFrame:
    """Smallest first, skipping what would exceed the cap in all. Sizes ascend, so what is skipped is all that follows the first skip: a running sum."""
    from pyspark.sql import Window

    total = F.sum(size).over(Window.orderBy(size, path))  # a listing of one tree
    return entries.withColumn("__total", total).filter(F.col("__total") <= cap).drop("__total")
