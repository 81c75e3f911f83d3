"""Scalar functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def parse_size(text: Column) -> Column:
    """Bytes out of ``8GB``, ``1.5 GiB``, ``512``; steps of 1024, truncated; null where it isn't a size."""
    t = F.upper(F.trim(text))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 2)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", F.floor(number.try_cast("double") * F.pow(F.lit(1024.0), power))).cast("long")


def human_size(n: Column) -> Column:
    """Bytes as text: steps of 1024, one decimal, plain below 1024, TB at most."""
    out = F.format_string("%d B", n)
    for i in range(1, len(UNITS)):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {UNITS[i]}", F.bround(n / F.lit(float(1024**i)), 1))).otherwise(out)
    return out


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; A-T (U as T), C-G, R-Y, K-M; any other character N."""
    known = F.regexp_replace(F.translate(seq, "atugcrykm", "ATUGCRYKM"), "[^ATUGCRYKM]", "N")
    return F.translate(F.reverse(known), "ATUGCRYKM", "TAACGYRMK")


def id_type(name: Column) -> Column:
    """The shape of an identifier: ensembl, hgnc, entrez, cd, uniprot or symbol."""
    s = F.trim(name)
    return (
        F.when(s.rlike(r"^ENS[A-Z]*G\d{11}(\.\d+)?$"), "ensembl")
        .when(s.rlike(r"^(?i:hgnc):\d+$"), "hgnc")
        .when(s.rlike(r"^\d{1,9}$"), "entrez")
        .when(s.rlike(r"^(?i:cdw?)\d{1,3}(?i:[a-z])?$"), "cd")
        .when(s.rlike(r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})(-\d+)?$"), "uniprot")
        .otherwise("symbol")
    )


def strip_version(name: Column) -> Column:
    """An Ensembl gene id without its version; other names only trimmed."""
    s = F.trim(name)
    return F.when(s.rlike(r"^ENS[A-Z]*G\d{11}\.\d+$"), F.substring_index(s, ".", 1)).otherwise(s)


def lookup_key(name: Column) -> Column:
    return F.upper(strip_version(name))


def symbol_like(name: Column) -> Column:
    """May an unknown name stand for a symbol? Not junk, and not shaped like an Ensembl, Entrez or HGNC id."""
    s = F.trim(name)
    junk = (s == "") | s.rlike(r"[:\s]") | F.lower(s).isin("nan", "none", "null", "n/a", "na", "nil") | F.lower(s).startswith("unnamed")
    return F.coalesce(~junk & ~s.rlike(r"^\d{1,9}$") & ~F.upper(s).rlike(r"^ENS[A-Z]*G\d{11}(\.\d+)?$"), F.lit(False))


def split_list(text: Column) -> Column:
    """Parts between ; | new lines, and commas outside brackets; trimmed, without empty ones."""
    opened = lambda p: F.length(F.translate(p, ")", "")) < F.length(F.translate(p, "(", ""))  # noqa: E731  more ( than )
    last = lambda parts: F.get(parts, F.size(parts) - 1)
    # A part that ends inside brackets goes on behind the comma.
    glued = lambda parts, p: F.when((F.size(parts) > 0) & opened(last(parts)), F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last(parts), F.lit(","), p)))).otherwise(F.concat(parts, F.array(p)))
    cells = F.transform(F.split(text, "[;|\n]"), lambda cell: F.aggregate(F.split(cell, ","), F.array().cast("array<string>"), glued))
    return F.filter(F.transform(F.flatten(cells), F.trim), lambda p: p != "")


def _quantity(text: Column) -> Column:
    n = F.regexp_replace(text, "[,_\\s]", "")
    scale = F.when(n.rlike("[kK]$"), 1_000.0).when(n.rlike("[mM]$"), 1_000_000.0).when(n.rlike("[gG]$"), 1_000_000_000.0).otherwise(1.0)
    return F.rint(F.regexp_replace(n, "[kKmMgG]$", "").try_cast("double") * scale).cast("long")


def parse_locus(text: Column) -> Column:
    """struct(chrom, start, end), 0-based half-open, out of 1-based inclusive ``chr7:55,019,017-55,211,628`` or ``7:55.0M-55.3M``; null if it isn't a locus or ends before its start."""
    span = r"^\s*([^:\s]+)\s*:\s*([\d.,_]+[kKmMgG]?)\s*[-–]\s*([\d.,_]+[kKmMgG]?)\s*$"
    single = r"^\s*([^:\s]+)\s*:\s*([\d.,_]+[kKmMgG]?)\s*$"
    chrom = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), "^(?i:chr)", "")
    a, b = _quantity(F.regexp_extract(text, span, 2)), _quantity(F.regexp_extract(text, span, 3))
    one = _quantity(F.regexp_extract(text, single, 2))
    made = lambda c, s, e: F.struct(c.alias("chrom"), F.greatest(s - 1, F.lit(0)).cast("long").alias("start"), e.cast("long").alias("end"))
    return F.when(text.rlike(span) & (b >= a), made(chrom(span), a, b)).when(text.rlike(single), made(chrom(single), one, F.greatest(one, F.lit(1))))


#: Genome builds and what they are called.
BUILDS = {"hg38": "GRCh38", "grch38": "GRCh38", "hg19": "GRCh37", "grch37": "GRCh37", "mm10": "GRCm38", "grcm38": "GRCm38", "mm39": "GRCm39", "grcm39": "GRCm39"}


def genome_build(name: Column) -> Column:
    """The canonical build; unknown names stay; null is GRCh38."""
    known = F.create_map(*[F.lit(x) for pair in BUILDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name, F.lit("GRCh38"))


def variant_locus(chrom: Column, position: Column, ref: Column) -> Column:
    """struct(chrom, start, end) of a variant at a 1-based position."""
    return F.struct(F.regexp_replace(chrom, "^(?i:chr)", "").alias("chrom"), (position - 1).cast("long").alias("start"), (position - 1 + F.length(ref)).cast("long").alias("end"))


# Accession shapes in the order they are tried: pattern, kind, letter case, prefix of the canonical form.
_L, _R = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
ACCESSIONS = (
    (rf"(?i){_L}(GSE\d{{3,8}}){_R}", "geo_series", "upper", ""),
    (rf"(?i){_L}(GSM\d{{3,9}}){_R}", "geo_sample", "upper", ""),
    (rf"(?i){_L}(GPL\d{{2,7}}){_R}", "geo_platform", "upper", ""),
    (rf"(?i){_L}([SED]RR\d{{5,10}}){_R}", "sra_run", "upper", ""),
    (rf"(?i){_L}([SED]RX\d{{5,10}}){_R}", "sra_experiment", "upper", ""),
    (rf"(?i){_L}([SED]RP\d{{5,10}}){_R}", "sra_study", "upper", ""),
    (rf"(?i){_L}(PRJ[END][AB]\d{{3,9}}){_R}", "bioproject", "upper", ""),
    (rf"{_L}(SAM[END][AG]?\d{{5,12}}){_R}", "biosample", "", ""),
    (rf"{_L}(EGAD\d{{11}}){_R}", "ega_dataset", "", ""),
    (rf"{_L}(EGAS\d{{11}}){_R}", "ega_study", "", ""),
    (rf"(?i){_L}(phs\d{{6}}(?:\.v\d+(?:\.p\d+)?)?){_R}", "dbgap", "", ""),
    (rf"{_L}(E-[A-Z]{{4}}-\d{{2,7}}){_R}", "arrayexpress", "", ""),
    (rf"{_L}(CRA\d{{6,7}}){_R}", "gsa", "", ""),
    (rf"{_L}(HRA\d{{6,7}}){_R}", "gsa_human", "", ""),
    (rf"{_L}(CN[PSXRA]\d{{7}}){_R}", "cngb", "", ""),
    (rf"{_L}(STDS\d{{7}}){_R}", "stomics", "", ""),
    (rf"{_L}(SCP\d{{3,5}}){_R}", "scp", "", ""),
    (rf"{_L}(DUOS-\d{{6}}){_R}", "duos", "", ""),
    (rf"{_L}(ds\d{{6}}){_R}", "openneuro", "", ""),
    (rf"(?i){_L}(PXD\d{{4,9}}){_R}", "pride", "upper", ""),
    (rf"(?i){_L}(syn\d{{4,12}}){_R}", "synapse", "lower", ""),
    (rf"(?i){_L}(MTBLS\d{{1,7}}){_R}", "metabolights", "upper", ""),
    (rf"(?i){_L}([SED]RS\d{{5,10}}){_R}", "sra_sample", "upper", ""),
    (rf"(?i){_L}(GDS\d{{2,6}}){_R}", "geo_dataset", "upper", ""),
    (rf"(?i){_L}(PRJCA\d{{4,9}}){_R}", "gsa_project", "upper", ""),
    (rf"(?i){_L}(OMIX\d{{3,9}}){_R}", "omix", "upper", ""),
    (rf"{_L}(EGAF\d{{11}}){_R}", "ega_file", "", ""),
    (r"10\.5281/zenodo\.(\d{4,9})", "zenodo_doi", "", "10.5281/zenodo."),
    (r"(?i)zenodo\.org/records?/(\d{4,9})", "zenodo_doi", "", "10.5281/zenodo."),
    (rf"(?i){_L}zenodo\s*(?:record\s*)?(\d{{5,9}}){_R}", "zenodo_doi", "", "10.5281/zenodo."),
    (r"10\.6084/m9\.figshare\.(\d{5,9})", "figshare_doi", "", "10.6084/m9.figshare."),
    (r"(?i)figshare\.com/[^\s)]*?/(\d{5,9})", "figshare_doi", "", "10.6084/m9.figshare."),
    (rf"(?i){_L}figshare\+?\s*(\d{{6,9}}){_R}", "figshare_doi", "", "10.6084/m9.figshare."),
    (rf"(?i){_L}(10\.17632/[a-z0-9]{{6,20}}\.\d{{1,3}})", "mendeley_doi", "", ""),
)
def _named(fix, prefix: str, kind: str):
    return lambda a: F.struct(F.concat(F.lit(prefix), fix(a)).alias("id"), F.lit(kind).alias("kind"))


def accessions(text: Column) -> Column:
    """array<struct<id, kind>> of the accessions in a text: by pattern, then by place; first of equal ids (case aside); DOIs and
    URLs only where they don't carry an id already found."""
    parts = []
    for pattern, kind, case, prefix in ACCESSIONS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        fix = {"upper": F.upper, "lower": F.lower, "": lambda c: c}[case]
        parts.append(F.transform(found, _named(fix, prefix, kind)))
    known_hosts = lambda d: F.contains(F.lower(d), F.lit("zenodo")) | F.contains(F.lower(d), F.lit("figshare")) | F.contains(d, F.lit("17632"))
    dois = F.transform(F.filter(_tails(text, "10."), lambda d: d.rlike("^10[.][0-9]{4,9}/.") & ~known_hosts(d)), lambda d: F.struct(_closed(d).alias("id"), F.lit("doi").alias("kind")))
    return let(F.concat(F.flatten(F.array(*parts)), dois), lambda known: let(F.concat(known, _urls(text, known)), distinct_ids))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _tails(text: Column, head: str) -> Column:
    """Of each run of characters that can stand in an address, the part from ``head`` (any letter case) on, where it begins a word."""
    at = lambda w: F.instr(F.lower(w), head)
    begins = lambda w: (at(w) == 1) | ((at(w) > 1) & ~F.substr(w, at(w) - 1, F.lit(1)).rlike("[A-Za-z0-9]"))
    runs = F.split(text, "[\\s;,)\"'>\\]]+")
    return F.transform(F.filter(runs, begins), lambda w: F.substr(w, at(w)))


def _closed(c: Column) -> Column:
    return F.regexp_replace(c, r"[.)]+$", "")


def _urls(text: Column, known: Column) -> Column:
    carries = lambda u: F.lower(u).rlike(r"zenodo\.org/record|figshare\.com/articles|doi\.org/10\.") | F.exists(known, lambda k: (F.length(k["id"]) >= 6) & F.lower(u).contains(F.lower(k["id"])))
    found = F.transform(F.flatten(F.array(*[_tails(text, scheme) for scheme in ("https://", "http://", "ftp://")])), _closed)
    return F.transform(F.filter(found, lambda u: ~carries(u)), lambda u: F.struct(u.alias("id"), accession_kind(u).alias("kind")))


def distinct_ids(found: Column) -> Column:
    """The first of each id, case aside, in order."""
    numbered = F.transform(found, lambda a, i: F.struct(a["id"].alias("id"), a["kind"].alias("kind"), i.alias("i")))
    return let(numbered, lambda all_: F.transform(F.filter(all_, lambda a: ~F.exists(all_, lambda b: (b["i"] < a["i"]) & (F.lower(b["id"]) == F.lower(a["id"])))), lambda a: F.struct(a["id"].alias("id"), a["kind"].alias("kind"))))


# What an accession as a whole is, in the order tried.
KINDS = (
    ("sra_run", r"^[SED]RR\d+$"), ("sra_experiment", r"^[SED]RX\d+$"), ("sra_study", r"^[SED]RP\d+$"), ("bioproject", r"^PRJ[END][AB]\d+$"),
    ("biosample", r"^SAM[END][AG]?\d+$"), ("geo_series", r"^GSE\d+$"), ("geo_sample", r"^GSM\d+$"), ("ega_dataset", r"^EGAD\d+$"), ("ega_study", r"^EGAS\d+$"),
    ("arrayexpress", r"^E-[A-Z]{4}-\d+$"), ("gsa", r"^CRA\d+$"), ("stomics", r"^STDS\d+$"), ("cngb", r"^CN[PSXRA]\d{7}$"), ("dbgap", r"^(?i:phs)\d+"),
    ("figshare_doi", r"^(?i)(doi:)?10\.6084/m9\.figshare\.\d+"), ("zenodo_doi", r"^(?i)(doi:)?10\.5281/zenodo\.\d+"), ("openneuro", r"^ds\d{6}$"),
    ("mendeley_doi", r"^(?i)(doi:)?10\.17632/[a-z0-9]+\.\d+"),
)
HOSTS = (("kaggle", "kaggle.com/datasets/"), ("figshare_url", "figshare.com"), ("nitrc", "nitrc.org"), ("mendeley_url", "data.mendeley.com"))


def accession_kind(accession: Column) -> Column:
    """The kind of one accession, URL or path; 'unknown' for the rest."""
    a = F.trim(accession)
    url = F.lit("url")
    for kind, host in reversed(HOSTS):
        url = F.when(F.lower(a).contains(host), kind).otherwise(url)
    out = F.when(a.rlike("^https?://"), url).when(a.startswith("s3://"), "s3").when(a.startswith("gs://"), "gs").otherwise("unknown")
    for kind, pattern in reversed(KINDS):
        out = F.when(a.rlike(pattern), kind).otherwise(out)
    return out


# Nouns that make the number before them a count of something else.
OTHER_NOUNS = (
    "dataset datasets study studies cohort cohorts paper papers publication publications project projects atlas atlases file files gene genes feature features condition conditions "
    "timepoint timepoints tissue tissues batches assay assays modality modalities platform platforms technology technologies resource resources database databases library libraries "
    "lane lanes run runs guide guides sgrna sgrnas perturbation perturbations panel panels protein proteins antibody antibodies target targets marker markers protocol protocols method methods "
    "reference references site sites centre centres center centers countries figure figures table tables plex"
).split()
OTHER_PAIRS = ("time point", "time points", "cell type", "cell types")
#: A run of digits with marks between them, and the letter that may scale it.
DIGITS = r"[0-9](?:[0-9.,]*[0-9])?(?:\s*[kKmM](?![A-Za-z]))?"


def _counts(text: Column) -> Column:
    """array<struct<n, tails>> of the numbers in a text; ``tails`` are what follows each, and that without its first and first two words."""
    numbers, gaps = F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0)), F.split(text, DIGITS)
    scale = lambda d: F.when(F.lower(d).endswith("k"), 1_000.0).when(F.lower(d).endswith("m"), 1_000_000.0).otherwise(1.0)
    digits = lambda d: F.translate(d, "kKmM \t\n", "")
    # Commas part thousands or nothing.
    grouped = lambda d: F.forall(F.slice(F.split(digits(d), ","), 2, 99), lambda g: F.length(F.substring_index(g, ".", 1)) == 3)
    value = lambda d: F.when(grouped(d), F.rint(F.translate(digits(d), ",", "").try_cast("double") * scale(d)).cast("long"))
    later = lambda tail: F.regexp_replace(tail, "^[a-z-]+ ", "")
    after = lambda i: F.ltrim(F.regexp_replace(F.lower(F.coalesce(F.get(gaps, i + 1), F.lit(""))), "^\\+|\\s+", " "))
    tails = lambda t: F.array(t, later(t), later(later(t)))
    return F.filter(F.transform(numbers, lambda d, i: F.struct(value(d).alias("n"), tails(after(i)).alias("tails"))), lambda c: c["n"].isNotNull())


def first_count(text: Column, units: tuple[str, ...] = (), require_unit: bool = False) -> Column:
    """The first number before one of the units, two words apart at most; else, unless a unit is required, the first number that doesn't count another noun."""
    word = lambda t, pattern: F.regexp_extract(t, pattern, 0)
    other = lambda c: F.exists(c["tails"], lambda t: word(t, "^-?[a-z]+").isin(*OTHER_NOUNS, "-plex") | word(t, "^[a-z]+ [a-z]+").isin(*OTHER_PAIRS))

    def choose(counts: Column) -> Column:
        tried = [F.filter(counts, lambda c, u=unit: F.exists(c["tails"], lambda t: F.startswith(t, F.lit(u)))) for unit in units]
        if not require_unit:
            tried.append(F.filter(counts, lambda c: ~other(c)) if units else counts)
        return F.coalesce(*[F.get(found, F.lit(0))["n"] for found in tried]) if tried else F.lit(None).cast("long")

    return let(_counts(text), choose)


# Words in a gene cell that aren't genes.
GENE_STOP = ("none", "n/a", "na", "various", "all", "genome-wide", "unknown", "ko", "kd", "wt", "oe", "ntc", "nt", "and", "or")
_SYMBOL_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-."


def _gene_like(token: Column) -> Column:
    """A symbol (up to twenty letters, digits, hyphens and points after a letter), an Ensembl id, or an Entrez id of three digits or more."""
    letters = F.lower(token)
    symbol = F.length(token).between(1, 20) & (F.translate(letters, _SYMBOL_CHARACTERS, "") == "") & F.substring(letters, 1, 1).between("a", "z") & ~letters.isin(*GENE_STOP)
    return symbol | (id_type(token) == "ensembl") | ((id_type(token) == "entrez") & (F.length(token) > 2))


def gene_tokens(text: Column) -> Column:
    """Distinct gene-like tokens of a cell, in order: lists, brackets, ``and``, ``or``, ``/`` and ``&`` part them; stop words and short numbers go."""
    cells = F.filter(split_list(text), lambda p: ~F.lower(p).isin(*GENE_STOP))
    # What stands in brackets is read after the rest of its cell.
    bracketed = lambda p: F.flatten(F.transform(F.regexp_extract_all(p, F.lit("[(]([^()]*)[)]"), F.lit(1)), lambda b: F.split(b, "[,;|]")))
    phrases = F.flatten(F.transform(cells, lambda p: F.concat(F.array(F.regexp_replace(p, "[(][^()]*[)]", " ")), bracketed(p))))
    joins = lambda w: w.isNull() | F.lower(w).isin("/", "and", "or")

    def tokens(phrase: Column) -> Column:
        """The words of a phrase that stand alone between joining words."""
        words = F.filter(F.split(F.regexp_replace(phrase, "[/&]", " / "), "\\s+"), lambda w: w != "")
        alone = F.filter(words, lambda w, i: ~joins(w) & joins(F.get(words, i - 1)) & joins(F.get(words, i + 1)))
        return F.transform(alone, lambda w: F.trim(w, F.lit(".")))

    return F.array_distinct(F.filter(F.flatten(F.transform(phrases, tokens)), _gene_like))


def decode_text(value: Column, missing: tuple[str, ...] = ()) -> Column:
    """Text out of UTF-8 bytes: up to the first zero byte; nulls and what is in ``missing`` are null."""
    text = F.substring_index(F.decode(value, "UTF-8"), "\0", 1)
    return F.when(~text.isin(*missing), text) if missing else text


def natural_key(text: Column) -> Column:
    """Sorts digits as numbers: every run of digits, padded to 20 places."""
    runs = F.split(F.regexp_replace(text, r"(\d+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(r, 20, "0")).otherwise(F.lower(r))), "")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double; a time without a zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def sparkline(values: Column) -> Column:
    """Eight-level glyphs of an array, scaled from least to most (a flat one is lowest)."""
    glyphs = F.array(*[F.lit(g) for g in "▁▂▃▄▅▆▇█"])
    lo, hi = F.array_min(values), F.array_max(values)
    level = lambda v: F.when(hi > lo, F.rint((v - lo) / (hi - lo) * 7)).otherwise(0.0).cast("int")
    return F.array_join(F.transform(values, lambda v: F.element_at(glyphs, level(v) + 1)), "")


# Rough published prices in USD a GB.
EGRESS = {"free": 0.0, "aws-odp": 0.0, "aws-requester": 0.09, "gcp-requester": 0.12, "azure": 0.087}


def egress_cost(bytes_: Column, cost_class: Column) -> Column:
    """USD to move so many bytes; null for a metered class of unknown size."""
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in EGRESS.items() for x in p]), cost_class), F.lit(0.0))
    return F.when((rate > 0) & (F.coalesce(bytes_, F.lit(0)) == 0), None).otherwise(F.coalesce(bytes_, F.lit(0)) / F.lit(float(1 << 30)) * rate)


def bit_width(v: Column) -> Column:
    """Bits of a non-negative integer (0 for 0)."""
    return F.when(v <= 0, 0).otherwise(F.length(F.bin(v)))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def keyword_count(text: Column, term: str) -> Column:
    """Occurrences of a term as whole tokens, case aside."""
    import re

    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])"))
