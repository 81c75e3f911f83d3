import gzip
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vastgrain.sources import dispatch, readers, sinks


def test_fastq_splits_at_records(spark, tmp_path):
    rng = np.random.default_rng(3)
    reads = [(f"r{i}", "".join(rng.choice(list("ACGT"), 40)), "".join(rng.choice(list("@+I#"), 40))) for i in range(300)]
    data = "".join(f"@{i} extra\n{s}\n+\n{q}\n" for i, s, q in reads)
    (tmp_path / "a.fastq").write_text(data)
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write(data)
    for name, options in (("a.fastq", {"split_bytes": 1000}), ("a.fastq.gz", {})):
        df = dispatch.load(spark, str(tmp_path / name), **options)
        assert sorted((r.id, r.seq, r.qual) for r in df.collect()) == sorted(reads)
        assert df.schema.simpleString() == "struct<id:string,seq:string,length:int,qual:string>"


def test_fasta_joins_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 x\nACG\nTT\n>s2\n\n>s3\nA\n")
    for split in (4, 1 << 20):
        assert sorted((r.id, r.seq, r.length) for r in dispatch.load(spark, str(tmp_path / "a.fa"), split_bytes=split).collect()) == [("s1", "ACGTT", 5), ("s2", "", 0), ("s3", "A", 1)]


def test_mtx_triple(spark, tmp_path):
    (tmp_path / "x_matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%c\n3 2 3\n1 1 5\n3 2 7\n2 2 1\n")
    (tmp_path / "x_barcodes.tsv").write_text("AA\nBB\n")
    (tmp_path / "x_features.tsv").write_text("g1\tG1\tGene Expression\ng2\tG2\tGene Expression\ng3\tG3\tAntibody Capture\n")
    m, cells, genes = readers.read_mtx_triple(spark, str(tmp_path))
    assert sorted(tuple(r) for r in m.collect()) == [(0, 0, 5.0), (1, 1, 1.0), (2, 1, 7.0)] and cells.count() == 2 and genes.filter("feature_type = 'Antibody Capture'").first()["name"] == "G3"
    (tmp_path / "x_barcodes.tsv").write_text("AA\n")
    with pytest.raises(ValueError, match="barcodes"):
        readers.read_mtx_triple(spark, str(tmp_path))


def test_gem(spark, tmp_path):
    (tmp_path / "a.gem").write_text("#FileFormat=GEMv0.1\n#OffsetX=10\n#OffsetY=100\ngeneID\tx\ty\tMIDCounts\nA\t0\t0\t3\nB\t5\t5\tbad\nB\t5\t6\t4000000000\n")
    df = dispatch.load(spark, str(tmp_path / "a.gem"))
    assert sorted((r.gene, r.x, r.y, r["count"], r.exon) for r in df.collect()) == [("A", 10, 100, 3, None), ("B", 15, 106, 4_000_000_000, None)]
    assert dispatch.load(spark, str(tmp_path / "a.gem"), window="10,15,0,200").count() == 1


def test_arrow_ipc(spark, tmp_path):
    t = pa.table({"cell": pa.array(range(10), pa.int32()), "gene": pa.array(list("aabbccddee")).dictionary_encode()})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        for b in t.to_batches(max_chunksize=4):
            w.write_batch(b)
    df = dispatch.load(spark, str(tmp_path / "a.arrow"))
    assert df.rdd.getNumPartitions() == 3 and df.groupBy("gene").count().count() == 5


def test_nifti(spark, tmp_path):
    data = np.arange(24, dtype="<i2").reshape(4, 3, 2)  # z, y, x
    header = bytearray(352)
    header[0:4] = struct.pack("<i", 348)
    header[40:56] = struct.pack("<8h", 3, 2, 3, 4, 1, 1, 1, 1)
    header[70:72] = struct.pack("<h", 4)
    header[108:120] = struct.pack("<3f", 352.0, 2.0, 1.0)
    for name, opener in (("v.nii", open), ("v.nii.gz", gzip.open)):
        with opener(tmp_path / name, "wb") as f:
            f.write(bytes(header) + data.tobytes())
        got = {(r.z, r.y, r.x): r.value for r in dispatch.load(spark, str(tmp_path / name), slab=3).collect()}
        assert got == {(z, y, x): 2.0 * data[z, y, x] + 1 for z in range(4) for y in range(3) for x in range(2)}


def test_dispatch(tmp_path):
    assert dispatch.format_of("a/b.fastq.gz") == "fastx" and dispatch.format_of("x.PARQUET") == "parquet"
    assert dispatch.format_of("x.h5ad") == "h5ad" and dispatch.format_of("x.zarr") == "zarr"
    for bad in ("x.xlsx", "x.what"):
        with pytest.raises(ValueError):
            dispatch.format_of(bad)
    assert dispatch.is_hub_id("org/name", False) and not dispatch.is_hub_id("org/name", True) and not dispatch.is_hub_id("a/b/c", False)
    assert dispatch.guess_sequence("sub-01_T1w.nii.gz") == "T1w" and dispatch.guess_sequence("x_flair_mask.nii") == "MASK"


def test_bundles_and_cohort(spark):
    files = spark.createDataFrame([("a", "a/transcripts.parquet"), ("a", "a/experiment.xenium"), ("b", "b/matrix.mtx.gz"), ("c", "c/readme")], "folder string, path string")
    assert {r.folder: r.kind for r in dispatch.sniff_bundles(files).collect()} == {"a": "xenium", "b": "mtx-triple", "c": "directory"}
    listing = spark.createDataFrame([("sub-01/ses-1/x_T1w.nii",), ("sub-01/ses-1/y_T1w.nii",), ("P02_T2_flair.nii.gz",), ("junk.txt",)], "path string")
    assert sorted((r.subject, r.session, r.sequence) for r in dispatch.cohort(listing).collect()) == [("01", "1", "T1w"), ("01", "1", "T1w_2"), ("P02", "T2", "FLAIR")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None)], "i int, s string, n void")
    out = sinks.conform(df, sinks.T.StructType().add("s", "string").add("n", sinks.T.NullType()).add("i", "long").add("more", "double"))
    assert out.schema.simpleString() == "struct<s:string,n:string,i:bigint,more:double>"
    with pytest.raises(ValueError):
        sinks.conform(df, sinks.T.StructType().add("i", "int"))
    loci = spark.createDataFrame([("7", 10, 20, "x", "check", "open", "GRCh38"), (None, None, None, "y", "check", "open", None)], "chrom string, start long, end long, name string, intent string, status string, build string")
    sinks.write_bed(loci, str(tmp_path / "bed"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["chr7\t10\t20\tx|check|open\t0\t."]
    with pytest.raises(ValueError):
        sinks.write_bed(loci.withColumn("build", F.coalesce("build", F.lit("GRCh37"))), str(tmp_path / "bed2"))
    h = sinks.Harvest(spark, str(tmp_path / "h"))
    h.add("r1", df.select("i", "s"), targets=["t1", "t2"], kind="table", stat={"q": 0.01})
    h.add("r2", df.select("i"), "ndjson", stat={"p": 0.5})
    assert h.read("r2").first()["i"] == 1 and [r.name for r in h.significant().collect()] == ["r1"]
    assert {r.target for r in h.dispatch().collect()} == {"t1", "t2", "unassigned"}
    poly = spark.range(1).select(sinks.geojson_feature(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (0, 1))]), F.struct(F.lit("n").alias("name"))).alias("j")).first()["j"]
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0],[0.0,1.0],[0.0,0.0]]]' in poly
    masks = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (2, 3)], "tile int, label int")
    assert sorted((r.tile, r.label) for r in sinks.relabelled(masks).collect()) == [(0, 0), (0, 2), (1, 3), (2, 6)]
