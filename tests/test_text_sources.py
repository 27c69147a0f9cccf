import gzip
import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from varloom.functions import fields
from varloom.operators import annotate as A
from varloom.operators.quality import row_difference
from varloom.session import DataCheckError
from varloom.sinks import writers as W
from varloom.sources import blocked as BL
from varloom.sources import tables as ST
from varloom.sources import vcf as V

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
##contig=<ID=X,length=500>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1
chr1\t100\trs1\tA\tC\t50\tPASS\tGENE=ABC;AF=0.001;CADD=20;DB\tGT:DP\t0/1:10

chr1\t200\t.\tA\tG\t.\tPASS\tGENE=ABC;CSQ=stop_gained;AF=.\tGT:DP:GQ:VAF\t1|1:9:30:0.5
X\t300\tm\tA\tC,T\t9\tPASS\tAF=0.004,0.006;AF=0.1,0.2;CLNSIG=Benign\tGT\t1
"""


@pytest.fixture()
def vcf(tmp_path):
    path = tmp_path / "x.vcf"
    path.write_text(VCF)
    return str(path)


def test_read_vcf(spark, vcf):
    rows = {r.variant_id: r for r in V.read_vcf(spark, vcf).collect()}
    assert set(rows) == {"rs1", "chr1-200-A-G", "m:C", "m:T"}
    first, second, third, fourth = (rows[k] for k in ("rs1", "chr1-200-A-G", "m:C", "m:T"))
    assert (first.chromosome, first.gene, first.allele_frequency, first.cadd_score, first.zygosity) == ("1", "ABC", 0.001, 20.0, "heterozygous")
    assert (second.quality, second.allele_frequency, second.consequence) == (None, None, "stop_gained")
    assert second.calls["S1"].quality == 30 and second.calls["S1"].alternate_fraction == 0.5
    assert (third.allele_frequency, fourth.allele_frequency, fourth.zygosity) == (0.1, 0.2, "hemizygous")


def test_read_gzip(spark, tmp_path, vcf):
    path = tmp_path / "y.vcf.gz"
    path.write_bytes(gzip.compress(VCF.encode()))
    a = V.read_vcf(spark, str(path)).drop("path", "calls")
    assert row_difference(a, V.read_vcf(spark, vcf).drop("path", "calls")).count() == 0


@pytest.mark.parametrize(
    "text",
    [VCF.replace("##fileformat=VCFv4.2\n", ""), VCF.replace("#CHROM", "##x"), VCF.replace("FORMAT\tS1", "FORMAT\tS1\tS1")],
)
def test_bad_headers_are_refused(spark, tmp_path, text):
    path = tmp_path / "bad.vcf"
    path.write_text(text)
    with pytest.raises(DataCheckError):
        V.read_vcf(spark, str(path))


@pytest.mark.parametrize("old, new", [("CADD=20", "CADD=x"), (":0.5", ":1.5"), ("chr1\t100", "chr1\tx")])
def test_bad_values_stop_the_job(spark, tmp_path, old, new):
    path = tmp_path / "bad.vcf"
    path.write_text(VCF.replace(old, new))
    with pytest.raises(PySparkException):
        V.read_vcf(spark, str(path)).collect()


def test_contig_statistics(spark, vcf):
    rows = V.contig_statistics(V.read_lines(spark, vcf)).select("name", "length", "records").collect()
    assert {tuple(r) for r in rows} == {("chr1", 1000, 2), ("X", 500, 1)}


def test_strict_info_refuses_duplicates(spark):
    df = spark.createDataFrame([("A=1;A=2",)], "i string")
    assert df.select(fields.info_map(F.col("i"))["A"]).first()[0] == "2"
    with pytest.raises(PySparkException):
        df.select(fields.info_map(F.col("i"), strict=True)).collect()


OBO = """format-version: 1.2

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000002
name: Two
is_a: HP:0000001 ! All
is_a: HP:0000009 {x="y"}

[Typedef]
id: part_of
name: part of

[Term]
id: HP:0000003
name: Old
is_obsolete: true
replaced_by: HP:0000002

[Term]
id: HP:0000004
"""


def test_read_obo(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text(OBO)
    rows = {r.hpo_id: (r.label, r.parents, r.obsolete, r.replaced_by) for r in ST.read_obo(spark, str(path)).collect()}
    assert rows == {
        "HP:0000001": ("All", [], False, None),
        "HP:0000002": ("Two", ["HP:0000001", "HP:0000009"], False, None),
        "HP:0000003": ("Old", [], True, "HP:0000002"),
    }
    path.write_text("format-version: 1.2\n")
    with pytest.raises(DataCheckError):
        ST.read_obo(spark, str(path))


def test_official_associations(spark, tmp_path):
    path = tmp_path / "g.tsv"
    path.write_text("#description\n#ncbi_gene_id\tgene_symbol\thpo_id\tqualifier\n1\tabc\tHP:0000001\t\n2\tdef\tHP:0000002\tNOT\n")
    rows = ST.read_hpo_annotations(spark, str(path), "genes", "r1").select("gene", "qualifier", "release").collect()
    assert {tuple(r) for r in rows} == {("ABC", None, "r1"), ("DEF", "NOT", "r1")}
    path.write_text("ncbi_gene_id\tgene_symbol\thpo_id\n1\tabc\n")
    with pytest.raises(PySparkException):
        ST.read_hpo_annotations(spark, str(path), "genes", "r1").collect()


def test_associations_follow_the_header_of_their_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("gene\thpo_id\tevidence\nabc\tHP:0000001\tE1\n")
    (tmp_path / "b.tsv").write_text("# note\nterm_id\tdisease-id\tGene_Symbol\nHP:0000002\tD:1\tdef\n")
    rows = {tuple(r) for r in ST.read_associations(spark, str(tmp_path)).collect()}
    assert rows == {("ABC", "HP:0000001", None, "E1"), ("DEF", "HP:0000002", "D:1", None)}
    (tmp_path / "c.tsv").write_text("1\tabc\n")
    with pytest.raises(DataCheckError):
        ST.read_hpo_annotations(spark, str(tmp_path / "c.tsv"), "genes", "r1")


LAYOUT = ["Allele", "Consequence", "SYMBOL", "Gene", "Feature", "ALLELE_NUM", "gnomADe_AF", "gnomADg_AF"]


def annotated(spark, csq, gt="0/1"):
    info = f"AF=0.8;RDA_SOURCE_ROW=7;RDA_ALT_IDX=1;CSQ={csq}"
    f = ["1", "10", ".", "A", "C", "50", "PASS", info, "GT:GQ", f"{gt}:30"]
    return A.annotated_records(spark.createDataFrame([(f,)], "f array<string>"))


def test_annotation_import(spark, tmp_path):
    csq = "C|intron_variant|S1|E1|T1|1||,C|missense_variant&x|S1|E1|T2|1||,C|stop_gained||E2|T3|1||"
    tables = A.import_annotation(annotated(spark, csq), LAYOUT)
    rows = {r.gene: r for r in tables["variants"].collect()}
    assert set(rows) == {"S1", "E2"} and tables["consequences"].count() == 3
    assert (rows["S1"].consequence, rows["S1"].transcript, rows["S1"].allele_frequency) == ("missense_variant", "T2", None)
    W.write_annotation_tables(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/alleles.parquet")).columns[0] == "allele_id"


@pytest.mark.parametrize("csq", ["C|a|b", "C|x|S|E|T|2||", "C|x|S|E|T|1|1.5|"])
def test_bad_consequences_stop_the_job(spark, csq):
    with pytest.raises(PySparkException):
        rows = A.decode_csq(annotated(spark, csq), LAYOUT)
        A.population_frequency(rows, ["allele_id"]).collect()


def test_csq_layout():
    text = '##INFO=<ID=CSQ,Number=.,Type=String,Description="x. Format: ' + "|".join(LAYOUT) + '">'
    assert A.csq_layout(text) == LAYOUT
    with pytest.raises(DataCheckError):
        A.csq_layout(text.replace("SYMBOL", "NAME"))


def test_manifest(spark, tmp_path):
    out = tmp_path / "out"
    spark.range(10).repartition(2).write.json(str(out))
    saved = spark.createDataFrame(W.manifest(spark, str(out)).collect())
    assert W.verify(saved, W.manifest(spark, str(out))).count() == 0
    files = sorted(p for p in out.iterdir() if p.name.endswith(".json"))
    (out / f".{files[0].name}.crc").unlink()
    files[0].write_text("changed")
    (out / "extra.json").write_text("x")
    reasons = {r.reason for r in W.verify(saved, W.manifest(spark, str(out))).collect()}
    assert reasons == {"changed", "extra"}


def test_identity_depends_on_every_entry_but_not_on_their_order(spark):
    rows = [(f"k{i}", None if i == 3 else f"v{i}") for i in range(50)]

    def identity(entries):
        frame = spark.createDataFrame(entries, "key string, value string").repartition(3)
        return {r.identity for r in W.identity_rows(frame).collect()}

    first = identity(rows)
    assert len(first) == 1 and first == identity(rows[::-1])
    for other in (rows[1:], [*rows, rows[0]], [("k0", "x"), *rows[1:]], [("k3", ""), *(r for r in rows if r[0] != "k3")]):
        assert identity(other).isdisjoint(first)


def test_exported_ranks_lie_in_order(spark, tmp_path):
    ids = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.col("id").cast("string").alias("variant_id"))
    ranking = ids.select("run_id", F.lit("c").alias("context"), "variant_id", (301 - F.col("variant_id").cast("int")).alias("rank"))
    W.export_run(str(tmp_path / "x"), ids, ranking, ids)
    for run in ("r0", "r1"):
        seen = []
        for file in sorted((tmp_path / "x" / "ranking" / f"run_id={run}" / "context=c").glob("*.parquet")):
            seen += [r["rank"] for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert len(seen) == 150 and seen == sorted(seen)


def test_block_compressed_files_split_anywhere(spark, tmp_path):
    rng = random.Random(4)
    texts = {
        "a": ["".join(rng.choices("acgt\tü", k=rng.choice([0, 3, 80, 4_000]))) for _ in range(900)],
        "long": ["short", "x" * 700_000 + "y", "end", ""],  # a line over many splits
        "one": ["only line"],
    }
    rows = [(name, n, line) for name, lines in texts.items() for n, line in enumerate(lines, 1)]
    lines = spark.createDataFrame(rows, "path string, line_no long, value string")
    assert set(BL.write_blocks(lines, str(tmp_path / "b"))) == {f"{name}.gz" for name in texts}
    for name, held in texts.items():
        assert gzip.decompress((tmp_path / "b" / f"{name}.gz").read_bytes()).decode() == "".join(x + "\n" for x in held)
    for step in (1_000, 30_000, 1 << 20):
        read = V.read_lines(spark, str(tmp_path / "b"), block_compressed=True, split_bytes=step)
        got = sorted((r.path.rsplit("/", 1)[1][:-3], r.line_no, r.value) for r in read.collect())
        assert got == sorted(rows), step
    splits = BL.split_table(spark, str(tmp_path / "b"), 1_000).count()
    assert 100 < splits <= BL.CORE_SPLITS * spark.sparkContext.defaultParallelism + len(texts)


def test_block_compressed_vcf_equals_plain(spark, tmp_path, vcf):
    rows = [("y", n, line) for n, line in enumerate(VCF.split("\n")[:-1], 1)]
    BL.write_blocks(spark.createDataFrame(rows, "path string, line_no long, value string"), str(tmp_path / "z"))
    a = V.read_vcf(spark, str(tmp_path / "z"), block_compressed=True, split_bytes=50).drop("path", "calls")
    assert row_difference(a, V.read_vcf(spark, vcf).drop("path", "calls")).count() == 0


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(PySparkException):
        BL.read_blocks(spark, str(tmp_path)).collect()


def test_manifest_streams_files(spark, tmp_path):
    data = {"a": b"x" * 9_000_001, "b/c": b"y", "b/d": b"small"}
    for name, held in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(held)
    got = {r.path: (r.bytes, r.sha256) for r in W.manifest(spark, str(tmp_path)).collect()}
    assert got == {name: (len(held), hashlib.sha256(held).hexdigest()) for name, held in data.items()}


def test_splits_of_a_large_file_are_bounded_and_lines_read_once(spark, tmp_path):
    lines = spark.range(60_000).select(F.lit("a").alias("path"), F.col("id").alias("line_no"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    BL.write_blocks(lines, str(tmp_path / "a"))
    assert BL.split_table(spark, str(tmp_path / "a"), 100).count() <= BL.CORE_SPLITS * spark.sparkContext.defaultParallelism + 1
    read = V.read_lines(spark, str(tmp_path / "a"), block_compressed=True, split_bytes=100)
    assert "MapInArrow" not in read._jdf.queryExecution().toString()
    assert row_difference(read.select((F.col("line_no") - 1).alias("line_no"), "value"), lines.drop("path")).count() == 0
