"""Source accounting: dispositions, segments, shards and reference coverage of contigs."""

from __future__ import annotations

import hashlib
import re
from itertools import groupby
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom import constants as K
from varloom.functions import fields
from varloom.operators.ontology import components
from varloom.operators.ordering import place, rank_within
from varloom.session import materialize, require_empty, written
from varloom.sources.streams import file_digest, folder_entries, located

ELIGIBLE = "eligible_autosomal_sequence"
DIGEST_CHUNK = 500
#: Shard files of one folder, and folders of one task.
FOLDER_SHARDS, TASK_FOLDERS = 500, 4
SOURCE_FOLDER, SHARD_NAME = re.compile(r"^source=([^/]*)/block="), re.compile(r"^shard=(\d+)\.txt$")


def record_violations(records: DataFrame) -> DataFrame:
    """Records (fields array ``f``) that break the structural rules, with the reasons."""
    col = lambda i: F.get("f", F.lit(i))
    info = F.coalesce(col(7), F.lit(""))
    alts = F.split(col(4), ",")
    n_alt = F.when(col(4) == ".", 0).otherwise(F.size(alts))
    keys, calls = F.split(col(8), ":"), F.split(col(9), ":")
    gt_at = F.array_position(keys, F.lit("GT")).cast("int")
    gt = F.when(gt_at > 0, F.get(calls, gt_at - F.lit(1)))
    tokens = F.split(gt, "[/|]")
    tagged = fields.any_of(
        [info.rlike(rf"(^|;){tag}(=|;|$)") for tag in (K.SOURCE_ROW_TAG, K.SOURCE_ALT_TAG)]
    )
    rules = {
        "malformed_record": (F.size("f") != 10)
        | (col(0) == "")
        | ~col(1).rlike("^[0-9]+$")
        | (col(1).try_cast("bigint") < 1),
        "reserved_source_tag": tagged,
        "malformed_alleles": (col(3) == "")
        | F.exists(alts, lambda a: a == "")
        | (F.size(F.array_distinct(alts)) != F.size(alts))
        | (F.array_contains(alts, ".") & (F.size(alts) != 1)),
        "malformed_genotype_fields": (F.size(keys) != F.size(calls))
        | (F.size(F.array_distinct(keys)) != F.size(keys))
        | gt.isNull(),
        "malformed_genotype": ~F.coalesce(
            gt.rlike(r"^([0-9]+|\.)([/|]([0-9]+|\.))*$") & ~(gt.contains("/") & gt.contains("|")),
            F.lit(True),
        ),
        "genotype_above_alternates": F.exists(
            tokens, lambda a: F.coalesce(a.try_cast("int") > n_alt, F.lit(False))
        ),
    }
    return records.withColumn("reasons", fields.reasons(rules)).where(F.size("reasons") > 0)


def disposition(records: DataFrame) -> DataFrame:
    """Add ``n_alt`` and the first matching ``disposition`` of chrom, ref, alt text and genotype."""
    canonical = fields.strip_chr(F.col("chrom"))
    alts = F.split("alt_text", ",")
    sequence = F.col("reference").rlike("^[ACGT]+$") & F.forall(alts, lambda a: a.rlike("^[ACGT]+$"))
    ploidy = F.size(F.split("genotype", "[/|]"))
    return records.withColumn(
        "n_alt", F.when(F.col("alt_text") == ".", 0).otherwise(F.size(alts))
    ).withColumn(
        "disposition",
        F.when(canonical.isin("X", "Y"), "sex_chromosome_context_pending")
        .when(canonical.isin("M", "MT"), "mitochondrial_context_pending")
        .when(~canonical.isin(*K.AUTOSOMES), "nonstandard_contig_pending")
        .when(F.col("chrom") != canonical, "reference_alias_pending")
        .when(~sequence, "nonsequence_allele_pending")
        .when(ploidy != 2, "autosomal_ploidy_pending")
        .otherwise(ELIGIBLE),
    )


def ambiguous_aliases(records: DataFrame, source: str = "source") -> DataFrame:
    """Autosomes written under more than one name in a source (must be empty)."""
    named = records.select(source, "chrom", fields.strip_chr(F.col("chrom")).alias("contig"))
    return (
        named.where(F.col("contig").isin(*K.AUTOSOMES))
        .groupBy(source, "contig")
        .agg(F.min("chrom").alias("first_name"), F.max("chrom").alias("last_name"))
        .where("first_name <> last_name")
    )


def tag_source(records: DataFrame) -> DataFrame:
    """Append source row and ALT ordinals to ``info_text``; tagged input stops the job."""
    used = F.col("info_text").rlike(rf"(^|;)({K.SOURCE_ROW_TAG}|{K.SOURCE_ALT_TAG})(=|;|$)")
    n_alt = F.when(F.col("alt_text") == ".", 0).otherwise(F.size(F.split("alt_text", ",")))
    ordinals = F.when(
        n_alt > 0, F.array_join(F.transform(F.sequence(F.lit(1), n_alt), lambda i: i.cast("string")), ",")
    ).otherwise("")
    tags = F.concat(
        F.lit(f"{K.SOURCE_ROW_TAG}="),
        F.col("ordinal").cast("string"),
        F.lit(f";{K.SOURCE_ALT_TAG}="),
        ordinals,
    )
    return records.withColumn(
        "info_text",
        F.when(used, F.raise_error(F.lit("record already carries source tags")).cast("string"))
        .when(F.col("info_text") == ".", tags)
        .otherwise(F.concat_ws(";", "info_text", tags)),
    )


def accounting(records: DataFrame) -> DataFrame:
    """Records and alternate alleles per disposition, with a total row (disposition NULL)."""
    return records.rollup("disposition").agg(
        F.count(F.lit(1)).alias("source_records"), F.sum("n_alt").alias("alternate_alleles")
    )


def _runs(batches):
    """Runs of like records of sorted rows; ``edge`` marks the first and the last one of a slice (or of a part of it)."""
    held, last = [], None

    def rows():
        edge = [k in (0, len(held) - 1) for k in range(len(held))]
        names = ("source", "chromosome", "disposition", "first_row", "last_row")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(edge), *(pa.array(c, k) for c, k in zip(zip(*held), kinds))], names=["edge", *names]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in ("source", "chromosome", "disposition")]
        keys = [c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
        ordinal, slices = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ordinal", "_slice"))
        new = np.ones(len(ordinal), bool)
        new[1:] = (ordinal[1:] != ordinal[:-1] + 1) | (slices[1:] != slices[:-1])
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(ordinal)) - 1
        for first, end in zip(starts.tolist(), ends.tolist()):
            if held and slices[first] != last:
                yield rows()
                held = []
            last = slices[first]
            run = (*(c[first].as_py() for c in columns), int(ordinal[first]), int(ordinal[end]))
            if held and held[-1][:3] == run[:3] and held[-1][4] + 1 == run[3]:  # goes on from the batch before
                held[-1] = (*run[:3], held[-1][3], run[4])
            else:
                held.append(run)
    if held:
        yield rows()


def islands(records: DataFrame) -> DataFrame:
    """(source, first_row, last_row, chromosome, disposition) of runs of like records.

    One range sort of the narrow rows and one pass over its slices. Only the first and the last
    run of a slice can go on in another one; these few rows (two a slice) are put
    together in order, so a source of any length spreads.
    """
    narrow = records.select("source", F.col("ordinal").cast("long").alias("ordinal"), "chromosome", "disposition")
    placed = place(narrow, [F.col("source"), F.col("ordinal")])
    runs = materialize(
        placed.select("_slice", "source", "ordinal", "chromosome", "disposition").mapInArrow(
            _runs, "edge boolean, source string, chromosome string, disposition string, first_row long, last_row long"
        )
    )
    columns = ["source", "first_row", "last_row", "chromosome", "disposition"]
    along = Window.partitionBy("source").orderBy("first_row")
    kind = F.struct("chromosome", "disposition")
    goes_on = kind.eqNullSafe(F.lag(kind).over(along)) & (F.lag("last_row").over(along) + 1 == F.col("first_row"))
    edges = runs.where("edge").withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    joined = edges.withColumn("_n", F.sum("_new").over(along)).groupBy("source", "_n").agg(
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
        F.first("chromosome").alias("chromosome"), F.first("disposition").alias("disposition"),
    )
    return runs.where("not edge").select(*columns).unionByName(joined.select(*columns))


def _cut(islands: DataFrame, limit: int) -> DataFrame:
    """Cut eligible islands into pieces of ``limit`` records and number the shards."""
    length = F.col("last_row") - F.col("first_row") + 1
    eligible = F.col("disposition") == ELIGIBLE
    starts = F.when(
        eligible, F.sequence("first_row", "last_row", F.lit(limit).cast("bigint"))
    ).otherwise(F.array("first_row"))
    cut = islands.select(
        "source", "chromosome", "disposition", F.col("last_row").alias("_end"), length.alias("_len"),
        F.explode(starts).alias("first_row"),
    ).select(
        "source",
        "first_row",
        F.when(eligible, F.least(F.col("first_row") + F.lit(limit - 1), F.col("_end")))
        .otherwise(F.col("_end"))
        .alias("last_row"),
        "chromosome",
        "disposition",
    )
    shards = rank_within(
        cut.where(eligible).select("source", "first_row"), ["source"], [F.col("first_row")], "shard"
    )
    return cut.join(shards, ["source", "first_row"], "left")


def _overridden(found: DataFrame, limit: int, overrides: dict[tuple[str, int], int]) -> DataFrame:
    """Islands with one more break for every override.

    Shard numbers count after the overrides before; those of one source follow each other,
    those of different sources are applied together, as a table.
    """
    spark, rounds, nth = found.sparkSession, {}, {}
    for (source, shard), smaller in sorted(overrides.items()):
        if not 1 <= smaller <= limit:
            raise ValueError("an override may only lower the record limit")
        nth[source] = nth.get(source, 0) + 1
        rounds.setdefault(nth[source], []).append((source, shard, smaller))
    for _, rows in sorted(rounds.items()):
        asked = spark.createDataFrame(rows, "source string, shard long, smaller long")
        cut = materialize(asked.join(_cut(found, limit), ["source", "shard"], "left"))
        require_empty(cut.where("first_row is null"), "override names a shard that does not exist")
        at = cut.select("source", (F.col("first_row") + F.col("smaller")).alias("_at"))  # one row a source
        inside = F.coalesce((F.col("first_row") < F.col("_at")) & (F.col("last_row") >= F.col("_at")), F.lit(False))
        whole = F.array(F.struct(F.col("first_row").alias("f"), F.col("last_row").alias("l")))
        pieces = F.when(
            inside,
            F.array(
                F.struct(F.col("first_row").alias("f"), (F.col("_at") - 1).alias("l")),
                F.struct(F.col("_at").alias("f"), F.col("last_row").alias("l")),
            ),
        ).otherwise(whole)
        found = materialize(
            found.join(at, "source", "left").withColumn("_p", F.explode(pieces)).select(
                "source", F.col("_p.f").alias("first_row"), F.col("_p.l").alias("last_row"), "chromosome", "disposition"
            )
        )
    return found


def segment_bounds(
    records: DataFrame,
    limit: int = K.RECORDS_PER_SHARD,
    overrides: dict[tuple[str, int], int] | None = None,
) -> DataFrame:
    """Segments without their sums: source, first/last row, chromosome, disposition, shard.

    ``overrides`` maps (source, shard) to a smaller limit.
    """
    found = islands(records)
    return _cut(_overridden(materialize(found), limit, overrides) if overrides else found, limit)


def plan_segments(
    records: DataFrame,
    limit: int = K.RECORDS_PER_SHARD,
    overrides: dict[tuple[str, int], int] | None = None,
) -> DataFrame:
    """Complete coverage plan with counts and content digest of every segment.

    ``records``: source, ordinal, chromosome, disposition, n_alt, line. A record finds its
    segment by its bucket of rows and a range test. A segment of at most 500 records is
    the SHA-256 of its lines; a longer (deferred) one is hashed in chunks of 500 records and
    then over the chunk digests, twice, so no task ever holds a long segment.
    """
    bounds = materialize(segment_bounds(records, limit, overrides))
    placed = _with_segment(records, bounds.select("source", "first_row", "last_row"))
    key = ["source", "first_row"]
    level = placed.groupBy(
        *key, F.floor((F.col("ordinal") - F.col("first_row")) / F.lit(DIGEST_CHUNK)).alias("_c")
    ).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("n_alt").alias("alternate_alleles"),
        _digest(F.col("ordinal"), F.concat("line", F.lit("\n"))).alias("_d"),
    )
    for _ in range(2):
        level = level.groupBy(
            *key, F.floor(F.col("_c") / F.lit(DIGEST_CHUNK)).alias("_up")
        ).agg(
            F.sum("records").alias("records"),
            F.sum("alternate_alleles").alias("alternate_alleles"),
            F.when(F.count(F.lit(1)) == 1, F.any_value("_d"))
            .otherwise(_digest(F.col("_c"), F.col("_d")))
            .alias("_d"),
        ).withColumnRenamed("_up", "_c")
    sums = level.groupBy(*key).agg(
        F.sum("records").alias("records"),
        F.sum("alternate_alleles").alias("alternate_alleles"),
        F.when(F.count(F.lit(1)) == 1, F.any_value("_d"))
        .otherwise(_digest(F.col("_c"), F.col("_d")))
        .alias("records_sha256"),
    )
    return bounds.join(sums, key)


def _with_segment(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """Records with ``bounds`` columns of the interval (source, first_row, last_row) they lie in.

    An interval is listed once per bucket of rows it touches, so the join is on
    equal keys, no row is made per ordinal, and long intervals spread.
    """
    bucket = F.lit(K.RECORDS_PER_SHARD)
    cut = bounds.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("first_row") / bucket), F.floor(F.col("last_row") / bucket)))
    )
    return (
        records.withColumn("_bucket", F.floor(F.col("ordinal") / bucket))
        .join(cut, ["source", "_bucket"])
        .where(F.col("ordinal").between(F.col("first_row"), F.col("last_row")))
        .drop("_bucket")
    )


def _digest(order, text):
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]
    )
    return F.sha2(F.array_join(pieces, ""), 256)


def records_of_segments(records: DataFrame, segments: DataFrame) -> DataFrame:
    """Records (source, ordinal) that lie in the given segments."""
    return _with_segment(records, segments.select("source", "first_row", "last_row")).drop("first_row", "last_row")


def records_of_shards(records: DataFrame, bounds: DataFrame, first: int, last: int) -> DataFrame:
    """Records of a contiguous shard range with their shard number."""
    if not 1 <= first <= last:
        raise ValueError("shards are numbered from 1")
    wanted = bounds.where(F.col("shard").between(first, last)).select("source", "shard", "first_row", "last_row")
    return _with_segment(records, wanted).drop("first_row", "last_row")


def _write_shards(root: str):
    """Writer of sorted lines (source, shard, value): one file a shard, read again after it is written."""

    def run(batches):
        system, base = located(root)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("source", "shard", "value"))))
        folder, done = None, []
        for (source, shard), lines in groupby(rows, lambda r: r[:2]):
            inside = f"source={quote(source, safe='')}/block={shard // FOLDER_SHARDS}"
            if inside != folder:
                system.create_dir(f"{base}/{inside}", recursive=True)
                folder = inside
            name, sent = f"{inside}/shard={shard}.txt", hashlib.sha256()
            with system.open_output_stream(f"{base}/{name}") as out:
                for *_, value in lines:
                    line = value.encode("utf-8") + b"\n"
                    sent.update(line)
                    out.write(line)
            size, digest = file_digest(system, f"{base}/{name}")
            if digest != sent.hexdigest():
                raise OSError(f"{name} is not as it was written")
            done.append((source, shard, name, size, digest))
            if len(done) == FOLDER_SHARDS:
                yield _shard_rows(done)
                done = []
        if done:
            yield _shard_rows(done)

    return run


SHARD_FILE = "source string, shard long, path string, bytes long, sha256 string"


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    names = [f.split()[0] for f in SHARD_FILE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def write_shards(
    records: DataFrame, bounds: DataFrame, first: int, last: int, path: str, headers: DataFrame | None = None
) -> DataFrame:
    """Write a shard range as text and return its receipts, which are saved too.

    ``path/shards/source=../block=../shard=...txt`` is the file of a shard: the header lines of its
    source (``headers``: source, line_no, line) and its records in order. ``path/receipts`` holds
    one row per shard with its interval, its counts, and name, bytes and SHA-256 of the file
    as it was found after writing.

    The tasks write the files in place, whole folders of ``FOLDER_SHARDS`` shards each, so the
    driver neither moves nor lists them. A task that runs again writes the same files.
    """
    wanted = bounds.where(F.col("shard").between(first, last)).select("source", "shard", "first_row", "last_row")
    rows = records_of_shards(records, bounds, first, last).select(
        "source", "shard", F.lit(1).alias("_part"), "ordinal", F.col("line").alias("value")
    )
    if headers is None:
        lines = wanted.select("source", "shard", F.lit(0).cast("long").alias("header_lines"))
    else:
        opening = wanted.select("source", "shard").join(headers, "source").select(
            "source", "shard", F.lit(0).alias("_part"), F.col("line_no").cast("long").alias("ordinal"), F.col("line").alias("value")
        )
        rows = rows.unionByName(opening)
        held = headers.groupBy("source").agg(F.count(F.lit(1)).alias("header_lines"))
        lines = wanted.select("source", "shard").join(held, "source", "left").select("source", "shard", F.coalesce("header_lines", F.lit(0)).alias("header_lines"))
    spark = records.sparkSession
    # a number of its own: small rows would be put together to a few tasks, but files cost more than bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-wanted.count() // (FOLDER_SHARDS * TASK_FOLDERS)))
    files, _ = written(
        rows.repartition(tasks, "source", F.floor(F.col("shard") / F.lit(FOLDER_SHARDS)))
        .sortWithinPartitions("source", "shard", "_part", "ordinal")
        .select("source", F.col("shard").cast("long").alias("shard"), F.coalesce("value", F.lit("")).alias("value"))
        .mapInArrow(_write_shards(f"{path}/shards"), SHARD_FILE),
        "shard-files",
    )
    receipts = wanted.join(lines, ["source", "shard"]).join(files, ["source", "shard"]).select(
        "source", "shard", "first_row", "last_row", (F.col("last_row") - F.col("first_row") + 1).alias("records"), "header_lines",
        F.col("path").alias("file"), "bytes", "sha256",
    )
    receipts.write.parquet(f"{path}/receipts")
    return spark.read.schema(receipts.schema).parquet(f"{path}/receipts")


def _list_folders(root: str):
    """The folders right inside each given folder; paths are below ``root``."""

    def run(batches):
        system, base = located(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = folder_entries(system, f"{base}/{path}".rstrip("/"))
                names = [f"{path}/{e.base_name}".lstrip("/") for e in found if e.type == FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return run


def _hash_folders(root: str):
    """Rows of the text files that lie in each given folder."""

    def run(batches):
        system, base = located(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source = unquote(SOURCE_FOLDER.search(path).group(1)) if SOURCE_FOLDER.search(path) else None
                rows = []
                for entry in folder_entries(system, f"{base}/{path}".rstrip("/")):
                    if entry.type != FileType.File or entry.extension != "txt":
                        continue
                    number = SHARD_NAME.match(entry.base_name)
                    size, digest = file_digest(system, entry.path)
                    rows.append((source, int(number.group(1)) if number else None, f"{path}/{entry.base_name}".lstrip("/"), size, digest))
                if rows:
                    yield _shard_rows(rows)

    return run


def shard_files(spark, path: str) -> DataFrame:
    """source, shard, path, bytes and sha256 of the shard files that lie below ``path``.

    Listed and hashed by the tasks, folder by folder; the driver sees no file. A text file of another
    name or in another folder has no source or no shard.
    """
    root, level = f"{path}/shards", spark.createDataFrame([("",)], "path string")
    every = level
    for _ in range(2):  # sources, then blocks
        level = materialize(level.mapInArrow(_list_folders(root), "path string"))
        every = every.unionByName(level)
    every = materialize(every)
    tasks = max(spark.sparkContext.defaultParallelism, -(-every.count() // TASK_FOLDERS))
    return every.repartition(tasks, "path").mapInArrow(_hash_folders(root), SHARD_FILE)


def shard_violations(spark, path: str, bounds: DataFrame, first: int, last: int) -> DataFrame:
    """(source, shard, reason) of shards whose receipt or file is missing, extra or differs."""
    receipts = spark.read.parquet(f"{path}/receipts").select(
        "source", "shard", F.col("first_row").alias("_f"), F.col("last_row").alias("_l"), F.col("sha256").alias("_saved"), F.lit(1).alias("_r")
    )
    files = shard_files(spark, path).select("source", "shard", F.col("sha256").alias("_now"), F.lit(1).alias("_x"))
    planned = bounds.where(F.col("shard").between(first, last)).select("source", "shard", "first_row", "last_row", F.lit(1).alias("_p"))
    key = ["source", "shard"]
    every = planned.join(receipts, key, "full_outer").join(files, key, "full_outer")
    reason = (
        F.when(F.col("_p").isNull(), "not_planned")
        .when(F.col("_r").isNull(), "receipt_missing")
        .when(F.col("_x").isNull(), "file_missing")
        .when((F.col("_f") != F.col("first_row")) | (F.col("_l") != F.col("last_row")), "interval_differs")
        .when(F.col("_saved") != F.col("_now"), "file_differs")
    )
    return every.select(*key, reason.alias("reason")).where("reason is not null")


def even_sample(records: DataFrame, per_stratum: int, source: str = "source") -> DataFrame:
    """Evenly spaced records per source and chromosome: 0-based floor((2i+1)c / 2m), i < m.

    The test is arithmetic on a record's own ordinal in its stratum, so the
    targets need no join: ordinal t is taken when some i maps to it.
    """
    if per_stratum < 1:
        raise ValueError("take at least one record per stratum")
    keys = [source, "chromosome"]
    ranked = rank_within(records, keys, [F.col("ordinal")], "_t")
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    m = F.least("_c", F.lit(per_stratum))
    # the smallest i with (2i+1)c >= 2mt; it is a hit when its target is t itself
    t, c = F.col("_t") - 1, F.col("_c")
    i = F.greatest(F.ceil((F.lit(2) * m * t - c).cast("double") / (F.lit(2) * c)), F.lit(0))
    hit = (i < m) & (F.floor((F.lit(2) * i + 1) * c / (F.lit(2) * m)) == t)
    return ranked.join(counts, keys).where(hit).drop("_t", "_c")


def contig_coverage(stats: DataFrame, reference: DataFrame, cache: DataFrame) -> DataFrame:
    """Class of every contig (name, length, records) against reference lengths and cache."""
    joined = stats.join(
        reference.select("name", F.col("length").alias("_ref")), "name", "left"
    ).join(cache.select("name", F.lit(True).alias("_cached")), "name", "left")
    canonical = fields.strip_chr(F.col("name"))
    return joined.select(
        "name",
        "length",
        "records",
        F.when(F.col("_ref").isNull(), "reference_missing")
        .when(F.col("_ref") != F.col("length"), "reference_length_mismatch")
        .when(F.col("_cached").isNull(), "annotation_cache_missing")
        .when(canonical.isin(*K.AUTOSOMES), "autosomal_reference_and_cache_available")
        .when(canonical.isin("X", "Y"), "sex_chromosome_context_pending")
        .when(canonical.isin("M", "MT"), "mitochondrial_model_pending")
        .otherwise("nonstandard_context_pending")
        .alias("category"),
    )


def coverage_totals(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("contigs"), F.sum("records").alias("records")
    )


def contig_collisions(names: DataFrame) -> DataFrame:
    """Standard contigs that several names map to (must be empty)."""
    return (
        names.select("name", fields.canonical_contig(F.col("name")).alias("target"))
        .where("target is not null")
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("names"))
        .where("names > 1")
    )


def alias_proposals(stats: DataFrame, reference: DataFrame, cache: DataFrame) -> DataFrame:
    """Names absent from the reference whose standard name fits by length and is cached."""
    named = stats.withColumn("target", fields.canonical_contig(F.col("name")))
    present = reference.select("name")
    targets = reference.select(F.col("name").alias("target"), F.col("length").alias("_ref"))
    return (
        named.where("target is not null and target <> name")
        .join(present, "name", "left_anti")
        .join(targets, "target")
        .where(F.col("_ref") == F.col("length"))
        .join(cache.select(F.col("name").alias("target")), "target", "left_semi")
        .select("name", "target", "records")
    )


def synonym_plan(
    stats: DataFrame,
    reference: DataFrame,
    cache: DataFrame,
    synonyms: DataFrame,
    prefixes: bool = False,
    check: bool = True,
) -> DataFrame:
    """Reference target of every contig through transitive synonyms (left, right).

    ``prefixes`` also links ``chrN`` to ``N`` for names in the synonym table, and
    ``M`` to ``MT`` when the reference has it.
    """
    edges = synonyms.select("left", "right")
    if prefixes:
        names = edges.select(F.explode(F.array("left", "right")).alias("left"))
        bare = names.where(F.col("left").startswith("chr") & (F.length("left") > 3)).select(
            "left", F.substring("left", F.lit(4), F.length("left")).alias("right")
        )
        mito = reference.where(F.col("name") == "MT").select(
            F.col("name").alias("left"), F.lit("M").alias("right")
        )
        edges = edges.unionByName(bare).unionByName(mito)
    groups = components(
        edges,
        stats.select(F.col("name").alias("node")).unionByName(
            reference.select(F.col("name").alias("node"))
        ),
    )
    located = reference.join(groups.withColumnRenamed("node", "name"), "name")
    targets = located.groupBy("component").agg(
        F.count(F.lit(1)).alias("_targets"), F.min("name").alias("_only")
    )
    exact = reference.select("name", F.lit(True).alias("_exact"))
    lengths = reference.select(F.col("name").alias("target"), F.col("length").alias("_ref"))
    joined = (
        stats.join(groups.withColumnRenamed("node", "name"), "name", "left")
        .join(targets, "component", "left")
        .join(exact, "name", "left")
        .withColumn(
            "target",
            F.when(F.col("_exact"), F.col("name")).when(F.col("_targets") == 1, F.col("_only")),
        )
        .join(lengths, "target", "left")
        .join(cache.select(F.col("name").alias("target"), F.lit(True).alias("_cached")), "target", "left")
    )
    plan = joined.select(
        F.col("name").alias("source_name"),
        "target",
        "length",
        "records",
        F.when(F.col("_exact").isNull() & F.col("_targets").isNull(), "reference_missing")
        .when(F.col("target").isNull(), "ambiguous_reference")
        .when(F.col("_ref") != F.col("length"), "reference_length_mismatch")
        .when(F.col("_cached").isNull(), "annotation_cache_missing")
        .when(F.col("name") == F.col("target"), "exact_reference_available")
        .otherwise("synonym_reference_available")
        .alias("status"),
    )
    if check:
        usable = plan.where(
            F.col("target").isNotNull() & (F.col("status") != "reference_length_mismatch")
        )
        require_empty(
            usable.groupBy("target").count().where("count > 1"),
            "source contigs collide on one reference target",
        )
    return plan
