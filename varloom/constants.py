"""Fixed values of the data model.

Everything here must keep exactly these values: they decide scores, labels and
file layouts, and saved outputs are compared against them.
"""

# --- Fixed values: molecular consequence scores -----------------------------
CONSEQUENCE_SCORES = {
    "transcript_ablation": 1.0,
    "stop_gained": 1.0,
    "frameshift_variant": 1.0,
    "splice_acceptor_variant": 0.9,
    "splice_donor_variant": 0.9,
    "start_lost": 0.85,
    "stop_lost": 0.85,
    "missense_variant": 0.7,
    "inframe_insertion": 0.6,
    "inframe_deletion": 0.6,
    "synonymous_variant": 0.15,
    "intron_variant": 0.1,
    "intergenic_variant": 0.05,
}
DEFAULT_CONSEQUENCE_SCORE = 0.1

# --- Fixed values: ranking features, modes and weight sets ------------------
FEATURES = ("quality", "rarity", "consequence", "phenotype", "inheritance")
MODES = {
    "filtering_only": ("quality", "rarity", "consequence"),
    "filtering_phenotype": ("quality", "rarity", "consequence", "phenotype"),
    "filtering_inheritance": ("quality", "rarity", "consequence", "inheritance"),
    "filtering_phenotype_inheritance": FEATURES,
}
BASE_MODE = "filtering_phenotype_inheritance"
DEFAULT_WEIGHTS = (0.10, 0.20, 0.15, 0.30, 0.25)
STRATEGIES = {
    "baseline": (0.10, 0.35, 0.35, 0.10, 0.10),
    "phenotype-heavy": (0.10, 0.15, 0.10, 0.55, 0.10),
    "inheritance-heavy": (0.10, 0.15, 0.10, 0.10, 0.55),
    "pathogenicity-heavy": (0.10, 0.20, 0.50, 0.10, 0.10),
    "ensemble": (0.10, 0.20, 0.15, 0.30, 0.25),
    "conservative": (0.10, 0.20, 0.15, 0.30, 0.25),
}

# --- Fixed values: thresholds and limits ------------------------------------
RARE_FREQUENCY = 0.01
PHENOTYPE_PRIORITY = 0.35
INHERITANCE_PRIORITY = 0.8
STRONG_FIT = 0.8
UNCERTAIN_FIT = 0.4
MIN_GENOTYPE_QUALITY = 20.0
MIN_ALTERNATE_FRACTION = 0.25
RECORDS_PER_SHARD = 500
MAX_LINE_BYTES = 4 * 1024 * 1024
MAX_ANCHORS = 100
MAX_INDIVIDUALS = 1000
MAX_HYPOTHESES = 10

# --- Fixed values: vocabularies ---------------------------------------------
PLACEHOLDER_GENES = ("", ".", "UNKNOWN", "UNASSIGNED")
HET_GENOTYPES = ("0/1", "1/0", "0|1", "1|0")
AUTOSOMES = tuple(str(n) for n in range(1, 23))
STANDARD_CONTIGS = AUTOSOMES + ("X", "Y", "MT")
PHENOTYPE_METHOD = "resnik_bma"
SINGLE_MODELS = (
    "de_novo",
    "autosomal_dominant",
    "homozygous_recessive",
    "x_linked",
    "autosomal_recessive",
)
EXCLUSIVE_MODELS = ("de_novo", "autosomal_dominant", "x_linked", "autosomal_recessive")
HIGH_IMPACT_CONSEQUENCES = (
    "frameshift_variant",
    "missense_variant",
    "splice_acceptor_variant",
    "splice_donor_variant",
    "stop_gained",
)
PAIR_PHASES = ("confirmed_trans", "possible_trans", "unknown")

# --- Fixed values: text formats ---------------------------------------------
SOURCE_ROW_TAG = "RDA_SOURCE_ROW"
SOURCE_ALT_TAG = "RDA_ALT_IDX"
VCF_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
TERM_PATTERN = r"HP:\d{7}"
POLARITY_PATTERN = r"(?i)\b(absent|negative|denied|excluded|not present)\b"
REQUIRED_CSQ_FIELDS = ("Allele", "ALLELE_NUM", "Consequence", "Gene", "Feature", "SYMBOL")
POPULATION_FIELDS = ("gnomADe_AF", "gnomADg_AF")
SUBMISSION_COLUMNS = (
    "proband_id",
    "chrom_1",
    "pos_1",
    "ref_1",
    "alt_1",
    "chrom_2",
    "pos_2",
    "ref_2",
    "alt_2",
    "epcr",
    "finding_type",
    "notes",
)
NOTES_TEMPLATE = (
    "Research hypothesis: {reason}; saved phase={phase}; "
    "subjective uncalibrated rank EPCR (q=0.50,d=0.80); "
    "top-100 BASE_MODE anchor bound; 28 correlated contexts, no vote; "
    "linkage and affected-status uncertainty retained"
)
SENSITIVE_FRAGMENTS = (
    "patient",
    "phenotype",
    "genotype",
    "variant",
    "vcf",
    "token",
    "secret",
    "password",
    "api_key",
)
SECRET_PATTERNS = {
    "Hugging Face access token": r"\bhf_[A-Za-z0-9]{20,}\b",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "generic credential assignment": (
        r"(?i)\b(?:api[_-]?key|access[_-]?token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+]{16,}"
    ),
}
BLOCKED_DIRECTORIES = (
    "private_data",
    "private_runs",
    "private_cache",
    "models",
    "cache",
    "secrets",
    "tokens",
)
BLOCKED_SUFFIXES = (
    ".vcf",
    ".vcf.gz",
    ".vcf.gz.tbi",
    ".gvcf",
    ".gvcf.gz",
    ".bcf",
    ".bam",
    ".bai",
    ".cram",
    ".crai",
    ".fastq",
    ".fastq.gz",
    ".fq",
    ".fq.gz",
    ".ped",
    ".parquet",
    ".duckdb",
    ".duckdb.wal",
    ".resource",
    ".tar.gz",
    ".zip",
)
