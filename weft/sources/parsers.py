"""Scans of reference-data files: ontologies, fixed widths, dollar signs, markup, lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import exprs


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an ontology file: ``id, name, definition, is_a``; stanzas of other types and terms of one line are left out.

    A stanza starts at a line in brackets; trailing comments (``! ...``) go.
    """
    stanzas = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=\[[^\]\n]*\]\s*$)")).alias("s"))
    lines = stanzas.where(F.col("s").startswith("[Term]")).select(
        F.filter(F.transform(F.split("s", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("[")).alias("lines")
    )

    def fields(name: str):
        own = F.filter("lines", lambda x: x.startswith(f"{name}:"))
        return F.transform(own, lambda x: F.regexp_extract(x, rf"^{name}:\s*(.*?)(?:\s+!\s.*)?$", 1))

    terms = lines.where(F.size("lines") > 1).select(
        F.get(fields("id"), F.lit(0)).alias("id"),
        F.get(fields("name"), F.lit(0)).alias("name"),
        F.regexp_extract(F.get(fields("def"), F.lit(0)), r'^"((?:[^"\\]|\\.)*)"', 1).alias("definition"),
        F.array_sort(F.array_distinct(fields("is_a"))).alias("is_a"),
    )
    return terms


def cell_types(terms: DataFrame) -> DataFrame:
    """Terms of the cell ontology only."""
    return terms.where(F.col("id").startswith("CL:"))


def fixed_width(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``{name: (first column from 1, width)}`` of each line, trimmed; empty fields are null."""
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.nullif(F.trim(F.substring("value", at, width)), F.lit("")).alias(n) for n, (at, width) in fields.items()])


def dollar(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Fields parted by dollar signs; what stands after the last name is left out."""
    parts = F.split("value", r"\$")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def with_lower_level(preferred: DataFrame, lower: DataFrame, key: str, name: str) -> DataFrame:
    """Preferred terms with the set of lower-level names that point at them."""
    grouped = lower.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(name)).alias("synonyms"))
    return preferred.join(grouped, F.col(key) == F.col("_key"), "left").drop("_key")


def id_mapping(spark: SparkSession, path: str, kind: str = "Gene_Name") -> DataFrame:
    """``id, value`` of a three-column mapping's rows of one kind; of several values of an id the last in the file wins."""
    parts = F.split("value", "\t")
    rows = lines_in_order(spark, path).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("value"), "_at")
    return rows.where(F.col("kind") == kind).groupBy("id").agg(F.max_by("value", "_at").alias("value"))


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of each line and ``_at``, which sorts as lines stand in their files, however files are split."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", at.alias("_at"))


def coordinates(rows: DataFrame, assembly: str, contig: str = "contig", strand: str = "strand", start: str = "start", end: str = "end") -> DataFrame:
    """Genomic coordinates with their composite id; rows without a start are left out."""
    there = rows.where(F.trim(F.coalesce(F.col(start), F.lit(""))) != "")
    return there.select(F.concat_ws(":", F.lit(assembly), *[F.trim(F.col(c)) for c in (contig, strand, start, end)]).alias("id"), F.lit(assembly).alias("assembly"), contig, strand, F.col(start).try_cast("bigint").alias("start"), F.col(end).try_cast("bigint").alias("end"))


def xml_entries(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Elements of one tag as rows."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


#: The codes of modified residues.
RESIDUES = {"Phosphotyrosine": "pY", "Phosphoserine": "pS", "Phosphothreonine": "pT"}
#: Locus groups and the enum values they stand for.
LOCUS_GROUPS = {
    "protein-coding gene": "gene.hgnc-locus-group/protein-coding-gene",
    "non-coding RNA": "gene.hgnc-locus-group/non-coding-rna",
    "pseudogene": "gene.hgnc-locus-group/pseudogene",
    "withdrawn": "gene.hgnc-locus-group/withdrawn",
    "other": "gene.hgnc-locus-group/other",
    "phenotype": "gene.hgnc-locus-group/phenotype",
}
#: Seed data that needs a licence, and seed data that isn't there yet.
PROPRIETARY = ("nanostring-signatures", "drugs", "diseases")
PENDING = ("proteins-epitopes", "so-sequence-features")


#: The parts of a protein entry that are read.
PROTEIN_XML = """accession array<string>, name array<string>,
protein struct<recommendedName: struct<fullName: string, shortName: array<string>>, alternativeName: array<struct<fullName: string, shortName: array<string>>>, cdAntigenName: array<string>>,
organism struct<name: array<struct<_VALUE: string, _type: string>>>,
comment array<struct<_type: string, isoform: array<struct<name: array<struct<_VALUE: string, _evidence: string>>>>>>,
feature array<struct<_type: string, _description: string, location: struct<position: struct<_position: string>>>>"""


def proteins(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """Human proteins of a markup file: names, accessions, synonyms, the gene of the first accession, and ``epitopes``.

    ``genes`` is ``(id, value)`` as ``id_mapping`` gives it.  Epitopes are named isoforms and
    phosphorylated residues, each once.  Text of elements with attributes is read as is.
    """
    raw = spark.read.format("xml").option("rowTag", "entry").schema(PROTEIN_XML).load(path)
    human = F.exists("organism.name", lambda n: (n["_type"] == "scientific") & (n["_VALUE"] == "Homo sapiens"))
    name = F.regexp_replace(F.get("name", F.lit(0)), "_HUMAN", "")
    synonyms = F.concat(
        F.coalesce("protein.recommendedName.shortName", F.array()),
        F.flatten(F.filter(F.coalesce("protein.alternativeName.shortName", F.array()), lambda x: x.isNotNull())),
        F.filter(F.coalesce("protein.alternativeName.fullName", F.array()), lambda x: x.isNotNull()),
    )
    named = F.filter(F.coalesce("comment", F.array()), lambda c: c["_type"] == "alternative products")
    isoforms = F.flatten(F.transform(named, lambda c: F.flatten(F.transform(F.coalesce(c["isoform"], F.array()), lambda i: F.transform(F.filter(i["name"], lambda n: n["_evidence"].isNotNull()), lambda n: n["_VALUE"])))))
    residues = F.filter(F.coalesce("feature", F.array()), lambda f: f["_type"] == "modified residue")

    def code(feature: Column) -> Column:
        found = F.lit(None).cast("string")
        for text, short in reversed(RESIDUES.items()):
            found = F.when(feature["_description"].contains(text), F.lit(short)).otherwise(found)
        return F.concat(found, feature["location"]["position"]["_position"])

    epitopes = F.array_distinct(F.concat(isoforms, F.filter(F.transform(residues, code), lambda x: x.isNotNull())))
    out = raw.where(human).select(
        name.alias("uniprot_name"), F.col("protein.recommendedName.fullName").alias("preferred_name"), F.get("protein.cdAntigenName", F.lit(0)).alias("cd_antigen"),
        F.col("accession").alias("accessions"), synonyms.alias("synonyms"), epitopes.alias("epitopes"),
    )
    if genes is None:
        return out.withColumn("gene", F.lit(None).cast("string"))
    return out.join(genes.select(F.col("id").alias("_id"), F.col("value").alias("gene")), F.get("accessions", F.lit(0)) == F.col("_id"), "left").drop("_id")


def epitopes(proteins: DataFrame) -> DataFrame:
    """``id, protein``: each protein as an epitope of its own name, and one for each of its ``epitopes``."""
    own = F.concat(F.array(F.col("uniprot_name")), F.transform("epitopes", lambda e: F.concat_ws("/", F.col("uniprot_name"), e)))
    return proteins.select(F.explode(own).alias("id"), F.col("uniprot_name").alias("protein"))


def of_known_genes(proteins: DataFrame, genes: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Proteins without a gene, and those whose gene is known."""
    known = genes.select(F.col(symbol).alias("_symbol")).distinct()
    return proteins.join(known, F.col("gene") == F.col("_symbol"), "left").where("gene IS NULL OR _symbol IS NOT NULL").drop("_symbol")


def genes(rows: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """Genes from the nomenclature's table, without withdrawn loci; empty cells are no value.

    ``coordinates`` is ``(gene_id, coordinate)``.
    """
    cell = lambda c: F.nullif(F.col(c), F.lit(""))
    locus = F.create_map(*[F.lit(x) for pair in LOCUS_GROUPS.items() for x in pair])
    out = rows.select(
        cell("symbol").alias("symbol"), cell("hgnc_id").alias("hgnc_id"), cell("name").alias("name"),
        *[exprs.piped(F.col(c)).alias(c) for c in ("alias_symbol", "alias_name", "prev_symbol", "prev_name")],
        cell("refseq_accession").alias("refseq_accession"), cell("ensembl_gene_id").alias("ensembl_gene_id"), locus[F.col("locus_group")].alias("locus_group"),
        *[exprs.to_date(F.col(c)).alias(c) for c in ("date_symbol_changed", "date_name_changed")],
    ).where(~F.col("locus_group").eqNullSafe(LOCUS_GROUPS["withdrawn"]))
    if coordinates is None:
        return out
    return out.join(coordinates.select(F.col("gene_id").alias("_g"), "coordinate"), F.col("hgnc_id") == F.col("_g"), "left").drop("_g")


def gene_products(genes: DataFrame) -> DataFrame:
    return genes.select(F.col("symbol").alias("id"), F.col("symbol").alias("gene"))


def open_datasets(names: Sequence[str]) -> list[str]:
    """Seed data that anyone may use and that is there."""
    return [n for n in names if n not in PROPRIETARY and n not in PENDING]


def corrected(df: DataFrame, column: str, corrections: Mapping[str, str | None], delimiter: str = ";") -> DataFrame:
    """A column of delimited symbols with some replaced, and those corrected to nothing left out; a list that empties is null."""
    table = F.create_map(*[F.lit(x) for pair in corrections.items() for x in pair]) if corrections else None
    parts = F.split(F.col(column), exprs.delimiter_pattern(delimiter))
    if table is not None:
        kept = F.filter(F.transform(parts, lambda x: F.when(x.isin(list(corrections)), table[x]).otherwise(x)), lambda x: x.isNotNull())
    else:
        kept = parts
    return df.withColumn(column, F.when(F.size(kept) > 0, F.array_join(kept, delimiter)))


def enum_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The values of a list inside a YAML document; the document is small, but may lie in any store that Spark reads."""
    found = yaml.safe_load(spark.read.text(path, wholetext=True).first().value)
    for part in key.split("."):
        found = found[part]
    return spark.createDataFrame([(str(v),) for v in found], "name string").distinct()
