"""Rules of the clinical and assay domain, as data.

``rules`` gives the attribute rules that ``validate.checked`` takes, ``SHAPES`` the shapes
of kinds for ``validate.shape_errors``, ``TECHNOLOGIES`` which assay technologies
measured attributes come from.  Other domains give documents of the same form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Attributes by the rule that they keep.
NON_NEGATIVE = """
measurement: cell-count tpm fpkm rpkm rsem-raw-count rsem-scaled-estimate rsem-normalized-count nanostring-count
 t-alt-count t-ref-count t-depth n-alt-count n-ref-count n-depth singlets-count live-count lymphocyte-count leukocyte-count
 nuclei-count average-depth read-count read-count-otu read-count-otu-rarefied tss-score cfdna-ng-mL pg-mL ng-mL U-L
 nanostring-signature-score chromvar-tf-binding-score tmb-indel tmb-snv tmb-total absolute-cn total-reads tcr-count
clinical-observation: pfs dfi os ttf bmi ldh absolute-leukocyte-count absolute-monocyte-count
atac-peak: -log10pvalue -log10qvalue quality-score summit-offset
subject: age
"""
ZERO_TO_ONE = """
measurement: vaf percent-of-total-cells percent-of-parent percent-of-nuclei percent-of-lymphocytes percent-of-leukocytes
 percent-of-live live-percent percent-of-singlets tcr-frequency tcr-clonality tcr-alpha-clonality tcr-beta-clonality
 baf-n baf fraction-aligned-reads tumor-purity contamination fraction-reads-in-peaks
sample: purity
"""
POSITIVE = """
timepoint: relative-order
therapy: line order
"""
OTHER_RULES = {
    "measurement/a-allele-cn": ("between", -2, 50),
    "measurement/b-allele-cn": ("between", -2, 50),
    "measurement/cnv-call": ("one_of", "measurement.cnv-call/amplified", "measurement.cnv-call/reduced", "measurement.cnv-call/neutral"),
    "measurement/msi-status": ("one_of", "measurement.msi-status/msi-h", "measurement.msi-status/msi-l", "measurement.msi-status/stable"),
    "variant/ref-amino-acid": ("alphabet",),
    "variant/alt-amin-acid": ("alphabet",),
    "dataset/name": ("max_length", 256),
    "timepoint/offset": ("integer",),
    "genomic-coordinate/id": ("composite_of", ":", "assembly", "contig", "strand", "start", "end"),
    "variant/id": ("composite_of", "/", "genomic-coordinates", "ref-allele", "alt-allele"),
}

# What a measurement of each target has (beside id, uid, sample and the target) and may have.
_TARGETS = """
cell-population: region-of-interest epitope percent-of-total-cells median-channel-value cell-count percent-of-nuclei percent-of-lymphocytes
 percent-of-leukocytes percent-of-live percent-of-parent percent-of-singlets
variant: t-alt-count t-ref-count t-depth n-alt-count n-ref-count n-depth vaf
cnv: a-allele-cn b-allele-cn cnv-call segment-mean-lrr loh baf baf-n absolute-cn
gene-product: tpm fpkm rpkm rsem-raw-count rsem-scaled-estimate rsem-normalized-count array-log-intensity array-log-ratio nanostring-count read-count
epitope: median-channel-value luminex-mfi protein-array-log-intensity pg-mL ng-mL U-L olink-npx nanostring-count
tcr: tcr-frequency tcr-count tcr-v tcr-d tcr-j
nanostring-signature: +nanostring-signature-score
atac-peak: +read-count
otu: read-count-otu read-count-otu-rarefied
none: region-of-interest msi-status tcr-clonality tcr-alpha-clonality tcr-beta-clonality cell-count singlets-count live-count lymphocyte-count
 leukocyte-count nuclei-count live-percent average-depth fraction-aligned-reads tumor-purity contamination tss-score fraction-reads-in-peaks
 cfdna-ng-mL tmb-indel tmb-snv tmb-total total-reads
"""
# Attributes of measurements that are no value (the sequences of a receptor, a region, a target), beyond the ones above that are.
_NO_VALUE = "region-of-interest epitope tcr-v tcr-d tcr-j cnv-call"
_ALSO_VALUE = "chromvar-tf-binding-score nanostring-signature-score variant"

# What other kinds must have.
_REQUIRED = """
sample: id uid subject
dataset: name samples assays timepoints subjects
assay: uid name measurement-sets technology
clinical-observation: id uid subject timepoint
adverse-event: id uid subject meddra-adverse-event
genomic-coordinate: id assembly contig start end strand
variant: id genomic-coordinates ref-allele alt-allele
gene: hgnc-symbol hgnc-id hgnc-name
protein: uniprot-name uniprot-accessions preferred-name
subject: id uid
treatment-regimen: name uid
therapy: id uid treatment-regimen order
cnv: genomic-coordinates
drug-regimen: uid drug
clinical-trial: nct-number
atac-peak: name genomic-coordinates jointly-called fixed-width
otu: id kingdom
meddra-disease: preferred-name synonyms
gdc-anatomic-site: name
gene-product: id gene
epitope: id protein
single-cell: id
nanostring-signature: name gene-weights
study-day: id uid day reference-event
import: name user
"""
_ONE_OF = {
    "measurement-set": (("uid", "name"), (("measurements",), ("measurement-matrices",))),
    "clinical-observation-set": (("uid", "name"), (("clinical-observations",), ("adverse-events",))),
    "tcr": (("id",), (("alpha-1",), ("beta",))),
    "cell-population": (("name", "from-clustering"), ()),
    "timepoint": (("id", "uid", "type"), ()),
}
_MATRIX = ("backing-file name samples uid measurement-type", "gene-products epitopes single-cells cell-populations")

# The technologies that attributes of measurements come from.
_TECHNOLOGIES = """
nanostring: nanostring-count nanostring-signature-score > nanostring
tcr: tcr-clonality tcr-frequency tcr-v tcr-d tcr-j > TCR-seq
sequencing: segment-mean-lrr a-allele-cn b-allele-cn baf-n baf loh average-depth fraction-aligned-reads tumor-purity contamination > WES WGS
variant: t-ref-count t-alt-count t-depth n-ref-count n-alt-count n-depth vaf > WES WGS dPCR
single-cell: median-channel-value cell-count percent-of-parent percent-of-lymphocytes percent-of-leukocytes percent-of-live percent-of-singlets
 singlets-count live-count lymphocyte-count leukocyte-count nuclei-count > mass-cytometry flow-cytometry vectra IHC IMC CODEX
rnaseq: tpm fpkm rpkm rsem-normalized-count rsem-raw-count rsem-scaled-estimate > RNA-seq
atacseq: fraction-reads-in-peaks tss-score chromvar-tf-binding-score > ATAC-seq
"""


def _groups(text: str) -> dict[str, list[str]]:
    """Lines ``name: word word``, which go on in lines that begin with a space."""
    out: dict[str, list[str]] = {}
    name = ""
    for line in text.strip("\n").split("\n"):
        if not line.startswith(" "):
            name, _, line = line.partition(":")
        out.setdefault(name, []).extend(line.split())
    return out


def rules() -> dict[str, tuple]:
    """``{kind/attribute: (rule, parameter, ...)}``."""
    out: dict[str, tuple] = {}
    for text, rule in ((NON_NEGATIVE, "non_negative"), (ZERO_TO_ONE, "zero_to_one"), (POSITIVE, "positive")):
        out |= {f"{kind}/{name}": (rule,) for kind, names in _groups(text).items() for name in names}
    return out | OTHER_RULES


def _measurement() -> dict[str, object]:
    base = ["id", "uid", "sample"]
    closed, values = {}, list(_ALSO_VALUE.split())
    for target, names in _groups(_TARGETS).items():
        more = [n[1:] for n in names if n.startswith("+")]
        optional = [n for n in names if not n.startswith("+")]
        closed[target] = {"required": [*base, *([] if target == "none" else [target]), *more], "optional": optional}
        values += [*more, *optional]
    return {"required": base, "value": [v for v in dict.fromkeys(values) if v not in _NO_VALUE.split()], "closed": closed}


#: ``{kind: shape}`` as ``validate.shape_errors`` takes it.
SHAPES: Mapping[str, Mapping[str, object]] = {
    **{kind: {"required": names} for kind, names in _groups(_REQUIRED).items()},
    **{kind: {"required": required, "one_of": groups} for kind, (required, groups) in _ONE_OF.items()},
    "measurement": _measurement(),
    "measurement-matrix": {"closed": {"matrix": {"required": _MATRIX[0].split(), "optional": _MATRIX[1].split()}}},
}

#: ``{rule: {"attributes", "allowed"}}`` as ``validate.measured_technologies`` takes it.
TECHNOLOGIES: Mapping[str, Mapping[str, Sequence[str]]] = {
    name: {"attributes": words[: words.index(">")], "allowed": [f"assay.technology/{t}" for t in words[words.index(">") + 1 :]]} for name, words in _groups(_TECHNOLOGIES).items()
}

#: Rules for the query front end: the technology of a measurement, by its set and assay.
QUERY_RULES = [
    [["measurement-technology", "?m", "?t"], ["?m", "measurement/_parent", "?e"], ["?e", "measurement-set/_parent", "?a"], ["?a", "assay/technology", "?t"]],
]


def technology_queries() -> list[dict[str, object]]:
    """The technology rules as queries of measurements and technologies that a rule doesn't allow; each expects no row."""
    out = []
    for name, rule in TECHNOLOGIES.items():
        have = ["or-join", ["?m"], *[[["?m", f"measurement/{a}"]] for a in rule["attributes"]]]
        tests = [[["!=", "?t", t]] for t in rule["allowed"]]
        out.append({"name": f"{name}-measurements-technology", "query": {"find": ["?m", "?t"], "in": ["%"], "where": [have, ["measurement-technology", "?m", "?t"], *tests]}, "allowed": []})
    return out


#: The orders of each subject's therapies run from 1 to their number.
THERAPY_ORDER = {
    "name": "subject-therapies-order",
    "query": {"find": ["?s", ["count", "?t", "n"]], "where": [["?s", "subject/therapies", "?t"], ["?t", "therapy/order", "?o"]]},
    "allowed": {"find": ["?s", ["max", "?o", "n"]], "where": [["?s", "subject/therapies", "?t"], ["?t", "therapy/order", "?o"]]},
}
