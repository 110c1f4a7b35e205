"""Vocabularies of the catalogue. Order matters wherever rules are tried in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Results depend on these words, letters and their order.

#: Level-1 category: long name, short name.
CATEGORIES = (
    ("A", "Alimentary Tract & Metabolism", "Alimentary & Metabolism"),
    ("B", "Blood & Blood-forming Organs", "Blood & Blood-forming"),
    ("C", "Cardiovascular System", "Cardiovascular"),
    ("D", "Dermatologicals", "Dermatological"),
    ("G", "Genito-urinary System & Sex Hormones", "Genito-urinary"),
    ("H", "Systemic Hormonal Preparations", "Systemic Hormones"),
    ("J", "Anti-infectives for Systemic Use", "Anti-infectives"),
    ("L", "Antineoplastic & Immunomodulating Agents", "Antineoplastic"),
    ("M", "Musculo-skeletal System", "Musculo-skeletal"),
    ("N", "Nervous System", "Nervous System"),
    ("P", "Antiparasitic Products, Insecticides & Repellents", "Antiparasitic"),
    ("R", "Respiratory System", "Respiratory"),
    ("S", "Sensory Organs", "Sensory Organs"),
    ("V", "Various", "Various"),
)

#: Regions of a category, the first is the primary one.
CATEGORY_REGIONS = {
    "A": ("stomach_upper_gi", "intestine_colorectal", "liver_biliary_pancreas", "endocrine_metabolic"),
    "B": ("blood_immune",),
    "C": ("heart_vascular", "blood_immune"),
    "D": ("skin",),
    "G": ("kidney_urinary", "reproductive_breast"),
    "H": ("endocrine_metabolic",),
    "J": ("lung_respiratory", "systemic_multiorgan"),
    "L": ("blood_immune", "systemic_multiorgan"),
    "M": ("bone_joint_muscle",),
    "N": ("brain_cns",),
    "P": ("intestine_colorectal", "systemic_multiorgan"),
    "R": ("lung_respiratory",),
    "S": ("eye_ear",),
    "V": ("systemic_multiorgan",),
}
#: Trial phases.
PHASES = ("I", "II", "III", "IV")
FALLBACK_CATEGORY, FALLBACK_CODE, FALLBACK_REGION = "V", "V99XX99", "systemic_multiorgan"

#: Words of an indication -> category: parts of words count.
INDICATION_RULES = (
    ("A", ("diabetes", "obesity", "acid", "gastric", "ulcer", "bowel")),
    ("B", ("coagulation", "clotting", "anemia", "thromb")),
    ("C", ("cardiac", "hypertension", "blood pressure", "cholesterol", "lipid")),
    ("D", ("dermat", "acne", "eczema", "psoriasis")),
    ("G", ("urolog", "gynec", "erectile")),
    ("H", ("thyroid", "corticosteroid", "insulin")),
    ("J", ("antibiot", "antiviral", "antifungal", "bacteria")),
    ("L", ("cancer", "tumor", "oncolog", "chemotherap", "leukemia")),
    ("M", ("muscle", "bone", "joint", "arthritis", "osteopor")),
    ("N", ("depress", "anxiety", "epilepsy", "parkinson", "alzheimer")),
    ("P", ("malaria", "anthelmint")),
    ("R", ("asthma", "cough", "bronch")),
    ("S", ("ophthalm", "otic")),
    ("V", ("vitamin", "nutrient", "contrast")),
)
CODE_SUFFIX = "99XX99"

#: Tissue -> category: parts of words count.
TISSUE_RULES = (
    ("liver", "A"), ("stomach", "A"), ("intestine", "A"), ("pancreas", "A"),
    ("blood", "B"), ("bone_marrow", "B"), ("heart", "C"), ("artery", "C"), ("vein", "C"), ("skin", "D"),
    ("kidney", "G"), ("bladder", "G"), ("prostate", "G"), ("ovary", "G"), ("testis", "G"),
    ("thyroid", "H"), ("adrenal", "H"), ("pituitary", "H"), ("infection", "J"), ("immune", "L"),
    ("muscle", "M"), ("bone", "M"), ("joint", "M"), ("brain", "N"), ("nerve", "N"), ("spinal_cord", "N"),
    ("lung", "R"), ("bronchus", "R"), ("eye", "S"), ("ear", "S"), ("head", "N"), ("hormone", "H"), ("parasite", "P"),
)

#: Words of a text -> region: whole words, or anywhere if the keyword holds a blank.
REGION_RULES = (
    ("brain_cns", ("brain", "cns", "nerve", "spinal", "mening", "pituitary", "head")),
    ("eye_ear", ("eye", "ear", "retina", "cornea")),
    ("lung_respiratory", ("lung", "bronch", "airway", "respir")),
    ("heart_vascular", ("heart", "vascular", "arter", "vein", "cardio", "coronary")),
    ("blood_immune", ("bone marrow", "marrow", "blood", "immune", "lymph", "spleen")),
    ("stomach_upper_gi", ("esophagus", "stomach", "duodenum", "upper gi", "gastric")),
    ("intestine_colorectal", ("intestine", "colon", "rect", "bowel", "colorectal")),
    ("liver_biliary_pancreas", ("liver", "biliary", "gall", "pancrea")),
    ("endocrine_metabolic", ("thyroid", "adrenal", "endocrine", "metabolic", "diabetes", "adipose")),
    ("kidney_urinary", ("kidney", "bladder", "urinary", "renal")),
    ("reproductive_breast", ("breast", "ovary", "uter", "cervix", "prostate", "testis", "reproductive")),
    ("bone_joint_muscle", ("bone", "joint", "muscle", "skeletal")),
    ("skin", ("skin", "derm", "hair", "nail")),
)

#: Region -> display name.
REGIONS = (
    ("brain_cns", "Brain / CNS"),
    ("eye_ear", "Eye / Ear"),
    ("lung_respiratory", "Lung / Respiratory"),
    ("heart_vascular", "Heart / Vascular"),
    ("blood_immune", "Blood / Immune"),
    ("stomach_upper_gi", "Stomach / Upper GI"),
    ("intestine_colorectal", "Intestine / Colorectal"),
    ("liver_biliary_pancreas", "Liver / Biliary / Pancreas"),
    ("endocrine_metabolic", "Endocrine / Metabolic"),
    ("kidney_urinary", "Kidney / Urinary"),
    ("reproductive_breast", "Reproductive / Breast"),
    ("bone_joint_muscle", "Bone / Joint / Muscle"),
    ("skin", "Skin"),
    ("systemic_multiorgan", "Systemic / Multi-organ"),
)

#: A name that holds one of these is no medicine.
BLOCKED = ("placebo", "medical care", "comparator", "active symptom control", "treatment a", "treatment b", "sham comparator")

#: Spellings that a table reader takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def categories(spark: SparkSession) -> DataFrame:
    """category, long_name, short_name: 14 rows."""
    return spark.createDataFrame(CATEGORIES, "category string, long_name string, short_name string")


def regions(spark: SparkSession) -> DataFrame:
    """ord, region, display_name: 14 rows."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGIONS)], "ord int, region string, display_name string")
