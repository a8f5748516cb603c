"""Fixed tables of the relation corpus: labels, type rules, swap map, special tokens.

All values here are fixed by the data model; results depend on them being exactly these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label names in the order of their numbers 0..29.
LABELS = [
    "no_relation",
    "org:top_members/employees",
    "org:members",
    "org:product",
    "per:title",
    "org:alternate_names",
    "per:employee_of",
    "org:place_of_headquarters",
    "per:product",
    "org:number_of_employees/members",
    "per:children",
    "per:place_of_residence",
    "per:alternate_names",
    "per:other_family",
    "per:colleagues",
    "per:origin",
    "per:siblings",
    "per:spouse",
    "org:founded",
    "org:political/religious_affiliation",
    "org:member_of",
    "per:parents",
    "org:dissolved",
    "per:schools_attended",
    "per:date_of_death",
    "per:date_of_birth",
    "per:place_of_birth",
    "per:place_of_death",
    "org:founded_by",
    "per:religion",
]
NUM_LABELS = len(LABELS)
NO_RELATION = LABELS[0]

# Label numbers a (subject type, object type) pair may carry.
TYPE_RULES = {
    ("PER", "PER"): [0, 6, 10, 12, 13, 14, 15, 16, 17, 21],
    ("PER", "POH"): [0, 4, 6, 8, 11, 12, 14, 15, 17, 21, 23, 29],
    ("PER", "ORG"): [0, 4, 6, 11, 12, 14, 15, 23, 29],
    ("PER", "LOC"): [0, 6, 11, 15, 23, 26, 27],
    ("PER", "DAT"): [0, 11, 15, 24, 25],
    ("PER", "NOH"): [0],
    ("ORG", "PER"): [0, 1, 3, 5, 28],
    ("ORG", "POH"): [0, 1, 2, 3, 5, 7, 19, 20],
    ("ORG", "ORG"): [0, 1, 2, 3, 5, 7, 19, 20, 28],
    ("ORG", "LOC"): [0, 1, 2, 3, 5, 7, 19, 20],
    ("ORG", "DAT"): [0, 3, 5, 18, 22],
    ("ORG", "NOH"): [0, 3, 5, 9],
}

# Object types a label accepts, and the type written over any other one.
OBJECT_TYPE_RULES = {
    "org:founded_by": (["PER", "ORG"], "ORG"),
    "org:member_of": (["ORG", "LOC", "POH"], "ORG"),
    "org:members": (["ORG", "LOC", "POH"], "ORG"),
    "org:place_of_headquarters": (["ORG", "LOC", "POH"], "LOC"),
    "org:political/religious_affiliation": (["ORG", "LOC", "POH"], "ORG"),
    "org:product": (["ORG", "LOC", "POH", "PER"], "POH"),
    "org:top_members/employees": (["ORG", "LOC", "POH", "PER"], "PER"),
    "per:alternate_names": (["ORG", "POH", "PER"], "PER"),
    "per:children": (["PER"], "PER"),
    "per:colleagues": (["PER", "POH", "ORG"], "PER"),
    "per:date_of_birth": (["DAT"], "DAT"),
    "per:date_of_death": (["DAT"], "DAT"),
    "per:employee_of": (["PER", "POH", "ORG", "LOC"], "ORG"),
    "per:origin": (["LOC", "POH", "DAT", "ORG"], "ORG"),
    "per:other_family": (["PER", "POH"], "POH"),
    "per:parents": (["PER"], "PER"),
    "per:place_of_birth": (["LOC"], "LOC"),
    "per:place_of_death": (["LOC"], "LOC"),
    "per:place_of_residence": (["LOC", "ORG", "POH", "DAT"], "LOC"),
    "per:product": (["POH"], "POH"),
    "per:religion": (["POH", "ORG"], "ORG"),
    "per:siblings": (["PER"], "PER"),
    "per:spouse": (["PER"], "PER"),
    "per:title": (["PER", "POH"], "POH"),
}

# Label of a row after subject and object change places.
SWAP_MAP = {
    "org:alternate_names": "org:alternate_names",
    "per:alternate_names": "per:alternate_names",
    "per:colleagues": "per:colleagues",
    "per:other_family": "per:other_family",
    "per:siblings": "per:siblings",
    "per:spouse": "per:spouse",
    "per:children": "per:parents",
    "per:parents": "per:children",
    "org:members": "org:member_of",
    "org:member_of": "org:members",
    "org:top_members/employees": "per:employee_of",
    "per:employee_of": "org:top_members/employees",
}

# Entity type codes, and the word six of them have.
TYPE_CODES = ["PER", "NOH", "ORG", "LOC", "POH", "DUR", "PNT", "TIM", "MNY", "DAT"]
TYPE_WORDS = {
    "PER": "사람",
    "ORG": "모임",
    "DAT": "날짜",
    "NOH": "숫자",
    "POH": "명사",
    "LOC": "장소",
}

# Object types whose entity pairs are exchanged between rows.
EXCHANGE_TYPES = ["POH", "DAT", "LOC"]

# Character classes used for cleaning and as quality flags.
FOREIGN = "[ぁ-ゔァ-ヴー々〆〤一-龥]+"
KANA_SIGN = "[ぁ-ゔ]+|[ァ-ヴー]+[々〆〤]"
# White space as Unicode knows it; \s alone is ASCII in Java and in RE2.
BLANKS = r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CHAR_CLASSES = {
    "single_letters": "[ㄱ-ㅎㅏ-ㅣ]+",
    "digits": "[0-9]+",
    "han": "[一-龥]+",
    "kana": "[ぁ-ゔァ-ヴー々〆〤]+",
    "symbol_run": f"[^A-Za-z0-9가-힣{BLANKS}ぁ-ゔァ-ヴー々〆〤一-龥]{{2,9999}}",
}

PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
RESERVED = [PAD, UNK, CLS, SEP, MASK]
# Plain tags; the typed ones follow from roles and type codes.
PLAIN_TAGS = [
    "[OTH]", "[ENT]", "[/ENT]", "[SUB]", "[OBJ]",
    "[PER]", "[LOC]", "[POH]", "[DAT]", "[NOH]", "[ORG]",
]


def special_tokens() -> list[str]:
    """All tags a tokenizer must keep whole: 11 plain ones and 40 typed ones."""
    typed = [f"[{slash}{role}:{code}]" for role in "SO" for code in TYPE_CODES for slash in ("", "/")]
    return PLAIN_TAGS + typed


def literal_map(pairs: dict) -> Column:
    """Dictionary as a map literal; a missing key gives NULL."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def label_dim(spark: SparkSession) -> DataFrame:
    """Label dictionary as a table of 30 rows."""
    return spark.createDataFrame(list(enumerate(LABELS)), "label_num int, label string")


def type_rules(spark: SparkSession) -> DataFrame:
    """Type-compatibility rules as a table of 12 rows."""
    rows = [(s, o, allowed) for (s, o), allowed in TYPE_RULES.items()]
    return spark.createDataFrame(rows, "subject_type string, object_type string, allowed array<int>")
