"""Fixed values of the benchmark domain: names, word lists and limits that results depend on."""

CATEGORIES = ("MCQ", "SAQ", "CBQ")
LEVELS = ("L1", "L2", "L3")
RISKS = ("S0", "S1", "S2")
UNKNOWN = "Unknown"

DISCIPLINES = {
    1: "Caries, Tooth Defects & Trauma",
    2: "Pulp & Periapical Diseases",
    3: "Periodontal & Peri-implant Diseases",
    4: "Oral Mucosal Diseases",
    5: "Dentoalveolar Surgery",
    6: "Maxillofacial Diseases & Surgery",
    7: "Anesthesia & Medical Emergencies",
    8: "Oral & Maxillofacial Radiology",
    9: "Conventional Prosthodontics",
    10: "Oral Implantology",
    11: "Pediatric Dentistry",
    12: "Orthodontics",
    13: "Basic Sciences & Preventive Dentistry",
    14: "Systemic Health, Pharmacology & Safety",
}

#: Discipline keywords in order of precedence.
DISCIPLINE_KEYWORDS = (
    (12, ("orthodont", "malocclusion", "cephalometric", "class iii", "crossbite")),
    (10, ("implant", "peri-implant", "osseointegration", "bone graft", "zirconia crown")),
    (2, ("pulp", "periapical", "root canal", "endodont")),
    (6, ("maxillofacial", "orthognathic", "le fort", "bsso")),
    (8, ("radiograph", "cbct", "radiology", "panoramic")),
    (5, ("extraction", "dentoalveolar", "oral surgery")),
    (3, ("periodontal", "periodontitis", "gingival", "periodont")),
)

#: Reasoning-level keywords in order of precedence; texts without any are L1.
LEVEL_KEYWORDS = (
    (
        "L3",
        (
            "individualized", "patient-specific", "medical history", "systemic", "risk assessment", "management decision",
            "treatment choice", "justify", "evaluate", "trade-off", "tradeoff", "risk-benefit",
        ),
    ),
    (
        "L2",
        (
            "diagnosis", "differential diagnosis", "treatment planning", "clinical reasoning", "symptoms", "signs",
            "examination findings", "imaging",
        ),
    ),
)

#: Document types by the phrases in the first characters of a text.
TYPE_PHRASES = (
    ("CaseReport", ("case report", "case presentation")),
    ("MCQ", ("multiple choice", "mcq")),
    ("SAQ", ("short answer", "saq")),
)
TYPE_SAMPLE_CHARS = 12000

#: Conversion tool by file suffix.
TOOLS = {
    "deepseek_ocr2_to_markdown": (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"),
    "convert_tabular_document": (".xlsx", ".xls", ".csv", ".tsv"),
    "convert_xml_document": (".xml",),
    "convert_with_pandoc": (".docx", ".doc", ".odt", ".rtf", ".txt", ".md", ".mmd", ".markdown", ".html", ".htm"),
}

#: Chunk sizes and overlaps in tokens by document type and stage.
CHUNKING = {
    ("MCQ", "generation"): (7372, 96),
    ("SAQ", "structure"): (32768, 160),
    ("SAQ", "generation"): (7372, 96),
    ("CaseReport", "generation"): (32768, 160),
}
METADATA_WORDS = 4096
BOOKKEEPING = ("output_path", "question_type", "Type", "status", "error")
END_OF_TEXT = "<｜end▁of▁sentence｜>"
PAGE_SPLIT = "\n<--- Page Split --->"

#: Key points of a case.
KEY_POINTS = 5

#: Fields of a document's metadata, and what stands for a description where none was told.
METADATA_FIELDS = ("Name", "Date", "Authors", "Brief Description", "Type")
NO_DESCRIPTION = (
    "Automatic metadata extraction failed. This fallback metadata was generated from the source filename so downstream processing can continue."
)
WARNING_CHARS = 1000
