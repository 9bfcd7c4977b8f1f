"""Word lists and names that results depend on. All of them are fixed values."""

#: American and British stems; a stem takes any of SUFFIXES.
SPELLING_STEMS = [
    ("color", "colour"), ("favor", "favour"), ("honor", "honour"), ("labor", "labour"), ("neighbor", "neighbour"), ("behavior", "behaviour"), ("flavor", "flavour"), ("harbor", "harbour"),
    ("humor", "humour"), ("rumor", "rumour"), ("vapor", "vapour"), ("savior", "saviour"), ("endeavor", "endeavour"), ("armor", "armour"), ("odor", "odour"), ("tumor", "tumour"), ("vigor", "vigour"),
    ("rigor", "rigour"), ("candor", "candour"), ("splendor", "splendour"), ("demeanor", "demeanour"), ("center", "centre"), ("theater", "theatre"), ("liter", "litre"), ("fiber", "fibre"),
    ("caliber", "calibre"), ("somber", "sombre"), ("specter", "spectre"), ("kilometer", "kilometre"), ("centimeter", "centimetre"), ("millimeter", "millimetre"), ("defense", "defence"),
    ("offense", "offence"), ("pretense", "pretence"), ("catalog", "catalogue"), ("analyz", "analys"), ("paralyz", "paralys"), ("catalyz", "catalys"), ("skeptic", "sceptic"), ("aluminum", "aluminium"),
    ("plow", "plough"), ("mold", "mould"), ("pajama", "pyjama"), ("sulfur", "sulphur"), ("cozy", "cosy"), ("donut", "doughnut"), ("aging", "ageing"), ("esthetic", "aesthetic"), ("anemi", "anaemi"),
    ("pediatric", "paediatric"), ("orthopedic", "orthopaedic"), ("maneuver", "manoeuvre"), ("diarrhea", "diarrhoea"), ("leukemia", "leukaemia"), ("mustache", "moustache"), ("airplane", "aeroplane"),
    ("jewelry", "jewellery"), ("enrollment", "enrolment"), ("fulfillment", "fulfilment"), ("installment", "instalment"), ("skillful", "skilful"), ("willful", "wilful"), ("counselor", "counsellor"),
    ("marvelous", "marvellous"),
]
#: Whole words that double a consonant, and the like.
SPELLING_WORDS = [
    ("traveled", "travelled"), ("traveling", "travelling"), ("traveler", "traveller"), ("canceled", "cancelled"), ("canceling", "cancelling"), ("labeled", "labelled"), ("labeling", "labelling"),
    ("modeled", "modelled"), ("modeling", "modelling"), ("fueled", "fuelled"), ("fueling", "fuelling"), ("signaled", "signalled"), ("signaling", "signalling"), ("leveled", "levelled"),
    ("leveling", "levelling"), ("enroll", "enrol"), ("fulfill", "fulfil"),
]
#: Stems that take -ise in British English; -ize is right in both.
ISE_STEMS = [
    "organ", "real", "recogn", "summar", "emphas", "priorit", "minim", "maxim", "util", "final", "author", "critic", "apolog", "standard", "special", "custom", "capital", "categor", "character",
    "harmon", "modern", "normal", "optim", "stabil", "visual", "familiar", "mobil", "legal", "fertil", "general", "memor", "central", "sympath", "symbol", "subsid", "digit", "institution", "personal",
    "popular", "equal", "commercial", "social", "national", "industrial", "monopol", "hospital", "rational", "revolution", "urban", "verbal", "moral", "neutral", "radical", "stigmat", "styl",
    "tranquil",
]
SUFFIXES = ["s", "es", "d", "ed", "ing", "er", "ers", "ful", "less", "ly", "ist", "ists", "ism", "y", "ies", "able", "ite", "ites", "ary", "ous", "ation", "ations", "ment", "ments"]
ISE_ENDINGS = ["e", "es", "ed", "ing", "ation", "ations", "er", "ers"]

#: Names of punctuation marks.
MARKS = {
    "em_dash": ["—"], "en_dash": ["–"], "semicolon": [";"], "exclamation_mark": ["!"], "ellipsis": ["…"], "colon": [":"],
    "double_hyphen": ["--"], "ampersand": ["&"], "curly_quotes": ["“", "”", "‘", "’"],
}
REFERENCE_HEADINGS = ["References", "Reference list", "Bibliography", "Works cited"]
ELEMENTS = ["bullets", "numbered_items", "list_items", "headings", "tables", "code_blocks", "paragraphs", "references"]


def other_words(variant: str) -> list[str]:
    """All spellings, in lower case, that a text in ``variant`` should not have."""
    side = 0 if variant == "british" else 1
    out = [p[side] + s for p in SPELLING_STEMS for s in ("", *SUFFIXES)] + [p[side] for p in SPELLING_WORDS]
    if variant == "american":
        out += [s + "is" + e for s in ISE_STEMS for e in ISE_ENDINGS]
    return sorted(set(out))


def other_spellings(variant: str) -> str:
    """The pattern of those spellings; letters only, so both engines read it alike."""
    side = 0 if variant == "british" else 1
    forms = [f"{p[side]}(?:{'|'.join(SUFFIXES)})?" for p in SPELLING_STEMS] + [p[side] for p in SPELLING_WORDS]
    if variant == "american":
        forms += [f"{s}is(?:{'|'.join(ISE_ENDINGS)})" for s in ISE_STEMS]
    return f"(?<![A-Za-z])(?:{'|'.join(forms)})(?![A-Za-z])"


SPELLING_PAIRS = len(SPELLING_STEMS) + len(SPELLING_WORDS) + len(ISE_STEMS)
