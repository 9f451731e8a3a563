"""Fixed values of the text rules: word lists, patterns and character tables.

Results must agree on these values, so they are kept as they are, together and in their natural order. Patterns are for the
JVM's regex engine: ``(?U)`` for Unicode classes, ``(?d)`` so that only \\n ends a line.
"""

from __future__ import annotations

import unicodedata

# ---- fixed values -------------------------------------------------------------------------------------------------------
STOP_WORDS = "the and that have with this from they there which their about could would should after before people".split()

CONTRACTION_S_WORDS = "that it he she there here what let who how where when why someone anyone everyone nobody anybody somebody one".split()
CONTRACTION_T_WORDS = "can don won shan isn aren wasn weren hasn haven hadn doesn didn wouldn shouldn couldn mustn ain needn oughtn mightn daren".split()
CONTRACTION_VE_WORDS = "i you we they who what where how would should could might must".split()
CONTRACTION_LL_WORDS = "i you he she it we they who that what where how".split()
CONTRACTION_RE_WORDS = "you we they who what where how".split()
CONTRACTION_M_WORDS = ["i"]
CONTRACTION_D_WORDS = "i you he she it we they who that what where how".split()

HYPHEN_PREFIXES = """self ex all well ill near non anti semi quasi pseudo vice co cross high low mid snap neuro
twenty thirty forty fifty sixty seventy eighty ninety
pre post sub super inter intra extra over under multi bi tri quad uni poly macro micro infra ultra hyper arch auto out deep wide long short
hard soft full half double single neo pan pro top bottom up down off on back front side far""".split()

WATERMARKS = r"(?i)(?:oceanofpdf(?: |)\.com|angrygotfan\.com)"
BOILERPLATE = [
    r"(?dUis)THE HORUS HERESY\s+It is a time of legend.*?how far can a star rise before it falls\?",
    r"(?dUs)(?:Table of Contents|CONTENTS)\s*(?:(?:PART|Part) (?:ONE|TWO|THREE|FOUR|FIVE|One|Two|Three|Four|Five)\s*)+(?:[A-Z-]+(?![a-z])\s*)*",
    r"(?dUis)(?:^|\n)\s*(?:An?\s+(?:[\w-]+\s+){1,5}Publication|Copyright|Dedication|Acknowledgements?|Legal|About the (?:Authors?|Publisher|Illustrator)|By (?:George R\. ?R\. Martin|Guy Haley|Dan Abnett|Gav Thorpe|John French)|eBook license|Afterword|Further reading from The Horus Heresy|Introduction to the (?:Old Republic|Rise of the Empire|Rebellion|New Republic|Legacy Era)|Praise for (?:George R\. ?R\. Martin's )?A GAME OF THRONES|Backlist|Other Titles|Also by this Author|Excerpt from).*",
    r"(?dUis)(?:^|\n)\s*Contents\s*(?:\n|$).*",
    r"(?dUis)(?:^|\n)\s*The STAR WARS Novels Timeline.*",
    r"(?dUi)(?:^|\n)\s*Chapter\s+(?:[0-9]+|[IVXLCDM]+|[a-zA-Z]+)\s*(?=\n|$)",
]
#: What the last four of these begin with, after the beginning of a text or a line
BOILERPLATE_HEADS = r"(?:An?\s+(?:[\w-]+\s+){1,5}Publication|Copyright|Dedication|Acknowledgement|Legal|About the|By (?:George|Guy|Dan|Gav|John)|eBook license|Afterword|Further reading|Introduction to|Praise for|Backlist|Other Titles|Also by|Excerpt from|Contents|The STAR WARS|Chapter\s)"
SPACED_ELLIPSIS = r"(?U)\.(?:\s+\.){2,}"
GARBAGE = [
    r"(?dm)^[^\n]*[¦][^\n]*(?:\n|$)",
    r"[#=~*_\-]{4,}",
    r"(?U)(?<!\S)\S*[~¦]\S*(?!\S)",
    r"(?U)\b[A-Za-z0-9]*(?:[~¦:;,.]{1,}[A-Za-z0-9]{1,}){2,}[~¦:;,.!]*\b",
    "(?U)(?<!\\S)(?![.]{2,})[~:.;,¦'\"“]{2,}(?!\\S)",
    r"(?U)(?<!\S)\w{0,2}[~:;,.¦]{2,}\w?\S*(?!\S)",
    r"(?U)\b\w*?(\w)\1{4,}\w*\b",
    r"(?U)\b\w*?(\w{2,})\1{2,}\w*\b",
    r"(?U)(?<!\S)(\S+)(?:\s+\1){2,}(?!\S)",
    r"#{4,}|\.{5,}",
]
REPEATED_CHARS, REPEATED_TOKENS = GARBAGE[6], GARBAGE[8]
JUNK_PAGE = [GARBAGE[0], GARBAGE[6], GARBAGE[7]]

SINGLE_CHARACTERS = {"“": '"', "”": '"', "‘": "'", "’": "'", "´": "'", "`": "'", "|": "I", "ſ": "s", "ʃ": "f", "ᓼ": "ñ", "–": "-", "—": "-"}
STRING_CHARACTERS = {"ɹ": "fi", "ɻ": "fl", "ɽ": "ffi", "ʀ": "ff", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "...", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE"}
DROPPED_CHARACTERS = "\xad�" + "".join(map(chr, [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))

BOILERPLATE_TITLES = [
    r"^\s*(?:Table of )?Contents\s*$", r"^\s*Introduction(?:\s+to.*)?\s*$", r"^\s*Preface\s*$", r"^\s*Foreword\s*$",
    r"^\s*About the (?:Author|Publisher|Illustrator)s?\s*$", r"^\s*Copyright\s*$", r"^\s*Dedication\s*$", r"^\s*Acknowledgements?\s*$",
    r"^\s*Legal\s*$", r"^\s*eBook license\s*$", r"^\s*Afterword\s*$", r"^\s*Further reading.*$", r"^\s*Praise for.*$", r"^\s*Backlist\s*$",
    r"^\s*An?\s+(?:[\w-]+\s+){1,5}Publication\s*$", r"^\s*Maps\s*$", r"^\s*Title Page\s*$", r"^\s*Front Matter\s*$", r"^\s*Other Titles\s*$",
    r"^\s*Also by this Author\s*$", r"^\s*Excerpt from.*$", r"^\s*An Extract from.*$", r"^\s*Star Wars Legends Novels Timeline",
    r"^\s*Star Wars Novels Timeline", r"^\s*Timeline",
]
PAGE_NUMBER = r"(?i)^\s*(?:page\s+|p\.\s+)?\d+(?:\s+of\s+\d+)?\s*$"
TOC_LINE = r"^(.+?)(?:\s|\.){5,}(\d+)$"
# Stops of a sentence that are abbreviations, by length, for look-behinds of one width each
ABBREVIATIONS = [
    r"(?<!\b(?:Mr|Ms|Dr|Jr|Sr|St|vs|cf|Mt|Lt|Fr))", r"(?<!\b(?:Mrs|Gen|Col|Maj|Sgt|Adm|Rev|Hon|Gov|Sen|Rep))", r"(?<!\b(?:Prof|Capt|Pres))",
    r"(?<!\b(?:e\.g|i\.e))", r"(?<!\bpp)", r"(?<!\b[pA-Z])",
]
SENTENCE_END = "(?:(?:" + "".join(ABBREVIATIONS) + r"\.|[!?…]|\.{3})\s*(?:['\"](?=\s|$))?\s*(?=$|(?:['\"]\s*)*[A-Z0-9(])|\n{2,})"
# Spacing and quotes for showing: pattern and replacement, in their order
PROTECTED_URL = r"(?iU)(?:https?://|www\.)[^\s\[\](){}]+"
PROTECTED_ABBREVIATION = r"(?iU)\b(?:e\.g|i\.e)\b"
PROTECTED_REFERENCE = r"(?i)&[a-z0-9#]{2,10};"
MISREAD_WORDS = [(r"(?U)\bfne\b", "fine"), (r"(?U)\bstus\b", "stuff")]
GLUED_CONTRACTION = (r"'\s*(s|t|ve|ll|re|m|d)([a-z])", "$1'$2 $3")
APOSTROPHES = [
    (r"(?U)([sS])'(?![sS])(\w)", "$1' $2"),
    (r"(?iU)(\w)'\s+(t|d|m|ll|re|ve|s)\b", "$1'$2"),
    (r"(?iU)\b([a-z]+)\s+'(s|t|d|m|ll|re|ve)\b", "$1'$2"),
    (r"(?dU)([\w.,!?;:]) '(?!')(?=\s+[a-zA-Z]|\s+['\"]|\s*$|[A-Z])", "$1'"),
]
QUOTES_BEFORE = [
    (r"(?U)((?:^|(?<=\s))[‘“'\"])\s+(?=\w)", "$1"),
    (r"(?dU)(?<=\S)\s+(['\"”’])(?=\s|[.,!?;]|$)", "$1"),
    (r"(?U)(?<=[^\w\s])'(?=[A-Za-z])", " '"),
]
QUOTES_AFTER = [
    (r"(?U)([,:;])'(?=\w)", "$1' "),
    (r"(?U)([.!?])'(?=\w)", "$1' "),
    (r"(?iU)(?<=[a-zA-Z]{3})(')(?=[a-zA-Z]{2,})(?!(?:re|ve|ll|em)\b)", "$1 "),
    (r'(?U)([.,])\s+"(?:\s+)?(?=[a-z])', '$1 "'),
    (r'(?U)(?<=[^\s"])(")(?=\w)', "$1 "),
    (r'(?U)([.,!?-])""\s*', '$1" "'),
    (r"(?U)([.,!?-])''\s*", "$1' '"),
]
PUNCTUATION = [
    (r"(?U)([a-zA-Z]{3,})(['\"“”‘’])\.\s*([A-Z])", "$1. $2$3"),
    (r'([.!?])"([A-Z])', '$1" $2'),
    (r"\.\.\.(?=[A-Z])", "... "),
    (r"(?U)\s+([:,.!?;])", "$1"),
    (r"(?U)(?<!\b[A-Za-z])([:,.!?;])(?=[A-Za-z])", "$1 "),
    (r"(?U)([.!?])\s+(['\"“”‘’])(?!\w)", "$1$2"),
]
SPLIT_URLS = [(r"(?iU)((?:https?://|www\.))\s+([a-z0-9])", "$1$2"), (r"(?iU)((?:https?://|www\.)[^\s]*?[.,:;!?])\s+([a-z0-9])", "$1$2")]
# ---- end of the fixed values --------------------------------------------------------------------------------------------

CONTRACTIONS = sorted({*CONTRACTION_S_WORDS, *CONTRACTION_T_WORDS, *CONTRACTION_VE_WORDS, *CONTRACTION_LL_WORDS, *CONTRACTION_RE_WORDS, *CONTRACTION_M_WORDS, *CONTRACTION_D_WORDS}, key=lambda w: (-len(w), w))


def _plain() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without accents, made from the Unicode decompositions."""
    accented, plain = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            accented.append(c)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _plain()
