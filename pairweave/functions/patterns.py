"""Patterns and vocabularies that labels depend on. They must stay as they are for equal labels."""

#: Put before each pattern: case-insensitive, Unicode case and classes, as the labels were defined.
FLAGS = "(?iuU)"
#: \b where only ASCII letters, digits and _ are words.
ASCII_EDGE = r"(?-U:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

CURRENCY = r"\b(currently|right now|at present|presently|as of now)\b"
PROGRESSIVE = r"\b(?:is|are|am)\s+(?:staying|living|working|taking|driving|using|lecturing)\b"
DATE_ANCHOR = r"\b(?:20\d\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|december|until|through)\b"
CAVEAT = r"\bassuming\b|\bif (?:you(?:'re| are)|that(?:'s| is)) still\b"
META_MENTION = r"\bhave on file\b|\bi have (?:noted|recorded)\b|\byou (?:mentioned|told me|said)\b|\bwas from\b|\b(?:likely|probably|may be|might be) (?:outdated|stale|old)\b|\bmy (?:notes|records|memory)\b"
CONFIRM_VERB = r"\b(confirm|double.?check|verify|let me know|remind me|(?:could|can|would) you (?:please )?(?:tell|give|provide|share|send)|please (?:tell|give|provide|share|send)|(?:i )?don'?t have (?:your|the|that))\b"
WH_REQUEST = r"\b(what|which|where|who)\b[^.!?\n]*\?"
STILL_QUESTION = r"\bstill\b|\bsame\b|\bcorrect\b|\bup.to.date\b|\bcurrent\b"
PLACEHOLDER = r"\[[^\]\n]{0,60}\]|\bX{2,}\b|_{3,}"
THIRD_PARTY_USE = r"\bpick(?:ing)? (?:me|us) up\b|\bpick.?up\b[^.!?\n]{0,40}\b(?:at|from)\b|\bdeliver(?:y)? to\b"
TRANSACTION_CONFIRM = r"\bconfirm(?:ing)? (?:a |the |my |an )?(?:airport )?(?:pick.?up|booking|reservation|ride|delivery|appointment|time)\b|\b(?:please )?send (?:a |the )?(?:car|driver|cab|taxi)\b"
ADDRESS_SHAPE = r"\b\d{1,5} [A-Z][a-z]+ (?:Street|St|Avenue|Ave|Terrace|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b"
STATIVE = r"\b(?:lives?|works?|drives?|takes?|resides?|attends?|owns?|uses?|lectures?|teach(?:es)?|plays?|has|is (?:a |an )?(?:resident|employee|student|member|lecturer|affiliate))\b"
BOUND_KEPT = r"\b(?:until|through|till|up to)\b"
PERFECT_PROGRESSIVE = r"\b(?:has|have|'ve)\s+been\s+(?:staying|living|working|taking|driving|using|lecturing)\b"
PAST_EXPERIENCE = r"\b(?:lived|worked|drove|took|stayed|resided|attended|lectured|used to|previously|formerly|in the past|at (?:one|some) point|(?:has|have|had) (?:lived|worked|driven|taken|stayed|resided|attended|used|lectured|owned))\b"
ANCHOR = r"\bACTION\s*:\s*\**\s*(SEND|CHECK[\s-]?FIRST)\b"
TEMPORARY_CLASS = r"\b(?:for now|for the time being|temporar(?:y|ily)|for a while|short[- ]term|provisional(?:ly)?|interim|on a temporary basis|not permanent(?:ly)?|until further notice)\b"
CURRENT_CLASS = r"\b(?:at the moment|for the moment|currently|right now|just now|at present|presently|as of now|these days|nowadays|at this time)\b"
ING_FORM = r"\b(?:staying|living|working|taking|driving|using|lecturing)\b"
FIELD_LINE = r"^[\s>*_\-•\d.]*(said|fact|form|observed)[\s*_]*:[\s*_]*(.*?)[\s*_]*$"
WRITER_PROGRESSIVE = r"\b(is|are|has been|have been)\s+(currently\s+)?\w+ing\b"
WRITER_ONGOING = r"\b(currently|temporarily|for now|at the moment)\b"

LINE_MARKS = r"(?U)^[\s>*\-•]+"
EMPHASIS = r"\*\*|__"
AS_OF = r"^As of \d{4}-\d\d-\d\d, "
TRUE_THROUGH = r"\. This was true only through (\d{4}-\d\d-\d\d)\.\z"
DESTROYED = ["MANUFACTURE", "COERCED-STATIVE", "BOUND-DROPPED"]
GAP_DAYS = {"fresh": 2, "near": 42, "boundary": 60, "stale": 245, "stale_long": 425}

#: Where Python's splitlines() cuts.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"

STORED_PROGRESSIVE = r"\b(?:is|are|am|'s|'re|'m|has been|have been|been)\s+(?:currently\s+|now\s+)?\w+ing\b"
STORED_DURATION = r"\b(?:for (?:about |approximately |almost |the (?:past|last) )?(?:\d+|a|an|one|two|three|four|five|six|seven|eight|nine|ten|several|few|couple)\b[\w\s-]{0,12}(?:days?|weeks?|months?|years?)|since\s+\S+|until\b|for the past|for the last|recently|ago)\b"
STORED_ANCHOR = r"\b(?:20\d\d|january|february|march|april|may|june|july|august|september|october|november|december|as of|since)\b"
#: By frame: progressive phrases and the simple ones that stand for them, in order.
VERB_EDITS = {
    "lodging": [("is staying at", "lives at"), ("is currently staying at", "lives at"), ("is living at", "lives at")],
    "workplace": [("is working at", "works at"), ("is currently working at", "works at"), ("is employed at", "works at")],
    "vehicle": [("is driving a", "drives a"), ("is currently driving a", "drives a"), ("is driving an", "drives an"), ("is renting a", "rents a"), ("is driving", "drives")],
    "class": [("is taking a", "takes a"), ("is currently taking a", "takes a"), ("is attending a", "attends a"), ("is enrolled in a", "takes a")],
    "equipment": [("is using a", "uses a"), ("is currently using a", "uses a"), ("is playing a", "plays a"), ("is borrowing a", "borrows a"), ("is borrowing an", "borrows an")],
    "affiliate_role": [("is lecturing at", "lectures at"), ("is currently lecturing at", "lectures at")],
    "project": [("is working on", "works on"), ("is currently working on", "works on")],
    "household": [("is staying with", "lives with"), ("is currently staying with", "lives with"), ("is living with", "lives with")],
}  # fmt: skip#: Sentences that perturbations put before and after a text.
FILLER, CLOSER = "Sure thing! ", "Hope that helps!"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Category, name, pattern, and whether case is ignored: marks of facts that hold for a time.
TEMPORARY_FACTS = [
    ("PROG", "im_prog_residence", r"\bI'?a?m (?:currently |now )?(?:staying|living|crashing|subletting|house[- ]?sitting) (?:at|in|with|near|over|on)\b", False),
    ("PROG", "im_prog_use", r"\bI'?a?m (?:currently |now )?(?:renting|borrowing|using|driving)\b", False),
    ("PROG", "im_prog_role", r"\bI'?a?m (?:currently |now )?(?:working (?:at|for|from|out of)|interning|volunteering|taking (?:a|an|the|this) |enrolled in)\b", False),
    ("PERF_PROG", "ive_been", r"\bI'?(?:ve| have) been (?:staying|living|renting|using|driving|working|taking|volunteering|interning)\b", False),
    ("BOUND", "until_month", rf"\b(?:until|till|through) (?:{MONTHS}|next (?:week|month|year)|the end of)\b", True),
    ("BOUND", "for_the_next", r"\bfor the next (?:few|couple|\d+)\b", True),
    ("TEMP_ADV", "temp_adv", r"\b(?:temporarily|for now|for the time being|for a (?:few|couple of) (?:weeks|months|days)|short[- ]term)\b", True),
    ("TEMP_ADV", "while_clause", r"\bwhile (?:my|our|the) \w+ (?:is|are|gets?|is being)\b", True),
    ("THIRD_PROG", "third_staying", r"\b(?:is|are) (?:staying|living) with (?:me|us)\b", True),
]
