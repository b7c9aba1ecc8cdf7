"""Fixed values of the retrieval jobs. All of them are defaults of function parameters."""

# Words that carry no meaning in a question.
STOP_WORDS = (
    "a an the of to in on for and or is are was were be by with as at from that this it its "
    "what which who whom how does do did can could shall should may might will would about "
    "explain tell me please under any all into than then there their them they i you your "
    "define meaning mean says say said give list"
).split()

# Suffixes that a stem goes without, longer ones first.
SUFFIXES = ("ments", "ment", "ings", "edly", "ing", "ed", "es", "s")

# Page and structure markers (Java regex, matched against stripped lines).
HEADER = r"(?i)^\s*THE\s+CONSTITUTION\s+OF\s+INDIA\s*(\(.*?\))?\s*[\d\[\]A-Z]*\s*$"
HEADER_PART = r"(?i)\(Part\s+([IVXLC]+[A-Z]?)\s*\.?\s*[—–-]?\s*([^)]*)\)"
LONE_NUMBER = r"^\s*[-–—]?\s*(\d{1,4})\s*[-–—]?\s*$"
PART = r"^\s*PART\s+([IVXLC]+[A-Z]?)(?:\s*$|\b[\s.—–-]*(.*)$)"
CHAPTER = r"(?i)^\s*CHAPTER\s+([IVXLC]+)\b[\s.—–-]*(.*)$"
ARTICLE = r"^\s*(?:\d{0,3}\[)?(\d{1,3}[A-Z]{0,3})\.\s*\[?([A-Z][^—–\n]{2,160}?)\.?\s*(?:[—–]|\.-)\s*(.*)$"
SCHEDULE = r"(?i)^\s*(?:\d?\[)?(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+SCHEDULE"
TOC_LINE = r"^\d{1,3}[A-Z]{0,3}\.\s+[A-Z][^—–]{2,90}$"
TOC_MARKER = r"(?i)ARRANGEMENT OF ARTICLES|CONTENTS"
MENTION = r"\bArt(?:icle)?s?\.?\s+(\d{1,3}[A-Z]{0,3})\b"

# Where clauses begin and sentences end (Java regex).
CLAUSE = r"\n(?=\s*\(\d+[A-Z]?\)\s)|\n(?=\s*\([a-z]\)\s)"
SENTENCE = r"(?<=[.;:])\s+(?=[A-Z(\"])"

# Sizes of chunks in characters.
MAX_CHUNK, TARGET, OVERLAP, MIN_USEFUL = 900, 800, 150, 120

# Ranking.
K1, B, POOL, RRF_K, COVERAGE_WEIGHT, RERANK_KEEP, FINAL_CHUNKS, CONTEXT_CHARS, PINNED_PER_ARTICLE = 1.5, 0.75, 30, 60, 0.02, 12, 7, 14000, 3

# Number words of question rewriting.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}

# Concept patterns, the articles they hint at and the terms they add.
CONCEPTS = [
    (r"right to life|personal liberty", ["21"], "protection of life and personal liberty"),
    (r"right to education", ["21A"], "free and compulsory education children"),
    (r"\bwrits?\b|habeas corpus|mandamus|certiorari|quo warranto", ["32", "226"], "writs habeas corpus mandamus prohibition quo warranto certiorari"),
    (r"constitutional remed", ["32"], "remedies for enforcement of rights"),
    (r"fundamental rights?", ["12", "13"], "Part III fundamental rights"),
    (r"\bdpsps?\b|directive principles?", ["36", "37", "38", "39"], "Part IV directive principles of state policy"),
    (r"fundamental dut", ["51A"], "Part IVA fundamental duties"),
    (r"\bamend(ment|ing)?\b", ["368"], "power of Parliament to amend the Constitution procedure"),
    (r"\bemergenc", ["352", "356", "360"], "proclamation of emergency"),
    (r"president'?s rule|failure of constitutional machinery", ["356"], "failure of constitutional machinery in States"),
    (r"(appoint\w*|choose|select\w*).*(prime minister|\bpm\b)|(prime minister|\bpm\b).*(appoint|chosen)", ["75"], "Prime Minister shall be appointed by the President"),
    (r"powers? of (the )?president|president'?s powers|president.*powers?", ["53", "72", "74"], "executive power of the Union vested in the President"),
    (r"pardon", ["72"], "power of President to grant pardons"),
    (r"equality|equal protection", ["14"], "equality before law"),
    (r"untouchab", ["17"], "abolition of untouchability"),
    (r"uniform civil code", ["44"], "uniform civil code for the citizens"),
    (r"attorney.?general", ["76"], "Attorney-General for India"),
    (r"supreme court", ["124"], "establishment and constitution of Supreme Court"),
    (r"freedom of speech|right to freedom", ["19"], "protection of certain rights regarding freedom of speech"),
]

# Intent patterns.
GREETING = r"(?i)^\s*(hi|hello|hey|namaste|good (morning|evening|afternoon)|thanks?( you)?|who are you|what can you do)[\s!.?]*$"
INJECTION = r"(?i)ignore (all |any )?(previous|prior|above) (instructions|rules)|system prompt|reveal your (prompt|instructions)|jailbreak|developer mode|you are now"
OFFTOPIC = r"(?i)\b(jupiter|mars|planet|galaxy|distance from earth|recipe|cook|weather|movie|cricket score|stock price|bitcoin|python|javascript|code|script|program(ming)?|malware|hack(ing)?|exploit|password|phishing|sql injection|keylogger)\b"
PURE_ARTICLE = r"(?i)^\s*(what is|what's|what does|explain|show( me)?|define|read|quote)?\s*(the\s+)?(article|art\.?)\s*\d{1,3}[a-z]{0,3}(\s+of the (indian )?constitution( of india)?)?\s*(say|state|mean)?\s*\??\s*$"
FOLLOW_UP = r"(?i)\b(it|this|that|its|they|them|these|those|same|above)\b"
