"""Vocabularies, patterns and limits that results depend on. Patterns are Java's."""

# --- fixed values: sections and question types -------------------------------------------------------------------

QA_ARRAYS = ("illustrations", "check_your_knowledge_items", "textbook_exercises", "exercises", "examples")
SECTION_TYPE = {
    "illustrations": "illustration",
    "check_your_knowledge_items": "check_your_knowledge",
    "textbook_exercises": "textbook_exercise",
    "exercises": "exercise",
    "examples": "example",
}
SECTION_DISPLAY = {
    "illustrations": "Illustrations",
    "check_your_knowledge_items": "Check Your Knowledge",
    "textbook_exercises": "Exercise",
    "exercises": "Exercise",
    "practice_exercises": "Practice Questions",
    "examples": "Exercise",
    "case_studies": "Case Studies",
}
SECTION_DEFAULT_TYPE = {
    "illustration": "Illustration Question",
    "example": "Illustration Question",
    "check_your_knowledge": "Practice Question",
    "textbook_exercise": "Exercise Question",
    "exercise": "Exercise Question",
}
KIND_LABEL = {
    "multiple_matching": "Multiple Matching",
    "mcq": "MCQ",
    "single_option": "MCQ (Single Correct)",
    "multiple_option": "MCQ (Multiple Correct)",
    "assertion_reason": "Assertion-Reason",
    "fill_blanks": "Fill in the Blanks",
    "true_false": "True/False",
    "matching": "Matching",
    "passage": "Passage Based",
    "case_based": "Case Study",
    "very_short_answer": "Very Short Answer",
    "short_answer": "Short Answer",
    "long_answer": "Long Answer",
    "integer": "Integer",
    "hots": "HOTS",
    "reasoning": "Reasoning",
    "statement_based": "Statement Based",
    "diagram_based": "Diagram Based",
    "textbook": "Textbook Question",
    "exemplar": "Exemplar Question",
    "subjective": "Subjective",
    "miscellaneous": "Miscellaneous",
}

# --- fixed values: headings, the first match wins ----------------------------------------------------------------

EXERCISE_NAMES = (
    (r"master\s*ncert", "master_ncert"),
    (r"master\s*boards?", "master_boards"),
    (r"revision", "revision"),
    (r"examination[-\s]*style", "examination_style"),
    (r"advanced\s*exercise|connecting\s*topics", "advanced"),
)
SUBSECTION_KINDS = (
    (r"case\s*(?:study|based)", "case_based"),
    (r"passage\s*based|comprehension", "passage"),
    (r"assertion", "assertion_reason"),
    (r"fill\s*in\s*the\s*blank", "fill_blanks"),
    (r"true\s*[/&and]*\s*false", "true_false"),
    (r"multiple\s*match", "multiple_matching"),
    (r"match(?:ing|\s*the\s*(?:following|column))", "matching"),
    (r"very\s*short\s*answer", "very_short_answer"),
    (r"short\s*answer", "short_answer"),
    (r"long\s*answer", "long_answer"),
    (r"integer|numeric", "integer"),
    (r"hots", "hots"),
    (r"reasoning", "reasoning"),
    (r"statement\s*based", "statement_based"),
    (r"(?:figure|diagram)\s*[/&]?\s*(?:figure|diagram)?\s*based", "diagram_based"),
    (r"more\s*than\s*one\s*(?:option|correct)|multiple\s*option", "multiple_option"),
    (r"single\s*[od]ption", "single_option"),
    (r"multiple\s*(?:choice|correct)|\bmcq", "mcq"),
    (r"text\s*-?\s*book", "textbook"),
    (r"exemplar", "exemplar"),
    (r"subjective", "subjective"),
    (r"miscellaneous", "miscellaneous"),
)
BANK_KINDS = (
    "mcq", "single_option", "multiple_option", "fill_blanks", "true_false", "assertion_reason", "very_short_answer",
    "short_answer", "long_answer", "integer", "hots", "textbook", "exemplar", "subjective",
)
HEADING_CHARS = 90

# --- fixed values: lines of a question bank ----------------------------------------------------------------------

NUMBERED = r"^([0-9０-９]{1,3})\s*[.)．）：]\s*(.*)$"
#: A numbered line that can't be a heading, nor anything else but an item.
PLAIN_ITEM = r"^[0-9]{1,3}\s*[.)]\s*[A-Za-z]"
TABLE_RULE = r"^\|(?:\s*:?-{2,}:?\s*\|)+\s*$"
PASSAGE = r"(?iu)^#*\s*(?:passage|paragraph)\s*(?:[-–—]?\s*[IVXivx0-9]{1,4})?\s*[:.]?\s*$"
DIRECTIONS = r"(?iu)^#*\s*DIRECTIONS\b"
DIRECTIONS_RANGE = r"(?iu)^#*\s*DIRECTIONS\s*\(\s*Qs?\b"
SOLUTIONS = r"(?iu)^#*\s*SOLUTIONS\b\s*(?:<br\s*/?>)?\s*(?:[(\-–:]|Brief\b|$)"
SOLUTION = r"(?iu)^(?:##\s+)?(?:SOLUTIO[NM]|SOL\.)\s*(?::\s*(.*))?$"
ILLUSTRATION = r"(?iu)^(?:##\s+)?ILLUSTRATIO[NM]\s*:?\s*(.+)$"
CHECK_KNOWLEDGE = r"(?iu)Check\s+Your\s+Knowledge"
THEORY_RESUMES = r"^\(?(?:[a-z]|[ivx]{1,4})\)\s*[A-Z][^.?!]{2,80}:(?:\s|$)"
H2 = r"^##\s+(.+?)\s*$"
KEYED_ANSWER = r"(\d{1,3})\s*[.)]\s*\(([a-eA-E])\)"
KEY_LINE = r"^\s*(\d{1,3})[.)]\s*\(?([a-eA-E])\)"
KEY_RUN, KEY_WINDOW, KEY_GAP = 5, 60, 40

# --- fixed values: the question classifier -----------------------------------------------------------------------

ASSERTION_REASON = r"(?ius)assertion\s*(?:\(\s*a\s*\)|[:\-])|statement\s*[-\s]*(?:i|1)\s*[:\-].*statement\s*[-\s]*(?:ii|2)\s*[:\-]|\bassertion\b.*\breason\s*(?:\(\s*r\s*\)|[:\-])"
MCQ = r"(?iu)\([abcd]\)|\boption\s+[abcd]\b|\boptions?\s*:\s*"
TRUE_FALSE = r"\btrue\s*/\s*false\b|\btrue\s+or\s+false\b"
MATCH = r"\bmatch\s+(?:the\s+)?following\b"
FILL = r"\bfill\s+in\s+the\s+blanks?\b|\bcomplete\s+the\s+(?:sentence|statement)\b|_{3,}|\.{5,}|…\s*…"
CASE_STUDY = r"(?iu)\b(case\s+study|read\s+the\s+passage|passage\s+based|based\s+on\s+the\s+(?:passage|paragraph)|study\s+the\s+following\s+information)\b"
DIAGRAM = r"(?iu)\b(fig\.?|figure|diagram|image|graph|shown\s+in|refer\s+to\s+the\s+(?:fig|diagram)|as\s+shown\s+below|in\s+the\s+given\s+figure)\b"
ACTIVITY = r"(?iu)\b(activity|experiment|practical|laboratory|lab\s+work|perform\s+the\s+experiment)\b"
FORMULA = r"(?iu)\b(formula|derive|derivation|using\s+the\s+(?:relation|equation|expression)|prove\s+that|law\s+of)\b"
NUMERIC = r"(?iu)\b(find|calculate|compute|determine|evaluate|solve|how\s+(?:much|many|long|fast)|what\s+is\s+the\s+(?:value|magnitude|speed|distance|force|resistance|current))\b"
UNITS = r"(?iu)\d+\s*(?:cm|mm|km|m\/s|m\s*s|kg|g|hz|w|v|a|°|ohm|Ω|mol|l\b|litre|second|min)\b"
ARITHMETIC = r"\d+\s*[+\-×÷=^]"
SHORT_ANSWER = r"^(define|what\s+is|what\s+are|name\s+(?:the|any|two|three|four|five))"
LONG_ANSWER = r"^(explain|describe|discuss|why)\b"
HOTS = r"(?iu)\b(hots|higher\s+order\s+thinking|think\s+and\s+answer|justify\s+your\s+answer|give\s+reasons?\s+for|what\s+would\s+happen\s+if)\b"
APPLICATION = r"(?iu)\b(application|daily\s+life|real\s+life|practical\s+application|give\s+(?:an\s+)?example\s+of|used\s+in\s+(?:our\s+)?daily)\b"
CONCEPTUAL = r"(?iu)\b(why\s+does|why\s+is|distinguish\s+between|differentiate\s+between|state\s+the\s+law|what\s+do\s+you\s+mean)\b"

EXERCISE_LINE = r"(?iu)^#*\s*(?:(\d+)\s+)?(?:Advanced\s*)?Ex[c]?ercise\b\s*(\d*)\s*[:.\-]?\s*(.*?)\s*$"
STOP_TITLE_WORDS = ("the", "a", "an", "of", "and", "in", "to", "its", "for", "on", "or", "with", "by")

# --- fixed values: quality checks --------------------------------------------------------------------------------

RUNON_CHARS = 6000
SIZE_RATIO = 4.0
MIN_ANSWER_QUESTIONS, LOW_RATE, ANY_RATE = 40, 0.05, 0.2
FURNITURE = (
    ("exam tag", r"\[\s*(?:NTSE|JSTSE|KVPY|NSO|IJSO|NSEJS|NSTSE)\b"),
    ("check-your-knowledge banner", r"(?:Time\s+to\s+)?Check\s+Your\s+Knowledge"),
    ("table separator row", r":?-{3,}\s*\|"),
    ("DIRECTIONS preamble", r"\n\s*DIRECTIONS\s*[:(]"),
    ("LaTeX section heading", r"\\section\*"),
    ("un-embedded figure URL", r"!\[\]\(https?://cdn\.mathpix"),
    ("fullwidth punctuation", r"[！-～]"),
)
MATH = r"(?s)<math.*?</math>"
IMAGE = r"<img[^>]*>|!\[[^\]]*\]\([^)]*\)|\[image:[^\]]+\]"
FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
TAG_RULE = r"\|?\s*:?-{2,}:?\s*\|"
DISPLAY_MATH = r"(?<!\$)\$\$(?!\$)"
EXAM_TAG = r"(?iu)\[\s*(NTSE|JSTSE|KVPY|NSO|IJSO|NSEJS|NSTSE|AIIMS|NEET|JEE)[^\]]{0,24}\]"

# --- fixed values: options, keys and matching lists --------------------------------------------------------------

OPTION_MARK = r"[\(\[]?\s*([a-dA-D1-4])\s*[\)\].]\s+"
OPTION_STYLES = ("abcd", "ABCD", "1234")
MIN_OPTIONS, MAX_OPTIONS = 2, 4
STATEMENT = r"(?U)\s(?=[IVX]{2,4}\.\s+[A-Z])"
OPTION_KEY = r"(?iU)^\s*(?:ans(?:wer)?\s*[:\-.]?\s*)?[\(\[]?\s*([a-dA-D1-4])\s*[\)\].]?(?:\s|$)"
MATCH_MARK = r"\(([A-Za-z]|\d{1,2})\)\s*|(?:(?<=[\s>])|^)([A-Za-z]|\d{1,2})[.)]\s+"
MATCH_PAIRING = r"\b[A-E]\s*[-–—→:>]+\s*[a-z0-9]\b"
MATCH_ANSWER = r"(?i)([A-E])\s*[-–—→:>]+\s*([a-z0-9]+)"
MATCH_KEY = r"(?i)^\(?([a-e])\)?\b"
MATCH_FIGURE = r"!\[[^\]]*\]\([^)]*\)|https?://\S+|\[image:[^\]]*\]"
MATCH_OPTION_CHARS = 80
LIST_1 = ("A", "B", "C", "D", "E", "I", "II", "III", "IV", "V")
LIST_2 = ("p", "q", "r", "s", "t", "1", "2", "3", "4", "5")

# --- fixed values: what runs on after a question or an answer ----------------------------------------------------

RUN_ON = (
    r"(?:[→>]\s*)?(?:Time\s+to\s*\n?\s*)?(?:Check\s+Your\s*\n?\s*)+Knowledge\b",
    r"\\section\*\{",
    r"DIRECTIONS\s*[:(]",
    r"(?:##\s*)?(?:SOLUTION|SOL\.)[ \t]*:?[ \t]*$",
    r"(?:##\s*)?ILLUSTRATIO[NM]\b",
)
BANNER = r"(?iu)\A[ \t]*(?:[→>]\s*)?(?:Time\s+to\s+)?(?:Check\s+Your\s+)+Knowledge(?:\s+Knowledge)*[ \t]*[-–—:.]*[ \t]*(?=\n|\z)"
HEADING_TAIL_CHARS = 70

# --- fixed values: figures ---------------------------------------------------------------------------------------

IMAGE_URL = r"!\[[^\]]*\]\((https?://[^)]+)\)"
IMAGE_TOKEN = r"(?i)\[image:\s*(img_\d+)\]"
KEPT_SUMMARIES = ("student_llm", "llm")
#: A logo's crop: its least left edge, greatest top edge and sides; the band that it takes of a page.
LOGO_LEFT, LOGO_TOP, LOGO_SIDES, LOGO_BAND = 1300, 650, (380, 550), 460
#: A whole page's least sides; a page is trimmed if its top edge is no lower than TRIM_TOP and TRIM_HEIGHT are left.
PAGE_SIDE, TRIM_TOP, TRIM_HEIGHT = 1200, 500, 400
#: How far above its estimated line a topic may begin: this share of the lines, this many at least.
SLACK_SHARE, SLACK_LINES = 0.03, 80

# --- fixed values: titles, side boxes and case studies -----------------------------------------------------------

BANK_TITLES = (
    r"(?iu)multiple choice|mcq|assertion|fill in the blank|true\s*/\s*false|match the following|match following|passage\s+based|very short answer|short answer|long answer|reasoning|hots|case study based|text\s*-\s*book|exemplar|revision\s+exercise|examination|give answer in",
    r"(?iu)^DIRECTIONS\s*:",
    r"(?iu)^(?:or|solutions|answer key|answers)$",
)
NON_THEORY_TITLES = (
    r"(?iu)^(?:ILLUSTRATION|CASE\s+STUDY|Exercise|Text-?Book|Exemplar|Excercise|Single\s+Option|Multiple\s+Option|DIRECTIONS|SOLUTION|Physics)$",
    r"(?iu)^ILLUSTRATIO[NM]\s*:?\s*.",
    r"(?iu)^CASE STUDY",
    r"(?iu)^Exercise(?:\s*<br\s*/?>|\s*$|\s+(?!Questions))",
    r"(?iu)^(?:SOLUTIO[NM]|SOL\.)\s*(?::.*)?$",
    r"(?iu)^SOLUTIONS\b",
    r"(?iu)Check Your Knowledge",
)
SIDE_TITLES = (r"(?iu)^(?:Keep in Memory|Learn More)", r"(?iu)^(?:physics|connecting topic|abstract)$", r"(?iu)Check Your Knowledge")
CASE_STUDY_HEADING = r"(?iu)^##\s+(CASE STUDY.*?)\s*$"
CASE_PROMPT = r"(?imu)^(CASE[^\S\n]*-[^\S\n]*[IVXLCDM]+|Q\.[^\S\n]*\d+)[^\S\n]*[:：]?[^\S\n]*"
INLINE_CHECK = r"(?ius)(?:\A|(?<=\n))[^\n]*Check Your Knowledge[^\n]*(?:\n|\z)(?:.*?(?<=\n)[^\S\n]*(?:##[^\S\n]+)?(?:SOLUTIO[NM]|SOL\.)[^\S\n]*(?::[^\n]*)?(?:\n|\z)|.*\z)"
TITLE_CHARS = 500
KEPT_EXAMPLES = ("illustration", "check_your_knowledge")
EXAMPLE_ARRAYS = (("illustrations", "illustration"), ("check_your_knowledge_items", "check_your_knowledge"), ("textbook_exercises", "textbook_exercise"))
TEXTBOOK_WORDS = r"(?i)text-book|textbook|text book|exemplar"

# --- fixed values: merged replies, key points and summaries --------------------------------------------------------
MERGED_SUMMARIES, MERGED_POINTS, MERGED_PRACTICE, QUESTION_KEY_CHARS = 4, 12, 6, 80
KEY_POINTS = 20
SUBHEADING = r"(?mU)^[^\S\n]*#{2,3}[^\S\n]+\S[^\n]*$"
SUMMARY_CHARS, SUBSUMMARY_CHARS, OVERVIEW_CHARS, SNIPPET_CHARS, SNIPPETS, SNIPPET_LEAST = 700, 450, 900, 200, 6, 35
PARAGRAPH_LEAST = 40
OVERVIEW_HEADING = "Chapter Introduction"
EXCERPT_HEAD = "Key ideas (auto-excerpt — run with --summarize-llm for student-friendly notes):\n"
PIPE_RULE = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"
LATEX_LEAK = r"\$[^$]+\$|\$\$[^$]+\$\$"
