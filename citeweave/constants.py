"""Fixed values of the citation rules: word lists, patterns, weights and thresholds.

Everything here has to be as it is for results to be right; nothing here is computed.
Patterns are for Java regular expressions.
"""

from __future__ import annotations

# ---- fixed values: folding of letters that have no ASCII decomposition
FOLD_LETTERS = {
    "Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Ø": "O", "ø": "o",
    "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ŋ": "N", "ŋ": "n", "Ŧ": "T", "ŧ": "t", "ẞ": "SS", "ß": "ss",
}
#: Queries also take the Greek beta for an eszett (a common misreading of scans).
FOLD_LETTERS_QUERY = FOLD_LETTERS | {"Β": "SS", "β": "ss"}

# ---- fixed values: word lists
COMMON_TITLE_WORDS = ["the", "and", "for", "with", "from", "into", "onto", "between", "within", "without", "through", "article", "articles", "journal", "book", "chapter"]
BROAD_TITLE_WORDS = [
    "relationship", "study", "review", "reviews", "scoping", "evidence", "among", "adolescents", "adolescent", "mental", "health", "social", "media", "young", "adults", "adult", "use", "uses", "disorders",
]
PUBLISHER_GENERIC_WORDS = ["academic", "books", "inc", "incorporated", "limited", "press", "publisher", "publishers", "publishing", "publications", "university"]
EDITOR_NOISE_WORDS = ["and", "en", "ed", "eds", "editor", "editors", "in", "red", "reds"]
NAME_PARTICLES = ["de", "del", "della", "den", "der", "di", "du", "la", "le", "ten", "ter", "van", "von"]
INGEST_PARTICLES = [
    "van", "de", "den", "der", "ten", "ter", "te", "von", "vom", "zu", "zur", "le", "la", "les", "du", "des", "del", "da", "das", "dos", "di", "della", "degli", "delle", "dal", "dalla", "dai", "dagli", "el", "al",
]
DISPLAY_PARTICLES = ["al", "bij", "da", "de", "del", "den", "der", "di", "du", "el", "la", "le", "ten", "ter", "van", "von"]
JOURNAL_CONNECTORS = ["a", "an", "and", "de", "der", "des", "for", "in", "la", "le", "of", "on", "the", "und", "van", "von"]
BIBLIOGRAPHY_HEADINGS = [
    "reference", "references", "bibliography", "works cited", "list of references", "reference list", "referencelist", "literatuur", "literatuurlijst", "literature", "bronnenlijst", "lijst van bronnen", "referenties", "bibliografie", "source list",
]
OTHER_HEADINGS = [
    "appendix", "appendices", "appendix a", "appendix b", "appendix c", "appendix d", "bijlage", "bijlagen", "acknowledgments", "acknowledgements", "dankwoord", "about the author", "over de auteur",
]
HEADING_STYLES = ["heading 1", "heading 2", "heading 3", "kop 1", "kop 2", "kop 3", "title", "subtitle"]

# ---- fixed values: catalog
TABLES = ["search_journal", "search_book", "search_book_chapter", "search_conference"]
TABLES_OF_CTYPE = {"journal_article": ["search_journal", "search_conference"], "book": ["search_book"], "book_chapter": ["search_book_chapter"]}
GRANULARITY = {"search_journal": "article", "search_conference": "article", "search_book": "book", "search_book_chapter": "chapter"}
TABLE_OF_TYPE = {
    "search_journal": ["journal-article", "article-journal", "journal", "posted-content", "dataset"],
    "search_book_chapter": ["book-chapter", "chapter", "reference-entry"],
    "search_conference": ["conference-paper", "proceedings-article", "paper-conference"],
    "search_book": ["book", "monograph", "edited-book", "reference-book", "report"],
}
YEAR_KEYS = ["published-print", "published-online", "created", "issued"]
DOI_PREFIX = r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
DOI_BOUNDARIES = ".-/_;:()"
DOI_STEM_LENGTH = 10

# ---- fixed values: matching
MAX_CANDIDATES = 5
SCORE_WEIGHTS = {"doi_exact": 1.0, "doi_equivalent": 0.85, "title": 0.45, "author": 0.2, "year": 0.15, "container": 0.1, "metadata": 0.1}
METADATA_WEIGHTS = {"volume": 0.55, "issue": 0.30, "pages": 0.15}
PREFIX_CREDIT = 0.8
NEAR_YEAR_SCORE = 0.33
TITLE_CUTS = [(0.95, "exact_or_near_exact"), (0.6, "strong"), (0.3, "partial")]
AUTHOR_CUTS = [(1.0, "strong"), (0.5, "partial")]
SECOND_LEAST = 0.35
STRONG_SCORE = 0.75
PROVISIONAL_SCORE = 0.6
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6

# ---- fixed values: evaluation
COMPONENT_WEIGHTS = [("title", 0.36), ("author", 0.25), ("year", 0.12), ("container", 0.09), ("doi", 0.12), ("metadata", 0.06)]
DOI_SCORES = {"exact": 1.0, "equivalent": 0.95, "none": 0.10}
TITLE_SCORES = {"exact_or_near_exact": 1.0, "strong": 0.82, "partial": 0.56, "weak": 0.18}
AUTHOR_SCORES = {"strong": 1.0, "partial": 0.65, "weak": 0.20}
YEAR_SCORES = {"exact": 1.0, "near": 0.55, "missing": 0.20}
CONTAINER_SCORES = {"yes": 1.0, "unknown": 0.30}
METADATA_SCORES = {"exact": 1.0, "partial": 0.60, "unknown": 0.25}
AMBIGUITY = [(0.12, 0.0), (0.08, 0.04), (0.04, 0.10)]
AMBIGUITY_WORST = 0.18
GAP_MINOR = 0.08
STRUCTURE_MAJOR, STRUCTURE_MEDIUM, STRUCTURE_MINOR = 0.24, 0.12, 0.05
TYPE_MAJOR, TYPE_MINOR = 0.22, 0.10
VERIFIED_LEAST, REVIEW_LEAST = 0.82, 0.55
OVERRIDE_GAP = 0.20
RUNNER_UP_GAP = 0.30
CONFIDENCE_NAMES = [(0.82, "high"), (0.65, "medium"), (0.55, "low")]

# ---- fixed values: classification
RETRIEVAL = r"\b(?:geraadpleegd|opgehaald|bekeken|bezocht|retrieved|accessed|geopend)\s+op\b"
DOI_TEXT = r"\b(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+\b"
URL_TEXT = r"\b(?:https?://|www\.)\S+\b"
VOLUME_ISSUE = r"\b\d+\s*\(\s*\d+\s*\)"
PAGES = r"\b(?:pp?\.\s*)?\d+\s*[-–]\s*\d+\b"
REPORT = r"\b(rapport|jaarverslag|brochure|persbericht|discussion paper|white paper|policy brief|working paper)\b"
CONFERENCE = r"\b(proceedings|proc\.|conference|symposium|workshop|congres|conferentie|summit|paper presented)\b"
THESIS = r"\b(proefschrift|dissertatie|thesis|dissertation|masterscriptie|masterthesis|scriptie)\b"
DATASET = r"\b(dataset|data set|databestand|datafile|repository|zenodo|figshare|osf|dataverse)\b"
SOFTWARE = r"\[(?:generatieve ai|software|computer software|app|mobile app|ai)\]|\b(?:versie|version)\s+\S+"
NEWS = r"\b(krant|newspaper|nieuws|news|guardian|times|volkskrant|nrc|trouw|telegraaf|parool|bbc)\b"
CHAPTER = r"(?:[\"'“”‘’)\],.;:])\s+In:?\s+"
EDITOR = r"\b(?:Ed\.|Eds\.|red\.|redacteur|editors?)\b"
BOOK_CONTAINER = r"(?:[\"'“”‘’)\],.;:])\s+In:?\s+.+\b(?:pp?\.)"
EDITED_CONTAINER = r"(?:[\"'“”‘’)\],.;:])\s+In:?\s+.+?(?:\((?:Ed\.|Eds\.|red\.|reds\.)\)|\bred\.)"
IN_CONTAINER = r"(?:[\"'“”‘’)\],.;:])\s+In:?\s+.+"
SCHOLARLY_CONTAINER = r"\b(journal|review|quarterly|tijdschrift|annals|transactions|bulletin|letters)\b"
REPORT_CONTAINER = r"\b(rapport|jaarverslag|brochure|white paper|policy brief|working paper)\b"
EDITED_REPORT = r"\b(jaarrapport|armoede|monitor|verzorgingsstaat|working poor|sociale uitsluiting|poverty monitor)\b"
ORGANIZATION = (
    r"\b(ministerie|gemeente|provincie|rijks(?:overheid|dienst|instituut)?|instituut|bureau|commissie|commission|agency|organisatie|organization|"
    r"association|vereniging|foundation|stichting|universiteit|university|college|school|gemeenschap|raad|council|openai|movisie|eurostat)\b"
)
RETRIEVAL_NOISE = r"^(?:geraadpleegd|opgehaald|bekeken|bezocht|retrieved|accessed|geopend)\s+op$"

# ---- fixed values: lines of a reference list
AUTHOR_TOKEN = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'`\-]+"
AUTHOR_PARTICLE = r"(?:de|den|der|van|von|la|le|del|della|di|du|ten|ter)"
YEAR = r"(?:\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\b(?:19|20)\d{2}[a-z]?\b)"
WEB_DATE = r"\(\s*(?:19|20)\d{2}\s*,\s*(?:\d{1,2}\s+[A-Za-zÀ-ÖØ-öø-ÿ]+|[A-Za-zÀ-ÖØ-öø-ÿ]+\s+\d{1,2})\s*\)"
STRONG_MARK = r"(doi:\s*\S+|https?://\S+|www\.\S+|\bissn\b|\bisbn\b|\b10\.\d{4,9}/\S+)"
NUMBERED_LINE = r"^(?:(?:\d+|[ivxlcdm]+)[\.\)]\s+|\[(?:\d+|[ivxlcdm]+)\]\s+)"
BULLET_LINE = r"^[*•·]\s+"

# ---- fixed values: shapes of citation styles
STYLE_APA = r"^\s*[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]+,\s+(?:[A-Z]\.\s*){1,4}[^()]{0,160}\(\s*(?:19|20)\d{2}[a-z]?\s*\)\.\s+\S"
STYLE_AUTHOR_YEAR = r"^\s*[A-ZÀ-ÖØ-Þ][^.\n]{0,180}(?:\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\b(?:19|20)\d{2}[a-z]?\b)"
STYLE_NUMBERED = r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s+\S"
STYLE_HARVARD_QUOTED = r"(?i)^\s*[A-ZÀ-ÖØ-Þ].{0,180}\b(?:19|20)\d{2}[a-z]?\s*,?\s*['‘’][^'‘’]+['‘’]"
STYLE_HARVARD_YEAR = r"^\s*[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]+,\s+(?:[A-Z]\.\s*){1,4}(?:,\s*)?(?:19|20)\d{2}[a-z]?\b"
STYLE_MLA = r"(?i)^\s*[A-ZÀ-ÖØ-Þ][^.\n]{1,120}\.\s+[\"“][^\"”]+[\"”]\s+"
STYLE_CHICAGO = r"(?i)^\s*[A-ZÀ-ÖØ-Þ][^.\n]{1,120}\.\s+[^.]{3,160}\.\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ .'-]+:\s+[^,]+,\s+(?:19|20)\d{2}\.?"
CUE_DUTCH = r"(?i)\b(?:geraadpleegd|opgehaald|bekeken|bezocht|geopend)\s+op\b|\bz\.d\.\b"
CUE_ENGLISH = r"(?i)\b(?:retrieved|accessed)\s+(?:on|from)\b|\bn\.d\.\b"
HEADING_DUTCH = r"(?i)\b(?:literatuur(?:lijst)?|bibliografie|bronnen(?:lijst)?|geraadpleegde\s+bronnen|gebruikte\s+literatuur|referenties)\b"
HEADING_ENGLISH = r"(?i)\b(?:references|reference\s+list|bibliography|works\s+cited|literature\s+cited)\b"
PROFILE_NUMBERED = r"^\s*(?:\[\d+\]|\d{1,3}[\.)])\s+\S"
PROFILE_AUTHOR_YEAR = (
    r"(?i)^\s*(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]+,\s*(?:[A-Z]\.|[A-Z][A-Za-zÀ-ÖØ-öø-ÿ-]+)[^\n]{0,120}"
    r"(?:\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\b(?:19|20)\d{2}[a-z]?\b)|[A-Z0-9][^\n]{0,80}\(\s*(?:19|20)\d{2}[a-z]?)"
)
PROFILE_NOTES = r"^\s*(?:[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'`-]+,\s+[A-Z]|[\"“][^\"”]{8,}[\"”]\.)"
STYLES = {  # style: (segmentation family, parser profile, citation style, locale)
    "unknown": ("auto", "generic", "apa-standard", "nl-NL"),
    "apa7_nl": ("author_year", "apa7_nl", "apa-standard", "nl-NL"),
    "apa7_en": ("author_year", "apa7_en", "apa-standard", "en-US"),
    "harvard": ("author_year", "harvard", "harvard", "en-GB"),
    "chicago": ("notes_bibliography", "chicago", "chicago", "en-US"),
    "mla": ("notes_bibliography", "mla", "mla", "en-US"),
    "vancouver": ("numeric", "vancouver", "vancouver", "en-US"),
}

# ---- fixed values: Dutch citations
DUTCH_PARTICLES = "de|del|della|den|der|di|du|la|le|ten|ter|van|von"
DUTCH_RETRIEVED = r"(?i)(Geraadpleegd op\s+.+?,\s+van\s+(?:https?://\S+|www\.\S+))"
DUTCH_GREY = r"(?i)\b(rapport|jaarverslag|brochure|persbericht|discussion paper)\b"
DUTCH_GREY_GENRE = "informele_publicatie"
DUTCH_EDITORS = r"(?i)\bIn:?\s+(.+?)\s*\(\s*reds?\.?\s*\)"
DUTCH_NO_DATE = "z.d."
HYPHENATED_WORDS = ("cost-benefit", "cross-case", "e-mail", "full-time", "in-depth", "in-work", "long-term", "part-time", "self-help", "short-term", "well-being")

# ---- fixed values: shapes of the lines of a reference list
COMMA_AUTHOR = (
    rf"(?:{AUTHOR_TOKEN}|(?:{AUTHOR_PARTICLE}\s+{AUTHOR_TOKEN}(?:\s+{AUTHOR_TOKEN})?|{AUTHOR_TOKEN}\s+{AUTHOR_PARTICLE}\s+{AUTHOR_TOKEN}(?:\s+{AUTHOR_TOKEN})?))"
    r",\s*(?:(?:[A-Z]\.\s*){1,4}|[A-Z][A-Za-z\-]+\s*,?\s*)"
)
PLAIN_AUTHOR = rf"(?:{AUTHOR_TOKEN}(?:\s+{AUTHOR_TOKEN}){{0,2}})\s+[A-Z](?:[A-Z\-\. ]{{0,18}})"
LINE_SHAPES = {
    "comma_author": rf"(?i)^\s*{COMMA_AUTHOR}",
    "plain_author": rf"^\s*{PLAIN_AUTHOR}",
    "year": YEAR,
    "web_date": f"(?i){WEB_DATE}",
    "strong": f"(?i){STRONG_MARK}",
    "separator_end": r"(?i)(?:,|&|\band\b)\s*$",
    "year_end": r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)\.\s*$",
    "link_end": r"(?i)(doi:\s*\S+|https?://\S+|www\.\S+)\s*$",
    "full_stop": r"\.$",
    "undated": r"(?i)\(n\.d\.\)|z\.d\.",
    "organization": r"^\s*[A-Za-z0-9][^\n]{4,}$",
    "organization_year": r"(?i)^\s*[A-Za-z0-9][^\n]{0,80}\(\s*(?:19|20)\d{2}[a-z]?(?:\s*,|\s*\))",
    "url_only": r"(?i)^\s*(?:https?://|www\.)\S+\s*$",
    "url_start": r"(?i)^(?:https?://|www\.)\S+",
    "url": r"(?i)(?:https?://|www\.)\S+",
    "doi_only": r"(?i)^\s*(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+\s*$",
    "retrieval": r"(?i)^\s*(?:retrieved|accessed|opgehaald|geraadpleegd)\b",
    "journalish": r"(?i)\b(?:\d+\(\d+\)|pp?\.\s*\d|vol\.?|volume|issue|journal|press|publisher|https?://|doi:|10\.)",
    "title_led": r"(?i)^\s*(?:[\"“”']?[A-Z][^.!?]{8,120}\.)\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'`\-]+",
    "numeric_start": r"(?i)^\s*(?:\[(?:\d+|[ivxlcdm]+)\]|(?:\d+|[ivxlcdm]+)[\.\)])\s+",
    "lower_start": r"^\s*(?:and|or|en|of|van|von|der|den|de|het|the)\b",
    "journal_start": r"^\s*[A-Z][A-Za-zÀ-ÖØ-öø-ÿ0-9&'`\-:/ ]{3,120},\s*\d",
    "volume_start": r"(?i)^\s*(?:vol\.?\s*\d+|\d+\s*(?:\(\d+\))?[,;:]\s*(?:\d+|[A-Z]?\d+|Article\b))",
    "article_number": r"(?i)\b(?:article|e)\s*[A-Za-z]?\d+\b",
    "report_tail": r"(?i)^\s*(?:final\s+report|report|part\s+\d+)\b.*(?:https?://|www\.)",
    "volume_inside": r"\b\d+\s*(?:\(\d+\))?[,;:]\s*\d",
    "marker": r"(?i)^(?:\[(?:\d+|[ivxlcdm]+)\]|(?:\d+|[ivxlcdm]+)[\.\)]|[*•·])\s+",
    "numbered": f"(?i){NUMBERED_LINE}",
    "bullet": BULLET_LINE,
    "profile_numbered": PROFILE_NUMBERED,
    "profile_dated": PROFILE_AUTHOR_YEAR,
    "profile_notes": PROFILE_NOTES,
}

# ---- fixed values: limits
MAX_REFERENCES = 1000
MAX_PASTED_CHARS = 120_000
UPLOAD_BYTES = 26_214_400
MAX_PAGES = 150
MAX_EXTRACTED_CHARS = 200_000
