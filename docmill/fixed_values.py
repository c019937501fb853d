"""Fixed values.

Results depend on these exact patterns, word lists, texts and limits, so they
are stated here once, as plain text. Everything else in the package derives
from them.
"""

# --- Patterns, as regular expressions over Unicode text -------------------
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"\+?\d[\d\s-]{7,}\d"
DATE_PATTERN = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
SIGNER_PATTERN = (
    r"(signed by|signature|authorized signatory|attested by)"
    r"\s*[:\-]?\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)"
)

# --- Word lists -----------------------------------------------------------
CLAUSE_KEYWORDS = (
    "termination", "confidentiality", "liability", "warranty",
    "dispute", "governing law", "payment", "obligation",
    "indemnity", "agreement",
)
SUMMARY_KEYWORDS = (
    "plaintiff", "defendant", "judgment", "court", "order",
    "section", "contract", "agreement", "claim",
)
PAGE_TAGS = (("date", "Date"), ("name", "Name"), ("contract", "Contract"))

# --- File names -----------------------------------------------------------
ACCEPTED_TYPES = ("pdf", "docx", "xls", "xlsx", "png", "jpg", "jpeg")
IMAGE_TYPES = ("png", "jpg", "jpeg", "tiff", "bmp", "gif")
UNKNOWN_TYPE = "unknown"
DEFAULT_FILENAME = "uploaded_file"

# --- Texts ----------------------------------------------------------------
MARKER_LEGAL = "✅ LEGAL"
MARKER_UNVERIFIED = "❌ UNVERIFIED"
NO_SUMMARY = "No summary available."
EMPTY_DOCUMENT = "Empty document"
NO_FILE = "No file selected."
UNSUPPORTED_TYPE = "Unsupported file type"
NO_TEXT = "Failed to extract text from file."
DOCUMENT_NOT_FOUND = "Document not found"
NO_DOCUMENT_OR_TEXT = "Provide doc_id or text parameter"
NOTHING_TO_SUMMARIZE = "⚠️ No text provided for summarization."
NOTHING_TO_ANSWER = "⚠️ Context or question missing."
CHART_LABELS = ("NLP Legality Score", "AI Confidence")

VERDICT_PROMPT = (
    "You are a legal document verification assistant. "
    "Given the document text, answer ONLY in strict JSON with fields: "
    '"status" (LEGAL or UNVERIFIED), "confidence" (integer 0-100), and an optional "note".\n\n'
    "Document (first 2000 chars):\n"
)
SUMMARIZE_PROMPT = "Summarize the following document text briefly:\n\n"
QUESTION_LABEL = "\n\nQuestion: "
ANSWER_LABEL = "\nAnswer briefly:"

# --- Limits ---------------------------------------------------------------
VERDICT_CHARS = 2000
HIT_PREVIEW_CHARS = 400
UPLOAD_PREVIEW_CHARS = 500
RECORD_PREVIEW_CHARS = 100
KEYWORDS_KEPT = 10
SUMMARY_SENTENCES = 3
SUMMARY_MIN_CHARS = 20
HEURISTIC_SENTENCES = 5
HEURISTIC_BONUS = 50
CHUNK_CHARS = 900
CHUNK_ABOVE = 1000
SEARCH_K = 5
