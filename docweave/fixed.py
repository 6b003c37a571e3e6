"""Vocabularies, patterns and limits that define the results.

Everything in this module is data. Operators take these values as defaults of parameters, so the
same operator runs with another vocabulary. Patterns are written for a case-insensitive, Unicode
aware match unless a comment says otherwise. Order matters: the first matching entry wins.
"""

# --- fixed values: places -------------------------------------------------------------------
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa",
    "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland",
    "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi", "Lakshadweep",
    "Puducherry", "Jammu and Kashmir", "Ladakh", "Chandigarh",
]
STATE_ALIASES = [
    ("Andaman and Nicobar Islands", ["andaman", "nicobar"]),
    ("Dadra and Nagar Haveli and Daman and Diu", ["dadra", "daman", "diu"]),
    ("Odisha", ["orissa"]),
    ("Tamil Nadu", ["tamilnadu", "tn"]),
    ("Jammu and Kashmir", ["j&k", "jammu", "kashmir"]),
    ("Delhi", ["new delhi", "nct of delhi"]),
    ("Puducherry", ["pondicherry"]),
    ("Uttarakhand", ["uttaranchal"]),
]

# --- fixed values: section headings and page noise ------------------------------------------
HEADINGS = [
    "Introduction:", "Benefits", "Eligibility", "Exclusions", "Application Process",
    "Documents Required", "Frequently Asked Questions", "Sources And References",
]
HEADING_SYNONYMS = [
    "Financial Assistance", "Support Available", "Who Can Apply", "Objectives", "FAQs", "FAQ", "Sources",
]
FALLBACK_NOISE = [
    "Are you sure you want to sign out?", "Cancel", "Sign Out", "Sign In", "Feedback",
    "Something went wrong.", "Please try again later.", "Apply Now", "Check Eligibility", "Back",
    "Was this helpful?",
]
BUTTON_PHRASES = ["Check Eligibility", "Apply Now"]
FOOTER_PHRASES = [
    "No new news and updates available©2024", "Y)Government of India®", "Get in touch4th Floor",
    "Electronics Niketan, 6 CGO Complex, Lodhi Road, New Delhi - 110003, India",
    "(011) 24303714", "v-2.1.1",
]
FOOTER_GAP = r"\(DIC\).{0,60}?\(Meit"
FOOTER_LOOSE = "support- myscheme[at]digitalindia[dot]gov[dot]in"
SECTION_DELIMITER = "\n---SECTION---\n"
CONFIDENCE_THRESHOLD = 0.5
CATEGORY_THRESHOLDS = {"benefits": 0.45, "objectives": 0.45}
SEED_PHRASES = {
    "objectives": ["Objectives", "Introduction", "Objectives of the scheme",
                   "Purpose and goals of the scheme", "About the scheme"],
    "benefits": ["Benefits", "Financial Assistance", "Support Available", "Benefits of the scheme",
                 "Financial assistance provided", "What you get from the scheme"],
    "eligibility": ["Eligibility", "Eligibility criteria", "Who can apply for the scheme", "Conditions to qualify"],
    "exclusions": ["Exclusions", "Not Eligible", "Exclusions from the scheme", "Who is not eligible",
                   "Ineligibility conditions"],
    "documents_required": ["Documents Required", "Documents required for application",
                           "List of documents needed", "Required documentation"],
    "application_process": ["Application Process", "How to Apply", "Application process",
                            "How to apply for the scheme", "Steps to apply"],
    "faqs": ["Frequently Asked Questions", "FAQs", "Frequently asked questions",
             "Questions and answers about the scheme", "FAQ"],
}
LIST_FIELDS = {
    "objectives": ("overview", "objectives"),
    "benefits": ("benefits", "other_benefits"),
    "eligibility": ("eligibility", "conditions"),
    "exclusions": ("eligibility", "exclusions"),
    "documents_required": ("application", "documents"),
    "application_process": ("application", "steps"),
}
TITLE_CONNECTORS = ["of", "and", "the", "for", "in", "to", "&"]

# --- fixed values: names and descriptions ---------------------------------------------------
FILE_SUFFIXES = [r"\s+copy$", r"\s+\(\d+\)$", r"\s*-\s*copy$", r"_copy$", r"-copy$", r"\scopy\s\d+$"]
NAME_SUFFIX = r"[\s*_]*(?:are\s+you\s+sure\s+you\s+want\s+to\s+sign\s*out\s*\??|sign\s*out)[\s*_]*$"
POPUP_SENTENCE = (r"^\s*It seems you have already initiated your application earlier\.\s*"
                  r"To know more please visit\s*")
POPUP_HEADER = r"^(.{0,400}?)Details\s*"
MAX_HEADER_CHARS = 250
MIN_DESCRIPTION_CHARS = 40
MAX_LIST_ITEM_CHARS = 600
PAGE_SECTIONS = [
    ("description", r"^(details|overview|about|description)$"),
    ("benefits", r"^benefits?$"),
    ("eligibility", r"^eligibility"),
    ("documents", r"^documents? required"),
    ("steps", r"^application process"),
]
UPDATED_PATTERN = r"(?:last\s+updated|updated\s+on)\s*[:\-]?\s*([0-9A-Za-z ,/\-]{6,20})"

# --- fixed values: matching -----------------------------------------------------------------
HYPHENS = "‐‑‒–—−"
QUOTES = "‘’“”"
QUOTES_PLAIN = "''\"\""
MIN_NAME_CHARS = 4
MIN_LOOKUP_CHARS = 8
GENERIC_NAME_WORDS = [
    "scheme", "schemes", "for", "the", "of", "and", "in", "to", "a", "an", "on", "by", "with", "yojana", "yojna",
    "programme", "program", "mission",
]

# --- fixed values: safety -------------------------------------------------------------------
ID_MASKS = [
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[number removed]"),
    (r"\b[A-Za-z]{5}\d{4}[A-Za-z]\b", "[id removed]"),
    (r"\b\d{9,}\b", "[number removed]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email removed]"),
]
INSTRUCTION_PATTERN = (
    r"ignore\s+(?:all|any|the|previous|prior|above|your)|disregard|system\s+prompt|you\s+are\s+now|pretend|"
    r"jailbreak|reveal|set\s+(?:the\s+)?intent|act\s+as|developer\s+mode|\boverride\b"
)
MAX_QUERY_CHARS = 300
MAX_MESSAGE_CHARS = 1000

# --- fixed values: message rules ------------------------------------------------------------
CATEGORIES = [
    ("sc", r"\bsc\b|scheduled caste"),
    ("st", r"\bst\b|scheduled tribe"),
    ("obc", r"\bobc\b|other backward class"),
    ("general", r"\bgeneral category\b"),
]
SEARCH_CATEGORIES = CATEGORIES + [
    ("women", r"\bwomen\b|\bwoman\b|\bfemale\b"),
    ("farmer", r"\bfarmer[s]?\b"),
    ("student", r"\bstudent[s]?\b"),
    ("differently abled", r"differently abled|disability|\bpwd\b"),
]
RULE_CATEGORIES = CATEGORIES + [
    ("women", r"\bwomen\b|\bwoman\b|\bfemale\b"),
    ("differently abled", r"differently abled|\bdisability\b|\bpwd\b"),
    ("ex-serviceman", r"ex-?servicem[ae]n"),
]
BENEFIT_TYPES = [
    ("housing", r"\bhousing\b|\bhouse\b"),
    ("education", r"\beducation\b|\bscholarship\b"),
    ("health", r"\bhealth\b|\bmedical\b"),
    ("agriculture", r"\bagricultur\w*\b|\bcrop\b|\bfarming\b"),
    ("employment", r"\bemployment\b|\bjob\b|\bself[- ]employ\w*\b"),
]
GENDERS = [
    ("female", r"\bfemale\b|\bwoman\b|\bi\s*am\s*a?\s*girl\b"),
    ("male", r"\bmale\b|\bman\b|\bi\s*am\s*a?\s*boy\b"),
    ("other", r"\bnon[- ]binary\b|\bother gender\b|\btransgender\b"),
]
AGE_PHRASES = [
    r"\bi\s*am\s*(\d{1,3})\s*years?\s*old\b",
    r"\bage\s*(?:is|:)?\s*(\d{1,3})\b",
    r"\b(\d{1,3})\s*years?\s*old\b",
]
INCOME_PHRASES = [
    r"income\s*(?:of|is|:)?\s*(?:rs\.?|₹|rupees)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|lakhs|crore|crores)?",
    r"earn\s*(?:rs\.?|₹|rupees)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|lakhs|crore|crores)?",
    r"(?:rs\.?|₹|rupees)?\s*([\d,]+(?:\.\d+)?)\s*(lakh|lakhs|crore|crores)",
    r"^\s*(?:rs\.?|₹|rupees)?\s*([\d,]{4,}(?:\.\d+)?)\s*()$",
]
UNITS = {"lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000, "crores": 10_000_000}

DETAIL_PATTERNS = [
    r"\bwho\s+(?:all\s+)?(?:can|could|may)\s+apply\b", r"\bwho\s+(?:is|are)\s+eligible\b",
    r"\bhow\s+(?:can|do|should|to)\s+(?:i\s+)?apply\b",
    r"\btell\s+me\s+more\b", r"\bmore\s+(?:details?|info(?:rmation)?)\b",
    r"\bdetails?\s+(?:of|about|on|for)\b", r"\bgive\s+me\s+(?:the\s+)?details?\b",
    r"\bdocuments?\s+(?:needed|required|necessary)\b", r"\beligibility\s+criteria\b",
    r"\bapplication\s+(?:process|procedure)\b",
    r"\bkaun\b.*\b(?:apply|avedan|aavedan)\b", r"\bkaise\s+(?:apply|avedan|aavedan)\b",
    r"\baur\s+(?:batao|bataiye|jaankari|jankari)\b", r"\bdastavez\b",
]
NATIVE_DETAIL_PATTERNS = [
    r"कौन.*(?:आवेदन|पात्र)", r"और\s*(?:बता|जानकारी)", r"अधिक\s*जानकारी", r"विवरण", r"ब्यौरा",
    r"कैसे\s*आवेदन", r"आवश्यक\s*दस्तावेज",
    r"யார்.*(?:விண்ணப்பிக்க|தகுதி)", r"மேலும்\s*(?:சொல்|தெரிந்து|விவரம்|தகவல்)", r"விவரங்கள்|விவரம்",
    r"எப்படி\s*விண்ணப்பிக்க", r"தேவையான\s*ஆவணங்கள்",
]
ELIGIBILITY_PATTERNS = [r"am i eligible", r"do i qualify", r"can i apply", r"check eligibility", r"eligible for"]
DOCUMENT_PATTERNS = [r"\bupload\b", r"verify document", r"check my document", r"my certificate"]
COMPARISON_PATTERNS = [r"\bcompare\b", r"difference between", r"which is better", r"\bvs\b"]
SEARCH_PATTERNS = [
    r"what is", r"tell me about", r"how to apply", r"schemes for", r"benefits of",
    r"documents required", r"schemes? (?:are|is)?\s*available", r"available for",
    r"\bexplain\b", r"\bwhat\s+(?:documents|identity|proof|benefits)\b",
    r"\bdocuments?\b.*\b(?:required|needed|need)\b", r"\b(?:need|require)\b.*\bdocuments?\b",
    r"how much\b", r"how do i (?:claim|get)\b", r"what does\b.*\bprovide\b",
    r"what benefits\b", r"\bwhich scheme\b",
    r"\bwhat schemes?\b", r"\bwhich schemes?\b", r"\bgovernment schemes?\b",
    r"\bschemes? for (?:farmers?|women|students?)\b", r"\bwhat are the schemes?\b",
    r"\btell me (?:the |about )?schemes?\b", r"\bavailable schemes?\b",
    r"\b(?:yojana|yojna)\b",
    # anchored at line starts: the same lines match, without a scan from every character
    r"(?m:^)(?=.*\b(?:yojana|yojna|scheme|labh|subsidy|pension|sahayata|scholarship|bima|anudan|chhatravritti)\b)"
    r".*\b(?:ke\s+baa?re\s+mein|bataiye|batao|kya\s+hai)\b",
]
NATIVE_ELIGIBILITY_PATTERNS = [r"पात्र(?!ता)", r"योग्य", r"आवेदन कर सकता", r"मैं पात्र", r"தகுதியானவர்"]
NATIVE_DOCUMENT_PATTERNS = [r"दस्तावेज अपलोड", r"प्रमाण पत्र"]
NATIVE_SEARCH_PATTERNS = [
    r"योजना", r"स्कीम", r"सब्सिडी", r"लाभ", r"पात्रता", r"आवेदन", r"दस्तावेज",
    r"किसान", r"महिला", r"छात्र", r"शिक्षा", r"आवास", r"स्वास्थ्य", r"रोजगार", r"व्यवसाय",
    r"திட்ட", r"மானியம்", r"நலன்", r"தகுதி", r"விண்ணப்பம்", r"ஆவணம்",
    r"விவசாயி", r"மகளிர்", r"மாணவர்", r"கல்வி", r"வீட்டுவசதி",
]
OFF_TOPIC_PATTERNS = [
    r"\b(?:weather|wether|forecast)\b", r"\bcricket\b|\bcricekt\b|\bipl\b|\bfootball\b|\bsports?\b",
    r"\b(?:match|live)\s+scores?\b", r"\bwho\s+won\b", r"\bjokes?\b|\bjoek\b",
    r"\bmovies?\b|\bfilms?\b|\bbollywood\b",
    r"\brecipes?\b|\brecipie\b|\bbiryani\b|\bhow\s+(?:do\s+i|to)\s+cook\b",
    r"\bstock\s+(?:prices?|market)\b|\bshare\s+(?:prices?|market)\b|\bsensex\b|\bnifty\b|\bbitcoin\b",
    r"\bnews\b", r"ignore\s+(?:all\s+|any\s+|the\s+|your\s+)?(?:previous|prior|above)\s+instructions?",
    r"system\s+prompt", r"\bpoems?\b|\bsongs?\b",
    r"\bpython\b|\bwrite\s+(?:me\s+)?(?:a\s+)?(?:script|code|program)\b",
    r"\bcapital\s+of\b", r"\bgeneral\s+election\b|\bwho\s+will\s+win\b", r"\bresignation\s+letter\b",
    r"मौसम", r"क्रिकेट", r"शेयर\s*बाजार|शेयर\s*बाज़ार", r"फिल्म|फ़िल्म", r"चुटकुला",
    r"வானிலை", r"கிரிக்கெட்", r"பங்குச்?\s*சந்தை", r"திரைப்படம்", r"நகைச்சுவை",
    r"\bmausam\b", r"\bchutkula\b",
]
TOPIC_PATTERNS = [
    r"\bscholarships?\b", r"\bstipends?\b", r"\bpensions?\b", r"\bloans?\b", r"\bsubsid(?:y|ies)\b",
    r"\binsurance\b", r"\bhousing\b", r"\beducation\b", r"\bwidows?\b",
    r"\bdisabled\b|\bdisabilit\w*|\bdivyang\b|\bhandicapped\b",
    r"\bfarm(?:er|ers|ing)\b", r"\bstudents?\b", r"\bwom[ae]n\b", r"\bgirls?\b", r"\bgirl\s+child\b",
    r"\bsc\s*/\s*st\b|\bscheduled\s+(?:caste|tribe)s?\b", r"\bminorit(?:y|ies)\b",
    r"\bemployment\b|\bunemployed\b",
    r"\bskill\w*\b", r"\btraining\b", r"\bsenior\s+citizens?\b|\belderly\b|\bold\s+age\b", r"\bentrepreneurs?\b",
    r"\bhealth\b", r"\bmaternity\b|\bpregnan\w*\b", r"\bcrops?\b", r"\bartisans?\b|\bweavers?\b|\bfisher\w*\b",
    r"\borphans?\b", r"\bwelfare\b", r"\bfinancial\s+assistance\b", r"\bgrants?\b", r"\bbpl\b",
    r"\b(?:chhatravritti|chatravritti|vajifa|vidhwa|vidhva|kisan|mahila|ladki|beti|vikalang|rozgar|rojgar|"
    r"shiksha|awas|karz|vridha\w*|kaushal)\b",
]
NATIVE_TOPIC_PATTERNS = [
    r"छात्रवृत्ति", r"पेंशन|पेन्शन", r"ऋण|लोन", r"बीमा", r"विधवा", r"विकलांग|दिव्यांग", r"अल्पसंख्यक",
    r"बालिका|बेटी|लड़की", r"कौशल", r"प्रशिक्षण", r"अनुसूचित", r"वृद्ध|बुजुर्ग", r"भत्ता", r"अनुदान",
    r"உதவித்தொகை", r"ஓய்வூதியம்", r"கடன்", r"காப்பீடு", r"விதவை", r"மாற்றுத்திறனாளி", r"சிறுபான்மை", r"பெண்",
    r"வேலைவாய்ப்பு", r"திறன்", r"முதியோர்", r"மாணவி",
]
INTENT_ORDER = [
    # (patterns, intent, confidence, topic only); first match wins
    (OFF_TOPIC_PATTERNS, "out_of_scope", 0.9, False),
    (NATIVE_DETAIL_PATTERNS, "scheme_search", 0.85, False),
    (NATIVE_ELIGIBILITY_PATTERNS, "eligibility_check", 0.85, False),
    (NATIVE_DOCUMENT_PATTERNS, "document_upload", 0.85, False),
    (NATIVE_SEARCH_PATTERNS, "scheme_search", 0.85, False),
    (NATIVE_TOPIC_PATTERNS, "scheme_search", 0.8, True),
    (DETAIL_PATTERNS, "scheme_search", 0.9, False),
    (ELIGIBILITY_PATTERNS, "eligibility_check", 0.9, False),
    (DOCUMENT_PATTERNS, "document_upload", 0.9, False),
    (COMPARISON_PATTERNS, "comparison", 0.9, False),
    (SEARCH_PATTERNS, "scheme_search", 0.9, False),
    (TOPIC_PATTERNS, "scheme_search", 0.8, True),
]

GREETINGS = {
    "hi": None, "hii": None, "hello": None, "hey": None, "heyy": None, "hiya": None,
    "namaste": "hi", "namaskar": "hi", "नमस्ते": "hi", "नमस्कार": "hi", "vanakkam": "ta", "வணக்கம்": "ta",
}
THANKS = {
    "thanks": None, "thank": None, "you": None, "thx": None, "very": None, "much": None, "a": None,
    "lot": None, "so": None, "shukriya": "hi", "shukriyaa": "hi", "dhanyavad": "hi", "dhanyavaad": "hi",
    "धन्यवाद": "hi", "शुक्रिया": "hi", "nandri": "ta", "nanri": "ta", "நன்றி": "ta",
}
THANKS_CORE = ["thanks", "thank", "thx", "shukriya", "shukriyaa", "dhanyavad", "dhanyavaad",
               "धन्यवाद", "शुक्रिया", "nandri", "nanri", "நன்றி"]
SMALLTALK_WORD = r"[ऀ-ॿ]+|[஀-௿]+|[\p{L}\p{No}\p{Nl}]+"
MAX_SMALLTALK_WORDS = 5

ORDINALS = {"first": 0, "1st": 0, "second": 1, "2nd": 1, "third": 2, "3rd": 2,
            "fourth": 3, "4th": 3, "fifth": 4, "5th": 4}
ORDINAL_PATTERN = r"\b(?:the\s+)?(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th)\s+(?:one|scheme)\b"
LAST_PATTERN = r"\b(?:the\s+)?last\s+(?:one|scheme)\b"
PRONOUN_PATTERN = r"\b(?:it|this|that|this\s+scheme|that\s+scheme|these|those|them|its|the\s+scheme)\b"
FOLLOWUP_PATTERN = (
    r"who\s+(?:can|is|are|all)|how\s+(?:to|can\s+i|do\s+i)\s+apply|\bapply\b|eligib|documents?|"
    r"\bbenefits?\b|\bamount\b|how\s+much|tell\s+me\s+more|\bmore\s+(?:details?|info|about)|\bdetails?\b|"
    r"\bdeadline\b|last\s+date|\bexplain\b|what\s+is\s+(?:it|this|that)|\bwhat\s+does\b"
)
FILLER_WORDS = [
    "who", "can", "is", "are", "all", "apply", "applying", "for", "how", "to", "do", "i", "it", "its", "this",
    "that", "these", "those", "them", "the", "a", "an", "of", "about", "on", "in", "me", "my", "tell", "more",
    "details", "detail", "info", "information", "documents", "document", "needed", "need", "required", "require",
    "what", "which", "scheme", "schemes", "benefits", "benefit", "eligibility", "eligible", "criteria", "please",
    "explain", "first", "second", "third", "fourth", "fifth", "last", "one", "amount", "much", "does", "and", "or",
    "also",
]
MAX_REMEMBERED = 5

SLOTS = ["age", "state", "income_annual", "category", "gender"]
MAX_SLOT_FAILURES = 3
SKIP_PATTERN = r"^\s*(?:skip|pass|don'?t know|dont know|not sure|prefer not to say|no idea)\s*[.!]*\s*$"
SLOT_CATEGORIES = [
    ("sc", r"\bsc\b|scheduled\s+castes?"),
    ("st", r"\bst\b|scheduled\s+tribes?"),
    ("obc", r"\bobc\b|other\s+backward|backward\s+class"),
    ("general", r"\bgeneral\b|\bgen\b|\bunreserved\b|\bopen\b|\bur\b"),
]
SLOT_GENDERS = [
    ("female", r"\bfemale\b|\bwoman\b|\bwomen\b|\bgirl\b|\blady\b"),
    ("male", r"\bmale\b|\bman\b|\bboy\b|\bgentleman\b"),
    ("other", r"\bother\b|\btransgender\b|\bnon[- ]?binary\b"),
]
SLOT_NUMBER = r"(?:rs\.?|₹|rupees)?\s*(\d[\d,]*(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|thousand|k)?\b"
SLOT_UNITS = {"lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000,
              "crore": 10_000_000, "crores": 10_000_000, "k": 1_000, "thousand": 1_000}

TOPICS = [
    # (topic, pattern of a reply, pattern of a scheme's labels)
    ("agriculture", r"farm|agricultur|crop|kisan|खेती|कृषि|किसान|விவசாய",
     r"agricultur|\bfarm|\bcrop|kisan|irrigation|horticultur|livestock|dairy|fisher|\bseed"),
    ("education", r"educat|scholarship|student|school|college|शिक्षा|छात्र|கல்வி|மாணவ",
     r"educat|scholarship|student|school|college|tuition|fellowship"),
    ("housing", r"housing|\bhouse\b|\bhome\b|आवास|घर|வீடு|வீட்டு",
     r"housing|\bhouse|awas|\bhome\b|shelter|accommodation"),
    ("business", r"business|entrepreneur|startup|self[- ]?employ|msme|व्यापार|कारोबार|தொழில்",
     r"business|entrepreneur|enterprise|startup|start-up|msme|self[- ]?employ|artisan|industr"),
    ("health", r"health|medical|hospital|स्वास्थ्य|சுகாதார|மருத்துவ",
     r"health|medical|hospital|treatment|arogya|ayushman|insurance"),
    ("pension", r"pension|old age|retire|पेंशन|ஓய்வூதிய",
     r"pension|old age|senior citizen|retire|elderly"),
    ("employment", r"employment|\bjobs?\b|रोज़गार|रोजगार|வேலை",
     r"employment|\bjob|skill|unemploy|livelihood|training"),
]
OCCUPATION_TOPICS = [
    ("agriculture", r"farm|agricultur|cultivat|kisan|ryot|खेती|किसान|விவசாய"),
    ("education", r"student|pupil|scholar|छात्र|மாணவ"),
    ("employment", r"unemploy|job[- ]?seek"),
    ("business", r"entrepreneur|business|shop|self[- ]?employ|artisan|weaver|vendor"),
    ("pension", r"retired|pensioner|senior citizen"),
]
NOT_ELIGIBLE_PATTERN = (r"not\s+(?:eligible|qualif)|ineligible|(?:am|are)n'?t\s+eligible|don'?t\s+qualify|"
                        r"do\s+not\s+qualify")
SHOW_PATTERN = r"\b(?:show|list|see|which|what)\b"
TOPIC_CHANGE_PATTERN = r"^\s*(?:(?:actually|instead|rather)\b[\s,.:-]*for\s+\S|change(?: it)? to\s+\S)"
LEADING_FILLER_PATTERN = r"^\s*(?:actually|instead|rather|change(?: it)? to)\b[\s,.:-]*"
TOPICLESS_WORDS = (
    "am i eligible|do i qualify|can i apply|check eligibility|eligible|for|any|a|an|the|my|me|i|am|to|"
    "government|govt|central|state|scheme|schemes|yojana|yojna|benefit|benefits|which|what|is|are|there|"
    "available|can|apply|qualify|get|anything|something|some|please|schemes?|"
    "show|list|see|tell|not|ineligible|dont|don|t|qualified"
)
QUALIFY_PATTERN = (
    r"\b(?:eligib\w*|qualif\w*|apply|applying|entitled|can\s+(?:i|we)\s+get|am\s+i|any\s+help|help\s+me)\b|"
    r"पात्र|योग्य|आवेदन|தகுதி|விண்ணப்ப"
)
THANKS_PATTERN = r"thank|shukriya|dhanyavad|धन्यवाद|शुक्रिया|நன்றி"
RESPONSE_INTENTS = ["scheme_search", "scheme_detail", "eligibility", "document_help", "smalltalk",
                    "clarify", "out_of_scope", "document_upload"]

# --- fixed values: typo repair --------------------------------------------------------------
TYPO_WORDS = [
    "scheme", "schemes", "farmer", "farmers", "student", "students", "scholarship", "scholarships", "pension",
    "subsidy", "benefit", "benefits", "eligible", "eligibility", "document", "documents", "required", "available",
    "apply", "application", "about", "government", "which", "explain", "housing", "education", "health", "women",
    "woman", "widow", "widows", "loan", "details", "process", "tell", "criteria", "disability", "unemployed",
]
TYPO_KEEP = [
    "former", "apple", "tells", "applied", "applies", "applying", "school", "schools", "heath", "wishes", "divorce",
    "issue", "about's", "whole",
]
TYPO_CUTOFF = 0.8

# --- fixed values: eligibility rules --------------------------------------------------------
NEGATION_PATTERN = (r"\bnon-?resident|non-?[a-z]+|\bnot\s+(?:a|an|be|residing|listed|associated|eligible)|"
                    r"other than|outside|excluding")
NO_THRESHOLD_PATTERN = r"\bpriority\b|\bpreference\b|\bnote\b|\badditional\b|\bweightage\b"
INCOME_OVER = r"exceeding|more than|above"
INCOME_UNDER = r"less than|below|not exceeding|(?:shall|should|does|do)\s+not\s+exceed|up to"
REASON_LIMIT = 120
CONDITION_LIMIT = 160
MAX_SCHEMES_SHOWN = 5
BOILERPLATE_PATTERN = r"^(?:note|step|obligation|what|how|whether|can)\b"
LEADING_MARK_PATTERN = r"^[\s\-•*\d.)(:]+"
MISSING_PATTERNS = {
    "age": r"\bage\b|\byears?\b",
    "state": r"resident|domicile|\bstate\b",
    "income_annual": r"income|\bbpl\b|\bapl\b",
    "category": r"\bsc\b|\bst\b|\bobc\b|caste|tribe|category|backward|minorit",
    "gender": r"\bwom[ae]n\b|female|\bmale\b|gender|widow|\bgirl",
}
BENEFIT_LABEL = r"^\s*pattern of assistance\s*:\s*"
SENTENCE_END = r"(?<![Rr]s)(?<!No)(?<!Dr)(?<!Sh)(?<=[.!])\s+(?=[A-Z])"   # case-sensitive

# --- fixed values: document fields ----------------------------------------------------------
CATEGORY_SYNONYMS = [
    ("sc", r"^(?:sc|scheduled\s+castes?)$"),
    ("st", r"^(?:st|scheduled\s+tribes?)$"),
    ("obc", r"^(?:obc|bc|mbc|other\s+backward\s+class(?:es)?|backward\s+class(?:es)?|most\s+backward\s+class(?:es)?)$"),
    ("general", r"^(?:general|gen|oc|open|unreserved|general\s+category)$"),
]
CATEGORY_EVIDENCE = {
    "sc": r"\bsc\b|scheduled\s+castes?",
    "st": r"\bst\b|scheduled\s+tribes?",
    "obc": r"\bobc\b|\bm?bc\b|other\s+backward|backward\s+class",
    "general": r"(?:category|caste|community|class)\s*[:\-]?\s*(?:general|gen|oc|open|unreserved)\b|"
               r"general\s+category|unreserved",
}
GENDER_SYNONYMS = [
    ("female", r"^(?:f|female|woman|women|girl)$"),
    ("male", r"^(?:m|male|man|boy)$"),
    ("other", r"^(?:other|transgender|third\s+gender|non[- ]?binary)$"),
]
GENDER_EVIDENCE = {
    "female": r"\bfemale\b|\bwoman\b|\bd/o\b|\bw/o\b|daughter\s+of|wife\s+of|\bmrs\b|\bmiss\b|\bsmt\b|\bkumari\b|"
              r"(?:sex|gender)\s*[:/\-]?\s*(?:f|female)\b",
    "male": r"(?<![a-z])male\b|\bs/o\b|son\s+of|\bmr\b|\bshri\b|(?:sex|gender)\s*[:/\-]?\s*(?:m|male)\b",
    "other": r"transgender|third\s+gender|\bother\b",
}
HIGH_CONFIDENCE = 0.85
LOW_CONFIDENCE = 0.50

# --- fixed values: answers ------------------------------------------------------------------
SECTION_SHARES = [("description", 500), ("benefits", 400), ("eligibility", 350), ("application", 250), ("faq", 0)]
SCHEME_CHAR_CAP = 2500
MAX_PROMPT_TOKENS = 5500
CHARS_PER_TOKEN = 3
DECLINE_MARKS = ["i can only help with government scheme", "i can't process that message", "myscheme.gov.in"]
CACHE_TTL_SECONDS = 24 * 3600
CACHE_ENTRIES = 500
CACHE_STRIP = " ?!.,;:।"
SESSION_GAP_SECONDS = 30 * 60
ABBREVIATIONS = r"(?:(?:Rs|No|Nos|Dr|Sr|Jr|Mr|Mrs|Ms|vs|etc|approx|Govt|Dept)|[A-Z]|\d|e\.g|i\.e)\.$"
MAX_SENTENCE_CHUNK = 400
TYPED_CONFIDENCE = 0.9
TYPED_MIN_WORDS = 3
LANGUAGES = ["en", "hi", "ta"]

# --- fixed values: segments around names ------------------------------------------------------
SEGMENT_MARK = "**"
SEGMENT_LETTER = r"[^\W\d_]"
SEGMENT_LEAD = r"[\s\-–—]*(?:\d+\.\s+)?[\s\-–—]*"
SEGMENT_TRAIL = r"(?:\s+\d+\.)?\s*$"

# --- fixed values: loads -----------------------------------------------------------------------
CORRUPT_NAME_MARKERS = ["are you sure you want to sign out"]
