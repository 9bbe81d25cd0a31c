"""Fixed vocabularies and patterns. Every operator accepts a replacement."""

from __future__ import annotations

from dataclasses import dataclass

# Technology keywords by tier.
PRIMARY_TERMS = (
    "patent", "intellectual property", "trademark", "copyright", "software", "computer", "internet",
    "technology", "artificial intelligence", "machine learning", "cybersecurity", "data breach", "hacking",
    "security vulnerability", "ecommerce", "electronic commerce", "digital payment", "blockchain",
    "cryptocurrency", "virtual reality", "autonomous", "data privacy", "personal information",
    "data protection",
)
SECONDARY_TERMS = (
    "algorithm", "database", "network", "encryption", "source code", "application", "digital", "electronic",
    "server", "cloud", "startup", "tech company", "silicon valley", "semiconductor", "user data",
    "online platform", "website", "mobile app", "digital service", "tech industry", "software company",
    "dmca", "cfaa", "data regulation", "tech standard", "data center", "cloud computing", "broadband",
    "wireless",
)
CONTEXT_TERMS = (
    "algorithm", "digital", "electronic", "internet", "computer", "software", "hardware", "network", "cyber",
    "data", "tech", "system", "device", "platform", "online", "virtual",
)


@dataclass(frozen=True)
class TechLexicon:
    """Three tiers of terms with the weight of each tier in the relevance score."""

    primary: tuple[str, ...] = PRIMARY_TERMS
    secondary: tuple[str, ...] = SECONDARY_TERMS
    context: tuple[str, ...] = CONTEXT_TERMS
    weights: tuple[float, float, float] = (5.0, 3.0, 1.0)

    @property
    def denominator(self) -> float:
        return 3.0 * len(self.primary)


TECH = TechLexicon()

# Legal issue patterns.
ISSUE_PATTERNS = {
    "infringement": (
        r"\b(infring|infringement|infringing|infringes)\b",
        r"\b(direct infringement|indirect infringement)\b",
        r"\b(literal infringement|doctrine of equivalents)\b",
        r"\b(induced|contributory)\s+infringement\b",
    ),
    "validity": (
        r"\b(valid|invalid|validity|invalidate|unenforceable)\b",
        r"\b(enforce|enforceability)\b",
        r"\b(patent eligible|patent ineligible)\b",
    ),
    "patentability": (
        r"\b(101|subject matter|abstract idea)\b",
        r"\b(natural phenomenon|laws of nature)\b",
        r"\b(alice test|mayo test)\b",
        r"\b(machine-or-transformation)\b",
    ),
}
PERIOD_ISSUE_PATTERNS = {
    ("2010_2020", "post_2020"): ("patentability", r"\b(alice step one|alice step two)\b"),
    ("pre_2000",): ("patentability", r"\b(useful|machine-or-transformation)\b"),
}

# Filing periods as (name, first day, day after the last).
PERIODS = (
    ("pre_2000", None, "2000-01-01"),
    ("2000_2010", "2000-01-01", "2010-01-01"),
    ("2010_2020", "2010-01-01", "2020-01-01"),
    ("post_2020", "2020-01-01", None),
)
DEFAULT_PERIOD = "2010_2020"
PERIOD_RANK = {"pre_2000": 1, "2000_2010": 2, "2010_2020": 3, "post_2020": 4}
PERIOD_START_YEAR = {"post_2020": 2020, "2010_2020": 2010, "2000_2010": 2000, "pre_2000": 1990}
TRAINING_PERIOD_WEIGHT = {"post_2020": 2.0, "2010_2020": 1.5, "2000_2010": 1.0, "pre_2000": 0.5}
PERIOD_TERMS = {
    "post_2020": ("subject matter eligibility", "alice test", "mayo framework"),
    "2010_2020": ("abstract idea", "significantly more", "routine and conventional"),
    "2000_2010": ("machine-or-transformation", "business method patents"),
    "pre_2000": ("useful arts", "concrete steps"),
}

# Wording that signals reliance on precedent, and formal legal phrases.
PRECEDENT_PATTERNS = (
    r"controlling precedent", r"binding authority", r"stare decisis", r"overrul(ed|ing)", r"followed by",
    r"citing", r"see also", r"cf\.", r"but see", r"accord", r"relying on",
)
LEGAL_PHRASES = (
    "whereas", "hereby", "pursuant to", "notwithstanding", "hereinafter", "aforementioned", "subject matter",
)

# Argument, reasoning and key-point patterns.
INSIGHT_PATTERNS = {
    "winning_arguments": (
        r"court\s+(?:finds|concludes|holds|determines)\s+(?:that\s+)?([^.]{10,200})",
        r"(?:motion|petition)\s+(?:is|was)\s+granted\s+(?:because|as|since)\s+([^.]{10,200})",
        r"successfully\s+(?:demonstrated|proved|established)\s+(?:that\s+)?([^.]{10,200})",
        r"evidence\s+(?:shows|demonstrates|establishes)\s+(?:that\s+)?([^.]{10,200})",
        r"plaintiff\s+(?:prevails|succeeded)\s+(?:on|in)\s+([^.]{10,200})",
    ),
    "key_reasoning": (
        r"(?:because|since|as)\s+([^.]{10,200})",
        r"(?:therefore|thus|accordingly)\s*,\s*([^.]{10,200})",
        r"(?:based\s+on|in\s+light\s+of)\s+([^.]{10,200})",
    ),
}
KEY_POINT_PATTERNS = {
    "holding": r"court\s+(?:holds|concludes|finds)\s+that\s+([^.]+)",
    "evidence": r"(?:evidence|record)\s+(?:shows|demonstrates|proves)\s+that\s+([^.]+)",
    "reasoning": r"(?:because|since|as)\s+([^.]+)",
}
FINDING_PATTERNS = (
    r"court\s+(?:holds|concludes|finds)\s+that\s+([^.]+)",
    r"(?:granting|denying)\s+(?:motion|petition)\s+(?:because|as|since)\s+([^.]+)",
    r"(?:evidence|record)\s+(?:shows|demonstrates|establishes)\s+that\s+([^.]+)",
)

# Citation formats, and the entry formats inside a reference list.
CITATION_PATTERNS = (
    r"(?:[A-Z][a-z]+\s+)+v\.?\s+(?:[A-Z][a-z]+\s+)+\d+\s+F\.(?:2d|3d|4th)?\s+\d+",
    r"\d+\s+U\.S\.\s+\d+",
    r"U\.S\.\s+Patent\s+No\.\s+[\d,]+",
    r"Fed\.\s+Cir\.\s+\d{4}",
    r"Patent\s+Application\s+No\.\s+[\d/,]+",
    r"Publication\s+No\.\s+[\d\-,]+",
    r"(?:19|20)\d{2}\s+WL\s+\d+",
)
REFERENCE_SECTION = r"(?is)References Cited[^\n]*\n(.*?)(?:\n\n|\z)"
REFERENCE_ENTRY_PATTERNS = (
    (r"(?s)\[\d+\]\s*(.*?)(?=\[\d+\]|\z)", 1),
    (r"(?s)\d+\.\s*(.*?)(?=\d+\.\s*|\z)", 1),
    (r"(?s)(?:^|\n)\s*[A-Z].*?(?=\n\s*[A-Z]|\z)", 0),
)

# Courts.
CIRCUIT_COURTS = (
    "ca1", "ca2", "ca3", "ca4", "ca5", "ca6", "ca7", "ca8", "ca9", "ca10", "ca11", "cadc", "cafc",
)
COURT_LEVELS = {**{court: 2 for court in CIRCUIT_COURTS}, "scotus": 3, "dcd": 1, "nysd": 1, "cand": 1, "txed": 1}
COURT_GROUPS = (("cafc",), ("cand", "nysd", "txed"), ("dcd", "ded"), ("ca9", "ca2", "ca5"))
TECH_CENTERS = (2100, 2400, 2600, 2800)

# Search groups; a case matches a group when any phrase occurs.
SEARCH_GROUPS = (
    ("patent", "intellectual property", "trademark", "copyright"),
    ("software", "source code", "computer program"),
    ("cybersecurity", "data breach", "encryption", "data privacy"),
    ("internet", "website", "e-commerce", "online service"),
    ("technology", "tech company", "startup", "digital"),
    ("blockchain", "cryptocurrency", "smart contract"),
    ("artificial intelligence", "machine learning", "algorithm"),
)

# Vocabulary for reading patent questions.
QUERY_TYPES = (
    ("patentability", ("patentable", "patent", "protect")),
    ("validity", ("valid", "invalid", "challenge")),
    ("infringement", ("infringe", "copying", "similar")),
    ("general", ("analyze", "review", "check")),
)
SECTION_PATTERNS = (
    ("103", ("obvious", "obviousness", "combine", "modification")),
    ("102", ("novelty", "anticipated", "prior art", "identical")),
    ("112", ("indefinite", "written description", "enablement", "clarity")),
)
TECH_CENTER_BY_FIELD = (
    ("computer", "2100"), ("software", "2100"), ("ai", "2100"), ("network", "2100"), ("electronic", "2800"),
    ("hardware", "2800"), ("biotech", "1600"), ("chemical", "1700"), ("mechanical", "3700"),
)
FIELD_INDICATORS = ("technology", "field", "industry", "domain", "area")
CLAIM_INDICATORS = ("claim", "invention", "system", "method", "device")
PATENT_NUMBER = r"US\d{7,8}|US\d{4}/\d+|\d{7,8}"

# Labels.
QUINTILE_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")
NOT_AVAILABLE = "Not Available"

# What an absent field of a case becomes; None stays null.
CASE_DEFAULTS: dict[str, object] = {
    "id": "", "case_name": "", "date_filed": None, "court": "", "court_id": "", "docket_number": "", "judge": "",
    "precedential_status": "", "citation_count": 0, "docket_id": None, "cluster_id": None, "text_excerpt": "",
    "tech_relevance_score": 0.0, "tech_keywords_found": [], "suit_nature": "", "procedural_history": "", "full_text": "",
    "opinion_url": "", "opinion_sha1": "", "opinion_type": "", "opinion_cites": [], "citing_cases": [], "cited_by": [],
}

# The events in a docket's dates, as (event, column), and their descriptions.
DOCKET_EVENTS = (
    ("filed", "date_filed"), ("terminated", "date_terminated"), ("last_filing", "date_last_filing"),
    ("argued", "date_argued"), ("reargued", "date_reargued"),
)
EVENT_DESCRIPTION = "Case {}"

# Fixed value: a docket stamp inside an opinion's text.
DOCKET_STAMP = r"Case:\s*\d+-\d+\s*Document:\s*\d+.*?Filed:"

# Marks of a cited statute section.
REJECTION_REFERENCE = r"(?:section|§|\bc\.?\s*)(101|102|103|112)\b"
REJECTION_REFERENCE_SPACED = r"(?:section\s*|§\s*|\bc\.?\s*)(101|102|103|112)\b"

# Advice about the claims of an office action.
CLAIM_ADVICE = {
    "risk": "High risk of rejection. Consider reviewing prior art thoroughly.",
    "103": "Potential obviousness issues detected. Consider strengthening non-obviousness arguments.",
    "102": "Potential novelty issues detected. Review cited prior art carefully.",
    "claims": "Multiple claim citations detected. Consider narrowing claim scope.",
    "support": "No paragraph citations found. Consider adding more detailed support from specification.",
}

# Advice about a passage.
PASSAGE_ADVICE = {
    "risk": "High risk of rejection - detailed review recommended",
    "moderate": "Moderate risk - consider strengthening claim language",
    "support": "Add more detailed support from specification",
    "claims": "High number of claim citations - consider narrowing scope",
}

# Advice about a question, and what its context adds.
QUESTION_ADVICE = {
    "risk": "High risk of rejection - detailed review recommended",
    "103": "Potential obviousness issues - consider strengthening non-obviousness arguments",
    "102": "Potential novelty issues - review prior art carefully",
    "moderate": "Moderate risk - consider strengthening claim language",
    "search": "Consider conducting a thorough prior art search.",
    "field": "Review recent patents in {} for potential prior art.",
}

# Summaries by probability, and notes on statute sections.
SUMMARIES = {
    "high": "Based on the analysis, this invention may face significant patentability challenges.",
    "middle": "The invention shows promise but may need refinement to improve patentability.",
    "low": "Initial analysis suggests favorable patentability prospects.",
    "other": "Analysis complete. See detailed results below.",
}
TECHNICAL_NOTES = {
    "103": "Potential obviousness concerns identified.",
    "102": "Novelty issues may need to be addressed.",
    "112": "Clarity or written description issues detected.",
    "none": "No significant technical issues identified.",
}
