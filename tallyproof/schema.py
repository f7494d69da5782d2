"""Closed value sets and table schemas."""

from __future__ import annotations

LINES = "doc_id bigint, no int, text string, page int, column int, zone string, is_bullet boolean, script string, unjoined array<string>"
CLAIMS = "doc_id bigint, claim_id bigint, path string, kind string, text string, source_lines array<int>"
BARE_FIELDS = "doc_id bigint, object_path string, field string, value string, source_lines array<int>"
BLOCKS = "doc_id bigint, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"
ROLES = "doc_id bigint, role_id bigint, parent_role_id bigint, ord int, company string, title string"

# Error codes of rejected files.
ERROR_CODES = ("extraction_failed", "unsupported_format", "password_protected", "corrupt_file", "file_too_large", "empty_document", "scanned_no_text_layer", "garbled_text")
# Categories of skills.
SKILL_CATEGORIES = (
    "language", "framework", "library", "database", "cloud_platform", "devops_tool", "data_ml",
    "design_tool", "methodology", "domain_knowledge", "soft_skill", "certification_skill", "other",
)
# Plain fields that a claim may carry beside its spans.
CHECKED_FIELDS = ("company", "title", "institution", "degree", "name")

DECLINE = "Prefer not to say"
# Survey questions with their choices, and whether several may be given.
QUESTIONS: tuple[tuple[str, tuple[str, ...], bool], ...] = (
    ("work_authorization_us", ("Yes", "No"), False),
    ("disability", ("Yes", "No"), False),
    ("gender", ("Male", "Female", "Non-binary"), False),
    ("visa_sponsorship", ("Yes", "No"), False),
    ("lgbtq", ("Yes", "No"), False),
    ("veteran", ("Yes", "No"), False),
    ("race", ("American Indian or Alaska Native", "Asian", "Black or African American", "Native Hawaiian or Other Pacific Islander", "White", "Two or More Races"), False),
    ("hispanic_latino", ("Yes", "No"), False),
    ("sexual_orientation", ("Heterosexual", "Gay", "Lesbian", "Bisexual", "Asexual", "Queer"), True),
    ("pronouns", ("He/Him", "She/Her", "They/Them"), False),
)
