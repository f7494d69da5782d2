"""Names for links, from their host or from what is written beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts in the order in which they are tried, first match wins.
HOSTS = (
    ("GitHub", r"\bgithub\.(com|io)\b"),
    ("GitLab", r"\bgitlab\.com\b"),
    ("LinkedIn", r"\blinkedin\.com\b|\blnkd\.in\b"),
    ("Stack Overflow", r"\bstackoverflow\.com\b"),
    ("Google Play", r"\bplay\.google\.com\b"),
    ("App Store", r"\bapps\.apple\.com\b"),
    ("Kaggle", r"\bkaggle\.com\b"),
    ("Hugging Face", r"\bhuggingface\.co\b"),
    ("Behance", r"\bbehance\.net\b"),
    ("Dribbble", r"\bdribbble\.com\b"),
    ("Medium", r"\bmedium\.com\b"),
    ("Substack", r"\bsubstack\.com\b"),
    ("X", r"\b(twitter\.com|x\.com)\b"),
    ("YouTube", r"\byoutube\.com\b|\byoutu\.be\b"),
    ("ORCID", r"\borcid\.org\b"),
    ("Google Scholar", r"\bscholar\.google\."),
    ("arXiv", r"\barxiv\.org\b"),
)
# Labels that people write, and their canonical form.
WRITTEN = {
    "github": "GitHub", "gitlab": "GitLab", "linkedin": "LinkedIn", "portfolio": "Portfolio", "website": "Website",
    "blog": "Blog", "twitter": "X", "behance": "Behance", "dribbble": "Dribbble", "medium": "Medium",
    "youtube": "YouTube", "orcid": "ORCID", "scholar": "Google Scholar", "kaggle": "Kaggle",
}
# Hosts that shorten links, and what makes a text a link at all.
SHORT = r"\b(bit\.ly|shorturl\.at|tinyurl\.com|t\.co|rb\.gy|lnkd\.in)\b"
URL = r"https?://|\bwww\."


def link_label(text: Column, context: Column) -> Column:
    """`context`: the cited line, which names the service where the URL hides it."""
    def has(pattern: str) -> Column:
        return F.regexp_like(text, F.lit(f"(?iU){pattern}"))

    label = None
    for name, pattern in HOSTS:
        label = F.when(has(pattern), name) if label is None else label.when(has(pattern), name)
    find = r"(?iU)\b(" + "|".join(WRITTEN) + r")\b"
    own, beside = F.lower(F.regexp_extract(text, find, 1)), F.lower(F.regexp_extract(F.coalesce(context, F.lit("")), find, 1))
    names = F.create_map(*(F.lit(x) for pair in WRITTEN.items() for x in pair))
    return label.when(own != "", names[own]).when(beside != "", names[beside]).when(has(SHORT), "Link").when(has(URL), "Website").otherwise("Link")
