"""Fixed values that must equal the reference for identical results.

Regular expressions are written in a portable dialect that Java (Spark),
RE2 (DuckDB) and Python agree on: Python's Unicode ``\\s``/``\\w`` are spelled
out as explicit classes, because Java and RE2 default them to ASCII.
"""

# ---------------------------------------------------------------------------
# fixed values: security keyword lexicon (43 entries, reference order)
# ---------------------------------------------------------------------------
CYBER_KEYWORDS = [
    "malware", "ransomware", "phishing", "cve", "exploit", "vulnerability",
    "hacker", "breach", "payload", "botnet", "ioc", "zero-day", "trojan",
    "virus", "worm", "ddos", "cyberattack", "cyber security", "firewall",
    "encryption", "backdoor", "rootkit", "spyware", "adware", "keylogger",
    "mitm", "sql injection", "xss", "csrf", "buffer overflow", "patch",
    "update", "threat", "alert", "incident", "forensic", "pentest",
    "red team", "blue team", "soc", "siem", "ids", "ips",
]

# fixed values: IOC patterns (type name -> regex), applied to cleaned text
IOC_TYPES = ["ips", "domains", "hashes", "cves"]
IOC_PATTERNS = {
    "ips": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "domains": r"\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|io|ru|cn|info|biz|co|xyz|gov|edu)\b",
    "hashes": r"\b[a-fA-F0-9]{32,64}\b",
    "cves": r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b",
}

# fixed values: entity label whitelist for named entities
ENTITY_LABELS = ["ORG", "PRODUCT", "PERSON", "GPE", "NORP", "LOC"]

# fixed values: text-column resolution for CSV sources
TEXT_COLUMN_CANDIDATES = [
    "text", "description", "summary", "details",
    "attack_description", "event_description", "content",
]
STRUCTURED_COLUMN_HINTS = ["desc", "detail", "narrat", "report", "content", "text"]

# fixed values: graph node prefixes, node types and edge relations
NODE_PREFIX = {"entity": "ENT::", "ips": "IP::", "domains": "DOM::",
               "cves": "CVE::", "technique": "MITRE::"}
NODE_TYPE = {"entity": "entity", "ips": "ip", "domains": "domain",
             "cves": "cve", "technique": "mitre_technique"}
EDGE_RELATION = {"ips": "mentions_ip", "domains": "mentions_domain",
                 "cves": "mentions_cve", "technique": "uses_technique",
                 "co_occurs": "co_occurs"}

# ---------------------------------------------------------------------------
# Portable character classes.
#   NOT_SPACE  == Python str-pattern \S  (isspace(): \t\n\v\f\r, \x1c-\x1f, \x85, Unicode Z*)
#   WORD_CHAR  == Python str-pattern \w  (letters, numbers, underscore)
# ---------------------------------------------------------------------------
NOT_SPACE = r"[^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
WORD_CHAR = r"[\p{L}\p{N}_]"

URL_PATTERN = rf"http{NOT_SPACE}+|www{NOT_SPACE}+"
MENTION_PATTERN = rf"@{WORD_CHAR}+"
HASHTAG_PATTERN = rf"#({WORD_CHAR}+)"
# Characters outside the kept set (ASCII alphanumerics, . - / _ ') become a
# space; Unicode whitespace is outside the set too, so runs collapse to one.
SCRUB_PATTERN = r"[^A-Za-z0-9.\-/_']+"
# The same code-point set spelled as positive ranges (complement of
# A-Z a-z 0-9 . - / _ '). Java evaluates this form about 5x faster than the
# negated class; the DuckDB oracle keeps SCRUB_PATTERN, so every oracle
# check also proves the two are equal.
SCRUB_PATTERN_RANGES = r"[\x00-\x26\x28-\x2C\x3A-\x40\x5B-\x5E\x60\x7B-\x{10FFFF}]+"

# ---------------------------------------------------------------------------
# Forms of the same patterns for Java, which they make fail on its first character class almost everywhere.
# ---------------------------------------------------------------------------
URL_PATTERN_JAVA = rf"[hw](?:(?<=h)ttp|(?<=w)ww){NOT_SPACE}+"
# Code points below 256 one by one, which Java keeps as a bit set.
_SCRUB_CLASS = "[" + "".join(f"\\x{i:02x}" for i in range(256) if not (chr(i) in ".-/_'" or chr(i).isascii() and chr(i).isalnum())) \
               + r"\x{100}-\x{10FFFF}]"
# Every run of SCRUB_PATTERN but a single blank, which its replacement would leave as it is.
SCRUB_RUNS_JAVA = rf"{_SCRUB_CLASS}(?:{_SCRUB_CLASS}+|(?<! ))"
DOMAIN_END = r"\.(?:com|net|org|io|ru|cn|info|biz|co|xyz|gov|edu)\b"   # of every match of ``domains``
IOC_PATTERNS_JAVA = {**IOC_PATTERNS, "ips": r"(?=[0-9])" + IOC_PATTERNS["ips"], "cves": r"(?=[cC][vV][eE]-)" + IOC_PATTERNS["cves"]}


def keyword_alternation(keywords) -> str:
    """``(?i)\\b(?:k1|k2|...)\\b`` compiled as a prefix trie.

    Keywords sharing a first character share one branch, so the matcher
    tries about one branch per word start instead of every keyword. Within
    a branch longer completions come first, which keeps the longest-first
    preference of a flat alternation sorted by length. A first character that
    starts no keyword is passed over before the boundary is looked at.
    """
    words = sorted({k.lower() for k in keywords if k})
    first = "".join(sorted({w[0] for w in words}))
    ahead = f"(?=[{first}])" if first and first.isascii() and first.isalnum() else ""
    return rf"(?i){ahead}\b(?:" + _trie_regex(words) + r")\b"


def _trie_regex(words) -> str:
    if not words:
        return ""
    ends = "" in words
    groups: dict[str, list[str]] = {}
    for w in words:
        if w:
            groups.setdefault(w[0], []).append(w[1:])
    alts = []
    for ch in sorted(groups, key=lambda c: (-max(len(x) for x in groups[c]), c)):
        rest = groups[ch]
        sub = _trie_regex(rest)
        if rest == [""]:
            alts.append(regex_quote(ch))
        elif len(rest) == 1:
            alts.append(regex_quote(ch) + regex_quote(rest[0]))
        else:
            alts.append(regex_quote(ch) + "(?:" + sub + ")")
    if ends:
        alts.append("")
    return "|".join(alts)


def regex_quote(s: str) -> str:
    """Escape regex metacharacters only (valid in Java, RE2 and Python)."""
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)
