"""Fixed values.

Everything in this module is a value that results depend on: patterns, word
lists, lookup tables and score constants. No logic lives here.
"""

# --- Indicator types: name -> (pattern, base confidence) --------------------
# Fixed values. The order is the rank used to break ties between types.
INDICATOR_PATTERNS = {
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){1,7}[A-Fa-f0-9]{1,4}\b",
    "domain": r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b",
    "url": r"(?:https?|ftp)://[^\s\"'<>]+[^\s\"'<>.,;:!?\)]",
    "md5": r"\b[a-fA-F\d]{32}\b",
    "sha1": r"\b[a-fA-F\d]{40}\b",
    "sha256": r"\b[a-fA-F\d]{64}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "cve": r"\b(?i:CVE)-\d{4}-\d{4,}(?!\d)",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b",
    "asn": r"(?i)\bAS(?:N\s*|\s+)?\d{4,6}\b",
    "cidr": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}/\d{1,2}\b",
    "registry_key": r"(?i)(?:HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKEY_USERS"
    r"|HKEY_CURRENT_CONFIG|HKLM|HKCU|HKCR|HKU|HKCC)[\\\:][a-zA-Z0-9_\\\- ]+",
    "mutex": r"(?i)(?:Global|Local|BaseNamedObjects)\\[a-zA-Z0-9_\-\.\{\}]+",
    "crypto_btc": r"\b(?:1|3|bc1)[a-zA-HJ-NP-Z0-9]{25,39}\b",
    "crypto_eth": r"\b0x[a-fA-F0-9]{40}\b",
    "crypto_xmr": r"\b4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}\b",
    "tor_v3": r"\b[a-z2-7]{56}\.onion\b",
    "ja3": r"(?i)JA3(?:[:\s]+)?([a-fA-F0-9]{32})\b",
    "ja3s": r"(?i)JA3S(?:[:\s]+)?([a-fA-F0-9]{32})\b",
    "jarm": r"\b[a-fA-F0-9]{62}\b",
    "imphash": r"(?i)imphash(?:[:\s]+)?([a-fA-F0-9]{32})\b",
    "rich_header": r"(?i)rich(?:_|\s+)?header(?:[:\s]+)?([a-fA-F0-9]{32})\b",
    "aws_iam": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "phone_number": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
}
INDICATOR_TYPES = list(INDICATOR_PATTERNS)
TYPE_RANK = {name: rank for rank, name in enumerate(INDICATOR_TYPES, start=1)}

# Base confidence per type.
BASE_CONFIDENCE = {
    "ip": 0.60, "ipv6": 0.60, "domain": 0.55, "url": 0.70, "md5": 0.75, "sha1": 0.80,
    "sha256": 0.85, "email": 0.50, "cve": 0.90, "mac_address": 0.60, "asn": 0.70, "cidr": 0.70,
    "registry_key": 0.75, "mutex": 0.80, "crypto_btc": 0.85, "crypto_eth": 0.85,
    "crypto_xmr": 0.85, "tor_v3": 0.95, "ja3": 0.80, "ja3s": 0.80, "jarm": 0.85,
    "imphash": 0.80, "rich_header": 0.80, "aws_iam": 0.95, "phone_number": 0.40,
}

# Domains never reported as indicators.
BLOCKED_DOMAINS = [
    "example.com", "localhost.localdomain", "test.com", "schema.org",
    "gmail.com", "yahoo.com", "hotmail.com", "qq.com",
    "google.com", "microsoft.com", "github.com", "apple.com",
    "outlook.com", "live.com", "icloud.com", "protonmail.com",
    "linkedin.com", "twitter.com", "facebook.com", "instagram.com", "t.me",
    "amazon.com", "cloudflare.com", "mozilla.org", "w3.org", "mitre.org",
    "github.io", "virustotal.com", "raw.githubusercontent.com",
]
# Well-known vendor domains, kept but scored lower.
VENDOR_DOMAINS = [
    "cisa.gov", "siemens.com", "honeywell.com", "deltaww.com",
    "gevernova.com", "sw.siemens.com", "unit42.paloaltonetworks.com",
    "mandiant.com", "crowdstrike.com", "proofpoint.com", "dfirreport.com",
    "thedfirreport.com", "paloaltonetworks.com", "fortinet.com", "kaspersky.com",
    "googleblog.com",
]
# File extensions that look like top-level domains.
FILE_EXTENSIONS = [
    "exe", "dll", "bin", "dat", "tmp", "zip", "rar", "7z", "tar", "gz", "bz2",
    "js", "php", "html", "htm", "css", "asp", "aspx", "jsp",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "csv", "txt", "rtf",
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico",
    "mp3", "mp4", "avi", "mov", "wav",
    "py", "rb", "java", "cpp", "go", "rs",
    "json", "xml", "yaml", "yml", "cfg", "log",
    "iso", "img", "dmg", "sh", "bat", "cmd", "ps1", "vbs",
]
# Hosts that serve user content, so never blocked in URLs.
CODE_HOSTS = [
    "github.com", "raw.githubusercontent.com", "pastebin.com", "gitlab.com",
    "bitbucket.org", "ngrok.io", "ngrok-free.app",
]
# Fixed values.
RISKY_TLDS = [".ru", ".cn", ".top", ".xyz", ".tk", ".pw", ".cc", ".ws"]
THREAT_WORDS = [
    "malware", "malicious", "threat", "attack", "exploit", "vulnerability",
    "ransomware", "phishing", "trojan", "backdoor", "botnet", "c2", "c&c",
    "compromise", "infected", "suspicious", "ioc", "indicator", "apt",
    "campaign", "actor", "payload", "dropper", "loader", "rat",
]
RESOLVER_IPS = ["1.1.1.1", "8.8.8.8", "8.8.4.4"]
LATERAL_WORDS = ["lateral", "internal", "pivot"]
PAYLOAD_MARKS = ["/wp-admin", "/phishing", "/payload", ".exe", ".zip", ".rar"]

# IPv4 ranges that are not public. The documentation ranges
# (192.0.2/24, 198.51.100/24, 203.0.113/24) are absent: they count as public.
NON_PUBLIC_IPV4 = (
    r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^198\.1[89]\."
    r"|^192\.0\.0\.(?!(?:9|10)$)|^(?:24[0-9]|25[0-5])\."
)

# --- Severity ---------------------------------------------------------------
# Severity the ingest job assigns (types not listed: Unknown).
INGEST_SEVERITY = {
    "ip": "Medium", "ipv6": "Medium", "domain": "Medium", "url": "High", "md5": "High",
    "sha1": "High", "sha256": "High", "email": "Low", "cve": "Critical",
}
# Default severity of every known type.
DEFAULT_SEVERITY = {
    "ip": "Medium", "ipv6": "Medium", "domain": "Medium", "url": "High", "md5": "High",
    "sha1": "High", "sha256": "High", "email": "Low", "cve": "Critical",
    "mac_address": "Medium", "asn": "Medium", "cidr": "High", "registry_key": "High",
    "mutex": "High", "crypto_btc": "High", "crypto_eth": "High", "crypto_xmr": "High",
    "tor_v3": "High", "ja3": "High", "ja3s": "High", "jarm": "High", "imphash": "High",
    "rich_header": "High", "cert_sha1": "High", "aws_iam": "Critical", "yara_rule": "Medium",
    "phone_number": "Medium", "email_header": "Low", "behavior": "Medium",
}
SEVERITY_PRIORITY = {"Unknown": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
VERIFIABLE_TYPES = ["cve", "url", "ip"]

# --- Text masking -----------------------------------------------------------
# Cyrillic letters that look Latin, and their Latin twins.
LOOKALIKE_FROM = "асеорхуіј"
LOOKALIKE_TO = "aceopxyij"
# Dots from other scripts.
UNICODE_DOTS = "․﹒·∙｡。"
ZERO_WIDTH = r"[\x{200b}\x{200c}\x{200d}\x{200e}\x{200f}\x{feff}\x00]"

# --- Attack stages and prediction -------------------------------------------
# Attack stages in order.
STAGES = [
    "Reconnaissance", "Resource Development", "Initial Access", "Execution", "Persistence",
    "Privilege Escalation", "Defense Evasion", "Credential Access", "Discovery",
    "Lateral Movement", "Collection", "Command and Control", "Exfiltration", "Impact",
]
# Words that hint at a stage, in tie-break order.
STAGE_WORDS = {
    "Reconnaissance": ["domain", "url", "whois"],
    "Initial Access": ["email", "cve", "phishing"],
    "Execution": ["hash", "sha256", "sha1", "md5", "exe", "file_path"],
    "Command and Control": ["ip", "ipv4", "ipv6", "c2"],
    "Collection": ["file_path", "registry"],
    "Exfiltration": ["dns", "tunnel"],
}
# Retrieval phrase per indicator type.
TYPE_PHRASES = {
    "ip": "network connection command-and-control",
    "domain": "DNS resolution domain generation phishing",
    "url": "web exploitation payload delivery",
    "md5": "malware file hash persistence",
    "sha1": "malware file hash persistence",
    "sha256": "malware file hash persistence",
    "cve": "vulnerability exploitation initial access",
    "email": "phishing social engineering",
}
SEVERE_PHRASE = "advanced persistent threat lateral movement exfiltration"
DEFAULT_PHRASE = "threat campaign indicators of compromise"
FALLBACK_RECOMMENDATIONS = [
    "Monitor network traffic for anomalous patterns",
    "Review endpoint detection logs",
    "Update threat intelligence feeds",
]
