"""Text-security analytics on Spark: find, clean, redact and report hidden or spoofed content in corpora."""

__version__ = "0.2.0"

from .functions import register
from .functions.spans import Lexicon
from .local import Finding, Report, Result, ScanResult, UFinding, sanitize_text, scan_text
from .operators import PROFILES, Policy, clean, get_policy, render_scan, rewrite, sanitize, sarif, scan
from .tables import ScanOptions, UnicodeScanOptions

__all__ = [
    "PROFILES", "Finding", "Lexicon", "Policy", "Report", "Result", "ScanOptions", "ScanResult", "UFinding", "UnicodeScanOptions", "__version__",
    "clean", "get_policy", "register", "render_scan", "rewrite", "sanitize", "sanitize_text", "sarif", "scan", "scan_text",
]
