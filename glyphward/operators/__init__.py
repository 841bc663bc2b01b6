from .corpus import clean_corpus, findings_by, quarantine, ranked_by_findings, spoof_members, spoof_pairs, spoofs, top_findings, union_findings
from .rewrite import Calls, rewrite
from .sanitize import PROFILES, Policy, get_policy, sanitize
from .scan import clean, findings, render_scan, sarif, sarif_results, scan, to_json
from .verdict import StreamVerdicts, Verdict, observed, observed_stream, verdict, write_scanned

__all__ = ["Calls", "PROFILES", "Policy", "Verdict", "clean", "clean_corpus", "findings", "findings_by", "get_policy", "quarantine", "ranked_by_findings", "render_scan", "rewrite", "sanitize", "sarif", "sarif_results", "scan", "spoof_members", "spoof_pairs", "spoofs", "to_json", "top_findings", "union_findings", "StreamVerdicts", "observed", "observed_stream", "verdict", "write_scanned"]
