from .spans import apply_spans, detect, resolve
from .sql import register
from .unicode import (
    bidi_name,
    clean_unicode,
    confusable_with_ascii,
    contains_bidi,
    find_bidi,
    is_bidi_control,
    is_confusable,
    is_dangerous,
    skeleton,
    strip_bidi,
    target,
    unbalanced_bidi,
    unicode_findings,
)

__all__ = [
    "apply_spans", "bidi_name", "clean_unicode", "confusable_with_ascii", "contains_bidi", "detect", "find_bidi", "is_bidi_control",
    "is_confusable", "is_dangerous", "register", "resolve", "skeleton", "strip_bidi", "target", "unbalanced_bidi", "unicode_findings",
]
