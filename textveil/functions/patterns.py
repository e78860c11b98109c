"""The detection patterns.

Fixed values: types in catalogue order, patterns, confidences and rule names must equal those of the
service whose results this engine matches. ``(?U)`` gives Java the Unicode classes of str patterns.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    type: str
    pattern: str
    base: float
    rule: str
    #: A character class that every match holds one of; texts without skip the pattern.
    needs: str


DETECTORS = (
    Detector("EMAIL", r"(?iU)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0.98, "email_regex", "@"),
    Detector("PHONE", r"(?U)(?:\+?\d{1,3}[\s\-\.])?(?:\(?\d{2,4}\)?[\s\-\.])?\d{3,4}[\s\-\.]?\d{3,4}(?!\d)", 0.85, "phone_regex", r"(?U)\d"),
    Detector("CREDIT_CARD", r"(?U)(?:\d[ -]*?){13,19}", 0.75, "creditcard_generic", r"(?U)\d"),
    Detector("IP_ADDRESS", r"(?U)(?:\b25[0-5]|\b2[0-4]\d|\b1?\d{1,2})(?:\.(?:25[0-5]|2[0-4]\d|1?\d{1,2})){3}", 0.95, "ipv4_regex", r"(?U)\d"),
    Detector("SSN", r"(?U)\b\d{3}-?\d{2}-?\d{4}\b", 0.9, "ssn_regex", r"(?U)\d"),
    Detector("NAME", r"(?U)\b[A-Z][a-z]{1,}\s+[A-Z][a-z]{1,}(?:\s+[A-Z][a-z]{1,})?\b", 0.45, "name_heuristic", "[A-Z]"),
)
#: A pseudonym in a text, in any case of its digits and without guards.
PSEUDONYM = r"PSEUDO_[0-9a-fA-F]+"
#: Log redaction.
LOG_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LOG_NUMBER = r"(?U)\b\d{4,}\b"
