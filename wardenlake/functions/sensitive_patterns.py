"""Sensitive-value pattern table."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    type: str
    regex: str
    severity: str
    confidence: str
    regulation: str
    validator: str | None = None
    prefilter: str | None = None


# Unicode-aware, case-insensitive, multi-line: the flags every pattern runs under.
FLAGS = "(?imU)"

# Type, regex, severity, confidence, regulation, validator.  The
# last field is our own cheap test that must hold for any text with a match.
# The address pattern is the linear form of a nested repetition with equal matches.
PATTERNS = [
    Pattern("email", r"\b[\w._%+-]+@[\w.-]+\.[a-zA-Z]{2,}\b", "MEDIUM", "HIGH", "GDPR", None, "@"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "HIGH", "HIGH", "GDPR", None, "-"),
    Pattern("phone", r"(?<!\w)(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
            "MEDIUM", "MEDIUM", "GDPR"),
    Pattern("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "CRITICAL", "HIGH", "PCI-DSS", "luhn"),
    Pattern("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "LOW", "MEDIUM", "GDPR", None, "."),
    Pattern("date_of_birth", r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b",
            "HIGH", "MEDIUM", "GDPR", None, "/"),
    Pattern("address",
            r"\b\d+\s+[A-Za-z][A-Za-z\s]*(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b",
            "MEDIUM", "LOW", "GDPR"),
    Pattern("passport", r"\b[A-Z]{2}\d{7}\b", "HIGH", "MEDIUM", "GDPR"),
    Pattern("driver_license", r"\b[A-Z]{1,2}\d{6,8}\b", "HIGH", "LOW", "GDPR"),
    Pattern("medical_record", r"mrn[\s:=]*[A-Z0-9]+", "CRITICAL", "HIGH", "HIPAA"),
    Pattern("diagnosis_code", r"icd[\s-]?(9|10)[\s:=]+[A-Z0-9.]+", "HIGH", "HIGH", "HIPAA"),
    Pattern("patient_id", r"patient[\s_]id[\s:=]+\S+", "CRITICAL", "HIGH", "HIPAA"),
    Pattern("medical_procedure", r"cpt[\s:]+\d{5}", "MEDIUM", "MEDIUM", "HIPAA"),
    Pattern("health_insurance", r"\b\d{3}-\d{2}-\d{4}\b", "HIGH", "MEDIUM", "HIPAA", None, "-"),
    Pattern("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "CRITICAL", "HIGH", "SECRET"),
    Pattern("api_key",
            r"\b(?:api[_-]?key|token|secret|client_secret)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}['\"]?",
            "HIGH", "MEDIUM", "SECRET"),
    Pattern("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "HIGH", "HIGH", "SECRET", None, "."),
    Pattern("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
            "CRITICAL", "HIGH", "SECRET", None, "-----"),
]

# Types whose every match contains a decimal digit.
NEEDS_DIGIT = frozenset({
    "ssn", "phone", "credit_card", "ip_address", "date_of_birth", "address", "passport",
    "driver_license", "diagnosis_code", "medical_procedure", "health_insurance",
})

# Weight of one finding in the risk score.
SEVERITY_WEIGHT = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "LOW": 1}

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# Advice per type; {regulation} is filled from the finding.
RECOMMENDATIONS = {
    "email": "Remove email address. Use environment variables or configuration files for {regulation} compliance.",
    "ssn": "Remove Social Security Number immediately. {regulation} requires strict protection of this data.",
    "phone": "Remove phone number. Use secure contact management for {regulation} compliance.",
    "credit_card": "Remove credit card-like data immediately and review PCI-DSS handling requirements.",
    "ip_address": "Consider if IP address logging is necessary for {regulation} compliance.",
    "date_of_birth": "Remove date of birth. Use secure user profile management for {regulation} compliance.",
    "address": "Remove address. Use secure address management for {regulation} compliance.",
    "passport": "Remove passport number. {regulation} requires strict protection of identity documents.",
    "driver_license": "Remove driver license number. {regulation} requires strict protection.",
    "medical_record": "Remove medical record-like data and review HIPAA handling requirements.",
    "diagnosis_code": "Remove diagnosis-code-like data and review HIPAA handling requirements.",
    "patient_id": "Remove patient ID-like data and review HIPAA handling requirements.",
    "medical_procedure": "Remove procedure-code-like data and review HIPAA handling requirements.",
    "health_insurance": "Remove health-insurance-like data and review HIPAA handling requirements.",
    "aws_access_key": "Remove AWS access keys and rotate the credential if it is real.",
    "api_key": "Remove hardcoded API keys or tokens and use a secret manager.",
    "jwt": "Remove JWT-like tokens and rotate them if they are real.",
    "private_key": "Remove private keys from source and rotate dependent credentials.",
}
DEFAULT_RECOMMENDATION = "Remove sensitive data for {regulation} compliance."
