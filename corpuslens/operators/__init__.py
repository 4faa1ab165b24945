"""Operators: scans, facts, scores, detectors and what is built on a finished stack."""
