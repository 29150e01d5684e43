"""Readers, typed conversion, audits and sinks."""
