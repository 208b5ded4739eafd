"""Scans, payload decoders and sinks."""
