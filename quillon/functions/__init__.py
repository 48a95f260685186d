"""Types, codecs and function nodes."""
