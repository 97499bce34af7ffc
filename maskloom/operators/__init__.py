"""DataFrame operators over text units, spans, edits and evaluation records."""
