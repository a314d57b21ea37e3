"""Fixed schemas of the index tables."""

from __future__ import annotations

DOCUMENTS = "doc_id long, path string, length int, title string, metadata string, first_line string"
#: ``length`` is the document's, so that ranking reads no other table.
POSTINGS = "term string, doc_id long, term_freq int, length int, positions array<int>"
TERMS = "term string, doc_freq long, total_freq long"
CONFIG = "key string, value string"
INPUT = "path string, text string, title string, metadata string"
RESULTS = "doc_id long, path string, score double, title string, snippet string, line_number int, metadata string, rank int"
