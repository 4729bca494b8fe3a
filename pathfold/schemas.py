"""Schemas of the input facts and of the stored state, as DDL strings.

Missing values are NULL. Times are UTC. Readers never infer: every table is read with one
of these.
"""

from __future__ import annotations

SYMBOLS = "id string, name string, kind string, package string, file string, start_line int, end_line int, exported boolean, doc string, generated boolean, is_test boolean"
CALL_EDGES = "caller string, callee string, kind string, file string, line int"
IMPORT_EDGES = "from_pkg string, to_pkg string"
COVERAGE = "test string, symbol string, fraction double"
COMMITS = "hash string, author_name string, author_email string, ts timestamp, subject string, ai_assisted boolean"
COMMIT_FILES = "hash string, path string, added int, deleted int, renamed string"
AUTHORSHIP = "path string, author string, lines long, last_active timestamp"
NOTES = "hash string"
ACTIVITY = "author string, last_active timestamp"
HUNKS = "hash string, path string, start int, count int"
DECL_SPANS = "hash string, path string, name string, start int, end int"
ENGAGEMENT_EVENTS = "symbol string, kind string, outcome string, at timestamp, score double, elapsed_ms long"

#: The tables of one index generation.
INDEX = {"symbols": SYMBOLS, "call_edges": CALL_EDGES, "import_edges": IMPORT_EDGES, "coverage": COVERAGE, "commits": COMMITS, "commit_files": COMMIT_FILES, "authorship": AUTHORSHIP}
KINDS = ("func", "method", "type", "var", "const")
