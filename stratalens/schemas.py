"""Declared schemas: nothing is inferred in production paths."""

SECTION = "struct<section_id: string, title: string, text: string, tables: array<struct<rows: array<array<string>>, row_count: int, column_count: int, text: string>>, word_count: int, char_count: int>"
FILING = f"document_type string, source_file string, ticker string, company string, filing_type string, filing_date string, fiscal_year int, cik string, sections array<{SECTION}>"
CHUNK = "chunk_id string, ticker string, section_type string, chunk_index int, total_chunks int, text string"
EDGE = "source string, target string, type string, evidence array<string>, confidence double"
EXTRACTED = "struct<suppliers: array<string>, countries: array<string>, products: array<string>, sectors: array<string>, relationships: array<struct<source: string, target: string, type: string>>>"
ADVICE = "struct<action: string, confidence: double, kelly_fraction: double, reasoning: string>"
