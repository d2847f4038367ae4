"""Column expressions: text, vectors, numbers, chunks, stems."""
