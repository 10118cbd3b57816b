"""Column functions: paths, links, text, tokens, stems."""
