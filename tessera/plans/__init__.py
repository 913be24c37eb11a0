"""From SQL text to DataFrames: lexer, parser, binder."""
